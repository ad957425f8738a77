"""Mix sources to target weights by entropy balancing.

Every document starts at rate 1. Of all rates between 0 and `cap` whose tokens
meet each source's target, the nearest in relative entropy are exponential
tilts, rate = min(cap, exp(lambda of the source * size)). Newton steps on the
convex dual find the lambdas: one step is one aggregate over a histogram of
sizes, so documents are read once. Rates then become whole copies: documents
are laid out by size, a running sum of the fractions gives every whole number
it passes one copy, and at most `REPAIR` documents a source are switched to
take away what is left of the error.

Sums that decide anything are whole numbers or decimals, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import cut_lineage, top_per_group, with_row_number, with_running_sum
from .common import fresh, join_null_safe, seeded, word_count

UNIT = 1 << 20  # fractions of a copy are counted in this many parts
STEPS = 60
NEAR = 1e-4  # of a target, less than rounding to whole copies leaves
REPAIR = 64


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in the order of their names, null last, take `weights` in turn and
    divide `share` of all tokens. A target stops at `cap` times its source; the
    rest is shared again by weight until none is above: target = min(cap * size,
    level * weight), and the level rises to its fixed point, one small aggregate a round.
    """
    ranked = with_row_number(sizes, [F.col("source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    ranked = cut_lineage(ranked.withColumn("_weight", weight).withColumn("_most", F.col("source_size") * F.lit(float(cap))).drop("_rank"))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1.0
    while level > before:
        before, full = level, F.col("_most") <= F.col("_weight") * F.lit(level)
        kept, open_weight = ranked.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0.0))
        ).first()
        level = max(before, (total * share - kept * cap) / open_weight) if open_weight else before
    return ranked.select("source", "source_size", F.least("_most", F.col("_weight") * F.lit(level)).alias("target"))


def _rate(cap: float) -> Column:
    return F.exp(F.least(F.col("_lambda") * F.col("_x"), F.lit(math.log(cap))))


def solve_tilts(histogram: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """(source, _mean, _lambda): the dual solution by Newton steps kept inside a bracket. Cuts a checkpoint a step.

    `histogram` holds (source, mass, n). A target of `cap` times the source, or of 0, is met at the end of the range.
    """
    tokens = F.col("mass").cast("decimal(20,0)") * F.col("n").cast("decimal(10,0)")
    # Sizes are measured by the mean size that a token sees; the first lambda is then the tilt that a single size would need.
    mean = histogram.groupBy("source").agg((F.sum(tokens * F.col("mass")).cast("double") / F.sum(tokens).cast("double")).alias("_mean"))
    far = 1e12
    state = join_null_safe(targets, mean, ["source"]).select(
        "source", "target", F.greatest("_mean", F.lit(1e-9)).alias("_mean"),
        F.when(F.col("target") >= F.col("source_size") * F.lit(cap * (1 - 1e-12)), F.lit(far))
        .when(F.col("target") <= 0, F.lit(-far)).otherwise(F.log(F.col("target") / F.col("source_size"))).alias("_lambda"),
        F.lit(-far).alias("_low"), F.lit(far).alias("_high"), F.lit(1.0).alias("_off"),
    )
    state = cut_lineage(state)
    for _ in range(STEPS):
        met = join_null_safe(histogram, state.select("source", "_mean", "_lambda"), ["source"]).withColumn("_x", F.col("mass") / F.col("_mean"))
        r = _rate(cap)
        slope = F.when(F.col("_lambda") * F.col("_x") < math.log(cap), F.least(r * F.col("_x"), F.lit(1e9))).otherwise(F.lit(0.0))
        sums = met.groupBy("source").agg(
            F.sum(tokens * F.round(r * UNIT).cast("decimal(12,0)")).cast("double").alias("_got"),
            F.sum(tokens * F.round(slope * 1024).cast("decimal(14,0)")).cast("double").alias("_slope"),
        )
        free = F.abs("_lambda") < far
        error = F.col("_got") / UNIT - F.col("target")
        step = F.col("_lambda") - F.when(F.col("_slope") > 0, error / (F.col("_slope") / 1024))
        low = F.when(error < 0, F.col("_lambda")).otherwise(F.col("_low"))
        high = F.when(error > 0, F.col("_lambda")).otherwise(F.col("_high"))
        wide = F.when(error < 0, F.greatest(F.col("_lambda") * 4, F.lit(1.0))).otherwise(F.least(F.col("_lambda") * 4, F.lit(-1.0)))
        inner = F.when((low > -far) & (high < far), (low + high) / 2).otherwise(wide)
        moved = F.when((step > low) & (step < high), step).otherwise(inner)
        off = F.abs(error) / F.greatest(F.col("target"), F.lit(1.0))
        state = join_null_safe(state.drop("_off"), sums, ["source"]).select(
            "source", "target", "_mean",
            F.when(free & (off > NEAR), moved).otherwise(F.col("_lambda")).alias("_lambda"),
            low.alias("_low"), high.alias("_high"), F.when(free, off).otherwise(F.lit(0.0)).alias("_off"),
        )
        state = cut_lineage(state)
        if (state.agg(F.max("_off")).first()[0] or 0.0) <= NEAR:
            break
    return state.select("source", "_mean", "_lambda")


def mix_units(units: DataFrame, targets: DataFrame, cap: int = 2, seed: int = 0) -> DataFrame:
    """Rates and whole copies for `units` (id, source, size, rows): adds source_size, target, rate, copies.

    A unit is all rows with one id, source and size; they share a decision and count as one item of size * rows.
    """
    units = units.withColumn("mass", F.col("size") * F.col("rows"))
    histogram = cut_lineage(units.where("mass > 0").groupBy("source", "mass").agg(F.count("*").alias("n")))
    tilts = solve_tilts(histogram, targets, float(cap))
    rated = join_null_safe(join_null_safe(units, targets, ["source"]), tilts, ["source"], "left")
    rated = rated.withColumn("_x", F.col("mass") / F.col("_mean")).withColumn("rate", F.when(F.col("_lambda").isNull(), F.lit(1.0)).otherwise(_rate(float(cap))))
    rated = rated.withColumn("_parts", F.round(F.col("rate") * UNIT).cast("long")).drop("_x", "_mean", "_lambda")
    rated = rated.withColumn("_whole", F.floor(F.col("_parts") / UNIT)).withColumn("_rest", F.col("_parts") % UNIT)
    order = [F.col("source").asc_nulls_last(), F.col("mass"), seeded(seed, "id"), F.col("id"), F.col("size"), F.col("rows")]
    run = with_running_sum(rated, order, "_rest", "_sum").drop("_pos")
    start = F.pmod(seeded(seed, "_one"), F.lit(UNIT))
    run = run.withColumn("_one", F.lit(1))
    ends, begins = F.expr(f"(_sum + _start) div {UNIT}"), F.expr(f"(_sum - _rest + _start) div {UNIT}")
    run = run.withColumn("_start", start).withColumn("copies", (F.col("_whole") + ends - begins).cast("int"))
    run = cut_lineage(run.drop("_sum", "_one", "_start", "_parts", "_whole", "_rest"))
    return _repaired(run, cap)


def _repaired(run: DataFrame, cap: int) -> DataFrame:
    """Switch up to REPAIR units a source by one copy, largest first, while each takes away from the error."""
    left = run.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("mass"))).alias("_left"))
    room = F.when(F.col("_left") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
    could = join_null_safe(run.select("id", "source", "size", "mass", "copies"), left, ["source"])
    could = could.where(room & (F.col("mass") > 0) & (F.col("mass") <= F.abs("_left")))
    could = top_per_group(could, ["source"], [F.col("mass").desc(), F.col("id"), F.col("size")], REPAIR)
    item = F.struct(F.col("mass").alias("mass"), F.col("id").alias("id"), F.col("size").alias("size"))
    lists = could.groupBy("source").agg(F.sort_array(F.collect_list(item), False).alias("_items"), F.first(F.abs("_left")).alias("_need"), F.first(F.signum("_left")).cast("int").alias("_turn"))
    # The greedy choice, item by item: a string of 0 and 1 and what is still missing.
    none = F.struct(F.col("_need").alias("need"), F.lit("").alias("took"))

    def choose(state, x):
        fits = x["mass"] <= state["need"]
        return F.struct(
            F.when(fits, state["need"] - x["mass"]).otherwise(state["need"]).alias("need"),
            F.concat(state["took"], F.when(fits, F.lit("1")).otherwise(F.lit("0"))).alias("took"),
        )

    lists = lists.withColumn("_took", F.aggregate("_items", none, choose)["took"])
    picks = lists.select("source", "_turn", "_took", F.posexplode("_items").alias("_at", "_item"))
    picks = picks.where(F.substring(F.col("_took"), F.col("_at") + 1, F.lit(1)) == "1").select(
        "source", F.col("_item.id").alias("id"), F.col("_item.size").alias("size"), "_turn"
    )
    out = join_null_safe(run, picks, ["id", "source", "size"], "left")
    return out.withColumn("copies", F.col("copies") + F.coalesce("_turn", F.lit(0))).drop("_turn", "mass")


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per unit: id, source, size (words), rows, source_size, target, rate, copies. Texts are read once and not moved.

    Null or empty texts have size 0 and take no words; they keep rate 1 and one copy where their whole source is empty, else the rate of size 0, which is 1 too. A null source is a source. Rows repeated under one id,
    source and size share a decision. No rows give no rows. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    units = cut_lineage(rows.groupBy("id", "source", "size").agg(F.count("*").alias("rows")))
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    return mix_units(units, cut_lineage(source_targets(sizes, weights, share, cap)), cap, seed)


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mixture itself: rows of `docs` repeated by their copies, columns as they were (names as in `mix_sources`)."""
    id_col, text_col, source_col = (settings.get(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    chosen = mix_sources(docs, **settings).where("copies > 0").select("id", "source", "size", "copies")
    chosen = chosen.select(*[F.col(c).alias(f"_mix_{c}") for c in chosen.columns])
    rows = fresh(docs, *chosen.columns, "_mix_n", "_mix_words").withColumn("_mix_words", word_count(F.col(text_col)))
    condition = (
        rows[id_col].eqNullSafe(chosen["_mix_id"]) & rows[source_col].eqNullSafe(chosen["_mix_source"]) & (rows["_mix_words"] == chosen["_mix_size"])
    )
    taken = rows.join(chosen, condition).withColumn("_mix_n", F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])
