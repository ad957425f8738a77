"""Checks on a build before it is published.

Each check is one row: name, ok, severity, message, metric. They are counts
over the tables just written; nothing is sampled.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.ranking import side_by_side


def _row(df: DataFrame, name: str, ok: Column, message: Column, metric: Column, severity: str = "error") -> DataFrame:
    return df.select(
        F.lit(name).alias("name"), ok.alias("ok"), F.lit(severity).alias("severity"),
        F.when(~ok, message).alias("message"), metric.cast("double").alias("metric"),
    )


def check_unique(df: DataFrame, key: str = "person_id", name: str = "catalog") -> DataFrame:
    """Rows exist and no id is used twice (Q1)."""
    per_key = df.groupBy(key).agg(F.count("*").alias("_n"))
    c = per_key.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count("*").alias("ids"))
    extra = F.col("rows") - F.col("ids")
    message = F.when(F.col("rows") == 0, "no rows").otherwise(F.concat(extra.cast("string"), F.lit(" duplicate ids")))
    return _row(c, name, (F.col("rows") > 0) & (extra == 0), message, extra)


def check_shared_ids(institutions: DataFrame) -> DataFrame:
    """Every institution id, predecessors included, belongs to one institution (Q2)."""
    ids = institutions.select(
        "institution_name",
        F.explode(F.array_compact(F.concat(F.array("institution_id"), F.coalesce("extra_ids", F.array())))).alias("id"),
    )
    shared = ids.groupBy("id").agg(F.count("*").alias("n"), F.min("institution_name").alias("a"), F.max("institution_name").alias("b")).where("n > 1")
    c = shared.agg(F.count("*").alias("n"), F.min(F.concat_ws(" ", "a", F.lit("and"), "b", F.lit("share"), "id")).alias("first"))
    return _row(c, "institution_ids", F.col("n") == 0, F.col("first"), F.col("n"))


def check_counts(records: DataFrame, institutions: DataFrame, stated: int | None = None) -> DataFrame:
    """Institution counts add up to the people there are, and there are some (Q3). institutions(people)"""
    listed = institutions.agg(F.coalesce(F.sum("people"), F.lit(0)).alias("listed"))
    c = side_by_side(records.agg(F.count("*").alias("people")), listed)
    expected = F.col("people") if stated is None else F.lit(stated)
    ok = (F.col("listed") == expected) & (F.col("listed") > 0)
    return _row(c, "counts", ok, F.concat_ws(" ", F.lit("institutions add up to"), "listed", F.lit("of"), expected), F.col("listed"))


def warn_small(institutions: DataFrame, per_institution: int, share: float = V.SMALL_INSTITUTION_SHARE) -> DataFrame:
    """Institutions with under half of the cap, a hint that the wrong one was resolved (Q4)."""
    c = institutions.agg(F.count_if(F.coalesce("people", F.lit(0)) < per_institution * share).alias("n"))
    return _row(c, "small_institutions", F.col("n") == 0, F.concat(F.col("n").cast("string"), F.lit(" institutions are small")), F.col("n"), "warning")


def check_refs(catalog: DataFrame, records: DataFrame) -> DataFrame:
    """Every catalog row has a full record (Q5)."""
    missing = catalog.join(records.select("person_id"), "person_id", "left_anti")
    c = missing.agg(F.count("*").alias("n"), F.min("person_id").cast("string").alias("first"))
    return _row(c, "records", F.col("n") == 0, F.concat_ws(" ", F.col("n").cast("string"), F.lit("records are missing, first"), "first"), F.col("n"))


def check_vectors(vectors: DataFrame, records: DataFrame, dim: int) -> DataFrame:
    """One vector per person, every vector in one cluster and of the right size."""
    if "bits" in vectors.columns:
        wrong = F.octet_length("bits") != (dim + 7) // 8
    else:
        wrong = F.size("q" if "q" in vectors.columns else "vector") != dim
    per_id = vectors.groupBy("person_id").agg(
        F.count_distinct("cluster").alias("clusters"), F.max(F.coalesce(wrong, F.lit(True))).alias("wrong")
    )
    people = records.select("person_id", F.lit(True).alias("_known"))
    joined = people.join(per_id, "person_id", "full")
    bad = joined.agg(
        F.count_if(F.col("clusters").isNull()).alias("without"), F.count_if(F.col("_known").isNull()).alias("unknown"),
        F.count_if(F.col("clusters") != 1).alias("clusters"), F.count_if(F.col("wrong")).alias("size"),
    )
    total = F.col("without") + F.col("unknown") + F.col("clusters") + F.col("size")
    message = F.concat_ws(
        " ", F.lit("people without vector"), "without", F.lit("unknown people"), "unknown", F.lit("not in one cluster"), "clusters",
        F.lit("wrong size"), "size",
    )
    return _row(bad, "vectors", total == 0, message, total)


def compare_builds(previous: DataFrame, current: DataFrame) -> DataFrame:
    """People per institution before and now, by name so that a corrected id is no loss."""
    key = F.coalesce("institution_name", F.col("institution_id").cast("string"))
    p = previous.select(key.alias("name"), F.coalesce("people", F.lit(0)).alias("before"))
    c = current.select(key.alias("name"), F.coalesce("people", F.lit(0)).alias("now"))
    c = c.groupBy("name").agg(F.max("now").alias("now"))
    return p.join(c, "name", "left").fillna(0, ["now"])


def check_shrink(previous: DataFrame, current: DataFrame, allow: bool = False, limit: float = V.MAX_SHRINK) -> DataFrame:
    """No institution of 50 or more, and not the total, lost over a fifth (Q7). Allowed losses become a warning."""
    both = compare_builds(previous, current)
    total_now = current.agg(F.coalesce(F.sum("people"), F.lit(0)).alias("total_now"))
    lost = (F.col("before") >= V.MIN_PREVIOUS_FOR_CHECK) & (F.col("now") < F.col("before") * (1 - limit))
    losses = both.agg(
        F.count_if(lost).alias("n"), F.min(F.when(lost, F.concat_ws(" ", "name", F.col("before").cast("string"), F.lit("to"), F.col("now").cast("string")))).alias("first"),
        F.coalesce(F.sum("before"), F.lit(0)).alias("total_before"),
    )
    c = side_by_side(losses, total_now)
    shrunk = F.col("total_now") < F.col("total_before") * (1 - limit)
    lost_count = F.col("n") + shrunk.cast("int")
    message = F.concat_ws("; ", F.when(shrunk, F.concat_ws(" ", F.lit("total"), "total_before", F.lit("to"), "total_now")), "first")
    return _row(c, "shrink", lost_count == 0, message, lost_count, "warning" if allow else "error")


def check_size(records: DataFrame, budget: int | None, cost: str = "bytes") -> DataFrame:
    """The estimated size is within the budget (Q8)."""
    c = records.agg(F.coalesce(F.sum(cost), F.lit(0)).alias("total"))
    ok = F.lit(True) if budget is None else F.col("total") <= budget
    return _row(c, "size", ok, F.concat_ws(" ", F.col("total").cast("string"), F.lit(f"bytes, over {budget}")), F.col("total"))


def report(*checks: DataFrame) -> DataFrame:
    """All checks in one table (Q9)."""
    return reduce(DataFrame.unionByName, checks)


def status(checks: DataFrame, institutions: DataFrame, mode: str, as_of: dt.datetime, previous: DataFrame | None = None) -> DataFrame:
    """Status row of a build: result, counts, warnings, and the last success before it (Q9).

    previous(generated_at, result) holds earlier status rows.
    """
    c = checks.agg(
        F.count_if(~F.col("ok") & (F.col("severity") == "error")).alias("errors"),
        F.count_if(~F.col("ok") & (F.col("severity") == "warning")).alias("warnings"),
    )
    sizes = institutions.agg(F.coalesce(F.sum("people"), F.lit(0)).alias("people"), F.count("*").alias("institutions"))
    if previous is not None:
        last = previous.agg(F.max(F.when(F.col("result") == "ok", F.col("generated_at"))).alias("previous_success_at"))
        out = side_by_side(c, sizes, last)
    else:
        out = side_by_side(c, sizes).withColumn("previous_success_at", F.lit(None).cast("timestamp"))
    return out.select(
        F.lit(as_of).cast("timestamp").alias("generated_at"), F.lit(mode).alias("mode"),
        F.when(F.col("errors") == 0, "ok").otherwise("failed").alias("result"),
        "people", "institutions", "errors", "warnings", "previous_success_at",
    )
