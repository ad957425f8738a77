"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph is what stands between line feeds, unchanged. Each is hashed to a
wide vector, and a text's vector is the sum over its paragraphs, lane by lane
modulo a power of two, plus their number. The sum does not depend on the order,
and a paragraph is put in or taken out by adding or subtracting its vector.

- `EQUAL` dense lanes modulo 2**32, all touched by every paragraph: equality.
- `SPARSE` lanes modulo 2**16, `TOUCHED` of them touched by each paragraph: of
  two texts, the lanes that differ tell how many different paragraphs do not occur
  equally often, and the lanes in use how many there are at all; k lanes stand for
  about -SPARSE / TOUCHED * ln(1 - k / SPARSE) paragraphs.

All of it is SQL functions on one row; nothing is exploded or shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bind

EQUAL, SPARSE, TOUCHED = 8, 512, 2
BITS_EQUAL, BITS_SPARSE = 32, 16


def paragraph_hashes(text: Column) -> Column:
    """One long per paragraph; a null counts as an empty text, which has one empty paragraph."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda p: F.xxhash64(p))


def vector(hashes: Column) -> Column:
    """Array of longs: number of paragraphs, EQUAL dense lanes, SPARSE sparse lanes."""

    def dense(j):
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda s, h: s + F.xxhash64(h, j).bitwiseAND(F.lit((1 << BITS_EQUAL) - 1))) % F.lit(1 << BITS_EQUAL)

    width = 1 << BITS_SPARSE
    zero = F.lit(0).cast("long")

    def touched(h):
        """TOUCHED longs, lane * 2**16 + value, from other bits of one hash."""
        again = [F.xxhash64(h, F.lit(-1 - t)) for t in range(TOUCHED)]
        return F.array(*[F.pmod(x, F.lit(SPARSE * width)).bitwiseOR(F.lit(1)) for x in again])

    def put(lanes, e):
        """The sorted entries fill the lanes from the left: the last lane grows, or zeros and a new lane follow."""
        lane, value = F.shiftright(e, BITS_SPARSE).cast("int"), e % F.lit(width)
        last = F.concat(F.slice(lanes, F.lit(1), lane), F.array((F.get(lanes, lane) + value) % F.lit(width)))
        return F.when(F.size(lanes) > lane, last).otherwise(F.concat(lanes, F.array_repeat(zero, lane - F.size(lanes)), F.array(value)))

    entries = F.array_sort(F.flatten(F.transform(hashes, touched)))
    filled = F.aggregate(entries, F.array().cast("array<bigint>"), put, lambda x: F.concat(x, F.array_repeat(zero, F.lit(SPARSE) - F.size(x))))
    number = F.array((F.size(hashes).cast("long") % F.lit(1 << BITS_EQUAL)))
    return F.concat(number, F.transform(F.sequence(F.lit(0), F.lit(EQUAL - 1)), dense), filled)


def combine(left: Column, right: Column, sign: int = 1) -> Column:
    """Vector of two texts' paragraphs together, or with sign -1 of the left without the right's."""
    width = F.lit(1 << BITS_EQUAL), F.lit(1 << BITS_SPARSE)
    summed = F.zip_with(left, right, lambda a, b: a + b * sign)
    return F.transform(summed, lambda v, i: F.when(i <= EQUAL, F.pmod(v, width[0])).otherwise(F.pmod(v, width[1])))


def fingerprint(vec: Column) -> Column:
    """The vector in lowercase hexadecimal."""
    head = F.transform(F.slice(vec, 1, EQUAL + 1), lambda v: F.lpad(F.hex(v), BITS_EQUAL // 4, "0"))
    rest = F.transform(F.slice(vec, EQUAL + 2, SPARSE), lambda v: F.lpad(F.hex(v), BITS_SPARSE // 4, "0"))
    return F.lower(F.array_join(F.concat(head, rest), ""))


def likeness(a: Column, b: Column) -> Column:
    """2 * j / (1 + j), j the estimated share of different paragraphs that both have equally often; exactly 1 for equal vectors."""

    def add(s, v):
        return s + v

    def paragraphs(lanes):
        return -F.log(F.lit(1.0) - F.least(lanes, F.lit(SPARSE - 0.5)) / F.lit(float(SPARSE)))

    x, y = F.slice(a, EQUAL + 2, SPARSE), F.slice(b, EQUAL + 2, SPARSE)
    off = F.aggregate(F.zip_with(x, y, lambda u, v: (u != v).cast("int")), F.lit(0), add)
    used = F.aggregate(F.zip_with(x, y, lambda u, v: ((u != 0) | (v != 0)).cast("int")), F.lit(0), add)
    j = F.lit(1.0) - paragraphs(off) / F.greatest(paragraphs(used), F.lit(1e-9))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 2 * j / (1 + j)))


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add `vector` and `fingerprint`. Equal multisets of paragraphs have equal ones; columns of those names are replaced."""
    hashed = docs.withColumn("vector", bind(paragraph_hashes(F.col(text_col)), vector))
    return hashed.withColumn("fingerprint", fingerprint(F.col("vector")))


MOST_BORDERS = 1000


def _stretch(rows: DataFrame, id_col: str, rows_per_stretch: int) -> DataFrame:
    """Add `_stretch`, a long that grows as ids fall; about `rows_per_stretch` rows have the same.

    Two levels of quantiles, each near the square root of the number of stretches, so a row is compared with few
    borders: the upper ones are literals, the lower ones a table with a row per upper stretch. Both are bounded by
    MOST_BORDERS, the table by its square in numbers, so it is broadcast. Null ids come last.
    """
    total = rows.agg(F.count("*")).first()[0]
    pieces = max(1, math.ceil(total / rows_per_stretch))
    upper = min(MOST_BORDERS, math.ceil(math.sqrt(pieces)))
    lower = min(MOST_BORDERS, math.ceil(pieces / upper))
    none = F.col(id_col).isNull()

    def quantiles(n):
        return F.percentile_approx(id_col, [i / n for i in range(1, n)] or [0.5], 10_000)

    def above(borders):
        return F.size(F.filter(borders, lambda b: b > F.col(id_col)))

    borders = (rows.agg(quantiles(upper)).first()[0] or []) if upper > 1 else []
    first = F.when(none, F.lit(len(borders))).otherwise(above(F.array(*[F.lit(b) for b in borders]))) if borders else F.lit(0)
    rows = rows.withColumn("_upper", first)
    table = rows.groupBy("_upper").agg(quantiles(lower).alias("_lower"))
    rows = rows.join(F.broadcast(table), "_upper")
    second = F.when(none, F.coalesce(F.size("_lower"), F.lit(0))).otherwise(above("_lower"))
    return rows.withColumn("_stretch", F.col("_upper").cast("long") * (MOST_BORDERS + 1) + second).drop("_upper", "_lower")


def with_successor(rows: DataFrame, id_col: str, carried: list[str], rows_per_stretch: int = 2000) -> DataFrame:
    """Add next_<column> from the row that follows by descending id; after the last comes the first. Ids are numbers and should be unique.

    Ids are cut at quantiles into stretches of about `rows_per_stretch` rows (null ids, last in the order, join the
    last). Within one, `lead` finds the next row; a stretch's last row takes the first row of the next stretch from a
    table with one row per stretch. Rows with texts are shuffled once, by stretch.
    """
    rows = _stretch(rows, id_col, rows_per_stretch)
    following = F.struct(*[F.col(c) for c in carried])
    order = F.col(id_col).desc_nulls_last()
    heads = rows.groupBy("_stretch").agg(F.max_by(following, F.struct(F.col(id_col).isNotNull(), F.col(id_col))).alias("_head"))
    inner = Window.partitionBy("_stretch").orderBy(order)
    # One number per stretch: where the next stretch that has rows begins.
    turns = Window.orderBy("_stretch")
    bounds = heads.select("_stretch").withColumn("_first", F.min("_stretch").over(turns.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    bounds = bounds.withColumn("_after", F.coalesce(F.lead("_stretch").over(turns), F.col("_first"))).select("_stretch", "_after")
    heads = bounds.join(heads.withColumnRenamed("_stretch", "_after"), "_after").select("_stretch", "_head")
    out = rows.withColumn("_next", F.lead(following).over(inner)).join(heads, "_stretch", "left")
    out = out.withColumn("_next", F.coalesce("_next", "_head"))
    return out.select("*", *[F.col(f"_next.{c}").alias(f"next_{c}") for c in carried]).drop("_stretch", "_next", "_head")
