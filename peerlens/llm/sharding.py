"""Cut a corpus into shards that each hold the mixture of sources: proportional stratified interleaving.

Rows are shuffled by a seeded hash within each source and ranked; row r of n
stands at (r - 1/2) / n. Sorted by that fraction the sources interleave in
proportion, so every stretch of the order has every source's share, and equal
stretches are the shards. Both orders are range-partitioned sorts of narrow
rows, so a source with a third of all rows spans many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import with_row_number
from .common import fresh, join_null_safe, seeded


def interleave(rows: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Add `shard` (0 ..) and `slot` (gapless from 0) to narrow rows; shard sizes differ by one row at most. Cuts checkpoints.

    Null ids and sources are values of their own. Rows repeated with one id get slots of their own, which of them
    gets which does not matter. Columns named shard or slot are replaced.
    """
    rows = fresh(rows, "shard", "slot").withColumn("_mix", seeded(seed, id_col))
    tie = [F.col("_mix"), F.col(id_col).asc_nulls_last()]
    counts = rows.groupBy(source_col).agg(F.count("*").alias("_of"))
    ranked = with_row_number(rows, tie, "_rank", keys=[source_col])
    placed = join_null_safe(ranked, counts, [source_col]).withColumn("_at", (F.col("_rank") - 0.5) / F.col("_of")).drop("_rank", "_of")
    order = [F.col("_at"), F.col(source_col).asc_nulls_last(), *tie]
    total = rows.agg(F.count("*")).first()[0]
    numbered = with_row_number(placed, order, "_pos").withColumn("_pos", F.col("_pos") - 1)
    numbered = numbered.withColumn("shard", F.floor(F.col("_pos") * shards / F.lit(max(total, 1))).cast("int"))
    # floor() of a quotient of longs through a double may be one off at a border; settle it in whole numbers.
    begin = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    after = F.expr(f"((shard + 1) * {total} + {shards - 1}) div {shards}")
    numbered = numbered.withColumn("shard", F.when(F.col("_pos") < begin, F.col("shard") - 1).when(F.col("_pos") >= after, F.col("shard") + 1).otherwise(F.col("shard")))
    return numbered.withColumn("slot", F.col("_pos") - begin).drop("_mix", "_at", "_pos")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write whole documents, one folder per shard; its files, in the order of their names, hold the rows in the order of their slots.

    A shard of any size is written by as many tasks as its rows fill. Ids must be unique.
    """
    joined = join_null_safe(docs, placed.select(id_col, "shard", "slot"), [id_col])
    shards = joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    shards.write.partitionBy("shard").parquet(path)
