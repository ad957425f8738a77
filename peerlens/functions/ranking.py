"""Ranked selection that holds when one group has a third of all rows.

`top_per_group` never moves a whole group to one task: up to 1000 rows per
group Spark's WindowGroupLimit cuts every map task's share before the shuffle;
above that each input partition's share is cut on its own. From 17 rows per
group on, bundles of partitions are merged first, so that the last task gets
MERGE_WIDTH times `n` rows of a group at most, however many tasks there were.

`with_row_number` and `with_running_sum` number *all* rows of a group or of the
whole table. They range-partition on the full sort key, so a hot group spans
many tasks, then add per-partition offsets from a small table.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GROUP_LIMIT = 1000
MERGE_FROM = 16  # with n up to this, even 100,000 tasks send 1.6 million rows of a group at most
MERGE_WIDTH = 32


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in `spark.checkpoint.dir`. Without one, only a one-machine master gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="peerlens-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are computed once and survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, on storage every executor sees."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame) -> DataFrame:
    """The rows as compressed columns in a fresh folder beside the checkpoints: computed once, and of known size to joins."""
    path = scratch_dir(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side_by_side(*totals: DataFrame) -> DataFrame:
    """Several one-row aggregates as one row, without a join."""
    rows = totals[0]
    for t in totals[1:]:
        rows = rows.unionByName(t, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan with fewer tasks than cores dealt out to all of them; any other plan is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank_col: str | None = None
) -> DataFrame:
    """First `n` rows of every group. `order` must end in a unique column for a repeatable result."""
    rank = rank_col or "_rank"

    def cut(rows: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)

    if n > MERGE_FROM:
        df = df.withColumn("_part", F.spark_partition_id())
        if n > GROUP_LIMIT:
            df = cut(df, [*keys, "_part"]).drop(rank)
        df = cut(df.withColumn("_part", F.pmod("_part", F.lit(MERGE_WIDTH))), [*keys, "_part"]).drop("_part", rank)
    out = cut(df, list(keys))
    return out if rank_col else out.drop(rank)


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows sorted over range partitions, with `_pid` and `_idx` fixed by a checkpoint."""
    sort_key = [F.col(k).asc_nulls_first() for k in keys] + list(order)
    numbered = (
        df.repartitionByRange(*sort_key).sortWithinPartitions(*sort_key).withColumn("_mid", F.monotonically_increasing_id())
    )
    return (
        cut_lineage(numbered)
        .withColumn("_pid", F.shiftright("_mid", 33))
        .withColumn("_idx", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mid")
    )


def with_row_number(df: DataFrame, order: Sequence[Column], out: str, keys: Sequence[str] = ()) -> DataFrame:
    """1-based position of every row within its group (or the whole table). Cuts a checkpoint."""
    rows = _ranged(df, keys, order)
    # At most one entry per range partition and group boundary: (partitions + groups) rows.
    spans = rows.groupBy(*keys, "_pid").agg(F.count("*").alias("_n"), F.min("_idx").alias("_first"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = _null_safe_join(rows, spans.drop("_n"), [*keys, "_pid"])
    return joined.withColumn(out, F.col("_offset") + F.col("_idx") - F.col("_first") + 1).drop(
        "_pid", "_idx", "_offset", "_first"
    )


def with_running_sum(df: DataFrame, order: Sequence[Column], value: str, out: str, position: str = "_pos") -> DataFrame:
    """Inclusive running sum of `value` over the whole table and the row's position. Cuts a checkpoint."""
    rows = _ranged(df, (), order)
    spans = rows.groupBy("_pid").agg(F.sum(value).alias("_sum"), F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per range partition
    spans = spans.select(
        "_pid",
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_count"),
    )
    local = Window.partitionBy("_pid").orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_local", F.sum(value).over(local))
        .join(spans, "_pid")
        .withColumn(out, F.col("_base") + F.col("_local"))
        .withColumn(position, F.col("_count") + F.col("_idx") + 1)
        .drop("_pid", "_idx", "_base", "_count", "_local")
    )


def _null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    renamed = right
    for c in on:
        renamed = renamed.withColumnRenamed(c, f"_r_{c}")
    condition = F.lit(True)
    for c in on:
        condition = condition & left[c].eqNullSafe(renamed[f"_r_{c}"])
    return left.join(renamed, condition).drop(*[f"_r_{c}" for c in on])
