"""Newest works per person from a stream of authored works.

A stateful operator keeps at most `n` works per person. Works that come again are
dropped, or replace their earlier version; rows older than the watermark are not
let in. State of a person nobody has written about for that long goes away.

What the operator sends is merged into a table of results: people lie in BUCKETS
by a hash of their id, a batch writes the buckets it touches anew, and a manifest
says which folder of a bucket counts. So reading costs the size of the result, a
replayed batch changes nothing, and a reader never sees half a batch.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import fixed_values as V
from ..functions.ranking import top_per_group
from ..operators.works import newest_first
from ..sources import versions

LATE = "30 days"
BUCKETS = 64
TABLE = "recent"
COLUMNS = ["work_id", "title", "year", "date", "ts"]
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def newest_per_person(works: DataFrame, n: int = V.MAX_RECENT) -> DataFrame:
    """Newest `n` works per person; of several versions of a work the one with the latest `ts` counts."""
    whole = F.struct(*[F.col(f"`{c}`") for c in works.columns])
    latest = works.groupBy("person_id", "work_id").agg(F.max_by(whole, F.struct("ts", F.xxhash64(*works.columns))).alias("_row"))
    return top_per_group(latest.select("_row.*"), ["person_id"], newest_first(), n)


class NewestWorks(StatefulProcessor):
    """Per person: the newest `n` works by date, then id; sent whenever they change."""

    def __init__(self, n: int, schema):
        self.n, self.schema = n, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.works = handle.getListState("works", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [f.name for f in self.schema.fields]
        old = [tuple(r) for r in self.works.get()]
        held = {r[0]: r for r in old}
        at = names.index("ts")
        for some in rows:
            for r in some[names].itertuples(index=False, name=None):
                r = tuple(None if v is None or v is pd.NaT or v != v else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r)
                # Of two versions the later one counts; at the same time the order of their values decides.
                if r[0] not in held or (r[at], repr(r)) > (held[r[0]][at], repr(held[r[0]])):
                    held[r[0]] = r
            if len(held) > 1000:  # a person with very many works is cut on the way
                held = {r[0]: r for r in self._newest(held, names)}
        new = self._newest(held, names)
        if new == old:
            return
        self.works.put(new)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(max(r[at] for r in new).timestamp() * 1000))
        out = pd.DataFrame(new, columns=names)
        out.insert(0, "person_id", key[0])
        yield out

    def _newest(self, held: dict, names: list[str]) -> list[tuple]:
        day = names.index("date")
        by_id = sorted(held.values(), key=lambda r: r[0])
        return sorted(by_id, key=lambda r: (r[day] is not None, r[day].toordinal() if r[day] is not None else 0), reverse=True)[: self.n]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.works.clear()
        return iter(())

    def close(self) -> None:
        pass


def merge_batch(batch: DataFrame, batch_id: int, root: str, n: int = V.MAX_RECENT, buckets: int = BUCKETS) -> None:
    """Merge a batch of results into the table under `root`; only the buckets of its people are read and written.

    Version `batch_id + 1` of the table is made from version `batch_id`, so a batch that is run again finds its work done.
    """
    spark = batch.sparkSession
    before = versions.current(spark, root)
    if before.version > batch_id:
        return
    bucket = F.pmod(F.xxhash64("person_id"), F.lit(buckets))
    rows = batch.withColumn("bucket", bucket.cast("int"))
    touched = sorted(r[0] for r in rows.select("bucket").distinct().collect())  # BUCKETS numbers at most
    folders = dict(before.tables.get(TABLE, {}))
    schema = batch.schema
    stored = [f for b in touched if (f := folders.get(str(b)))]
    everything = batch if not stored else batch.unionByName(spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in stored]))
    place = versions.fresh_folder(TABLE)
    if touched:
        newest = newest_per_person(everything, n).withColumn("bucket", bucket.cast("int"))
        newest.write.partitionBy("bucket").parquet(f"{root}/{place}")
        folders |= {str(b): f"{place}/bucket={b}" for b in touched}
    # Batches without rows leave no version behind, so numbers may be skipped; they only have to rise.
    versions.commit(spark, root, dataclasses.replace(before, version=batch_id + 1, tables={**before.tables, TABLE: folders}, schemas={**before.schemas, TABLE: json.dumps(schema.jsonValue())}))


def stream_recent_works(stream: DataFrame, root: str, n: int = V.MAX_RECENT, available_now: bool = True, late: str = LATE, buckets: int = BUCKETS) -> StreamingQuery:
    """Start the job: stream(person_id, work_id, title, year, date, ts) into the results under `root`.

    Rows more than `late` behind the newest `ts` of earlier batches are dropped. A person's state is cleared once all its works
    are behind the watermark; what has been sent stays in the results, and works that come later are merged with it. A version that
    moves a work back in time does not bring back works that were beyond the `n` before. State is kept in RocksDB beside the results.
    """
    spark = stream.sparkSession
    schema = stream.select(*COLUMNS).schema
    whole = stream.select("person_id", *COLUMNS).schema
    timed = stream.select("person_id", *COLUMNS).where("ts is not null").withWatermark("ts", late)
    newest = timed.groupBy("person_id").transformWithStateInPandas(NewestWorks(n, schema), whole, "Update", "EventTime")

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, batch_id, root, n, buckets)

    writer = newest.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", f"{root}/checkpoint")
    provider = spark.conf.get(ROCKS[0], None)
    spark.conf.set(*ROCKS)  # the query keeps the settings it is started with
    try:
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        if provider is None:
            spark.conf.unset(ROCKS[0])
        else:
            spark.conf.set(ROCKS[0], provider)


def read_recent_works(spark: SparkSession, root: str, people: list | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Newest works per person over every batch so far; with `people`, only their buckets are opened."""
    if people is None:
        return versions.read_table(spark, root, TABLE)
    manifest = versions.current(spark, root)
    kind = next(f["type"] for f in json.loads(manifest.schemas[TABLE])["fields"] if f["name"] == "person_id")
    names = reduce(lambda a, b: a.unionByName(b), [spark.range(1).select(F.lit(p).cast(kind).alias("person_id")) for p in people])
    wanted = [str(r[0]) for r in names.select(F.pmod(F.xxhash64("person_id"), F.lit(buckets))).distinct().collect()]
    return versions.read_table(spark, root, TABLE, wanted, manifest=manifest).join(F.broadcast(names), "person_id", "left_semi")
