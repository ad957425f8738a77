"""Writers (S8-S13). Builds are Parquet tables under one root.

Records, catalog, institutions, tags and domains are versioned: files are written
first and count once a manifest names them (`versions`). Runs and status are logs
that are appended to; vectors are replaced.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.ranking import cut_lineage
from ..operators.people import importance, record_chunks, to_catalog, truncate_catalog
from .readers import PART, part_name, read_stored, stored_exists
from .versions import Draft


def put_records(draft: Draft, records: DataFrame, chunk: int = V.RECORD_CHUNK, institutions: Sequence | None = None) -> None:
    """Full records by institution, most important first, `chunk` people per file.

    With `institutions` only their files are replaced; else the whole table is, so that institutions that left the build are gone.
    Rebalancing by institution and chunk splits a large institution over many tasks.
    """
    rows = (
        record_chunks(records.drop("record_chunk"), chunk).hint("rebalance", F.col("institution_id"), F.col("record_chunk"))
        .sortWithinPartitions("institution_id", *importance())
        .withColumn(PART, part_name(F.col("institution_id")))
    )
    draft.put("records", rows, PART, part_names(institutions), {"maxRecordsPerFile": str(chunk)})


def put_catalog(draft: Draft, records: DataFrame, top_n: int | None = None, institutions: Sequence | None = None) -> bool:
    """Slim rows: everyone by institution, and the `top_n` most important people where that is not all.

    `records` are all of the build. With `institutions` only their rows by institution are written anew. Returns whether `catalog` is complete.
    """
    rows = cut_lineage(to_catalog(records))  # slim rows, read up to three times
    complete = top_n is None or rows.count() <= top_n
    whole = "catalog" if complete else "catalog_by_institution"
    if not complete:
        draft.put("catalog", truncate_catalog(rows, top_n))
    else:
        draft.drop("catalog_by_institution")  # left by an earlier, truncated build
    # Parts can only be replaced where the table was written by institution before.
    scoped = institutions is not None and "" not in draft.tables.get(whole, {"": ""})
    mine = rows.where(F.col("institution_id").isin(list(institutions))) if scoped else rows
    by_institution = mine.hint("rebalance", F.col("institution_id")).withColumn(PART, part_name(F.col("institution_id")))
    draft.put(whole, by_institution, PART, part_names(institutions) if scoped else None)
    return complete


def part_names(institutions: Sequence | None) -> list[str] | None:
    return None if institutions is None else [f"i{x}" for x in institutions]


def write_records(records: DataFrame, root: str, chunk: int = V.RECORD_CHUNK) -> None:
    """`put_records` as a version of its own."""
    draft = Draft(records.sparkSession, root)
    put_records(draft, records, chunk)
    draft.commit()


def write_institutions(institutions: DataFrame, root: str) -> None:
    draft = Draft(institutions.sparkSession, root)
    draft.put("institutions", institutions)
    draft.commit()


def write_catalog(records: DataFrame, root: str, top_n: int | None = None) -> bool:
    """`put_catalog` as a version of its own."""
    draft = Draft(records.sparkSession, root)
    complete = put_catalog(draft, records, top_n)
    draft.commit()
    return complete


def write_vector_index(vectors: DataFrame, centroids: DataFrame, root: str) -> None:
    """Vectors partitioned by cluster, and the centroids (S10). A large cluster is split over tasks."""
    (
        vectors.hint("rebalance", F.col("cluster"))
        .write.mode("overwrite")
        .partitionBy("cluster")
        .parquet(f"{root}/vectors")
    )
    centroids.write.mode("overwrite").parquet(f"{root}/centroids")


def csv_cell(c: Column) -> Column:
    """Text of a cell; one a spreadsheet would read as a formula gets an apostrophe."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def csv_rows(shortlist: DataFrame) -> DataFrame:
    """The ten export columns of a shortlist.

    shortlist(name, title, institution_name, country_code, rank, email, profile_url, status, note, saved_at)
    """
    source = ["name", "title", "institution_name", "country_code", "rank", "email", "profile_url", "status", "note"]
    columns = [csv_cell(F.col(c)).alias(n) for c, n in zip(source, V.CSV_COLUMNS)]
    return shortlist.select(*columns, csv_cell(F.substring(F.col("saved_at").cast("string"), 1, 10)).alias(V.CSV_COLUMNS[-1]))


def export_csv(shortlist: DataFrame, path: str) -> None:
    """Write the export with doubled quotes and one header line per file."""
    csv_rows(shortlist).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option(
        "emptyValue", ""
    ).csv(path)


RUN_SCHEMA = """kind string, generated_at timestamp, last_ingestion date, last_cdc_run date, window_from date, window_to date,
people long, with_email long, institutions long, pruned long, catalog_rows long, catalog_complete boolean,
per_institution int, window_years int, works_scanned long, people_with_new_works long, publications_added long, people_refreshed long"""


def write_run_metadata(spark: SparkSession, root: str, kind: str, as_of: dt.datetime, **stats) -> None:
    """Append one row about this run: counts, thresholds, window, pruning."""
    row = {"kind": kind, "generated_at": as_of, **stats}
    fields = [f.split()[0] for f in RUN_SCHEMA.replace("\n", " ").split(",")]
    unknown = set(row) - set(fields)
    if unknown:
        raise ValueError(f"unknown run fields: {sorted(unknown)}")
    spark.createDataFrame([tuple(row.get(f) for f in fields)], RUN_SCHEMA).write.mode("append").parquet(f"{root}/runs")


def write_status(status: DataFrame, root: str) -> None:
    """Append a build's status row (Q9); earlier rows give the previous success."""
    status.write.mode("append").parquet(f"{root}/status")


def snapshot(spark: SparkSession, root: str, target: str) -> None:
    """Copy what the next build is compared with: institutions, runs and status (Q9)."""
    if stored_exists(spark, root, "institutions"):
        write_institutions(read_stored(spark, root, "institutions"), target)
    for name in ("runs", "status"):
        if stored_exists(spark, root, name):
            spark.read.parquet(f"{root}/{name}").write.mode("overwrite").parquet(f"{target}/{name}")


def assemble_partials(parts: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Union of partial builds, refused unless every expected partial is there (S13). parts(partial_id, ...)"""
    wanted = parts.where(F.col("partial_id").isin(list(expected)))
    found = {r[0] for r in wanted.select("partial_id").distinct().collect()}  # at most the expected ids
    missing = sorted(set(expected) - found)
    if missing:
        raise ValueError(f"partial results missing: {', '.join(missing)}")
    return wanted.drop("partial_id")
