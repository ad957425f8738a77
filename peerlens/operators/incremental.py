"""Incremental refresh of a catalog."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ["citation_count", "works_count", "h_index", "last_publication_year"]


class NoFullBuild(RuntimeError):
    """An update was asked for before any full build."""


def change_window(runs: DataFrame, as_of: dt.date, overlap_days: int = 30, since: dt.date | None = None) -> tuple[dt.date, dt.date]:
    """Dates to scan: from the last run less the overlap, or from `since` where it is given, until `as_of`.

    Refuses when no full build was recorded (C4). runs(last_ingestion, last_cdc_run)
    """
    marks = runs.agg(F.max("last_ingestion").alias("i"), F.max("last_cdc_run").alias("c")).first()  # one row
    if marks is None or marks["i"] is None:
        raise NoFullBuild("no full build is recorded; run one before updating")
    return since or (marks["c"] or marks["i"]) - dt.timedelta(days=overlap_days), as_of


def refresh_people(records: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh metrics over the stored ones; what is missing or empty keeps the stored value.

    fresh(person_id, any of METRICS, primary_domain, domain_weights, works_recent_3y, works_prior_3y).
    Domains change together, and only when fresh weights exist.
    """
    new = fresh.select("person_id", *[F.col(c).alias(f"_new_{c}") for c in fresh.columns if c != "person_id"])
    joined = records.join(new, "person_id", "left")
    columns = []
    for c in records.columns:
        if c not in fresh.columns or c == "person_id":
            columns.append(F.col(c))
        elif c in ("primary_domain", "domain_weights") and "domain_weights" in fresh.columns:
            columns.append(F.when(F.size("_new_domain_weights") > 0, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.coalesce(f"_new_{c}", c).alias(c))
    return joined.select(*columns)


def cdc_stats(scanned: DataFrame, new_pubs: DataFrame, added: DataFrame, refreshed: DataFrame) -> DataFrame:
    """Works scanned, people with new works, publications added, people refreshed: one row."""
    parts = [
        scanned.select(F.lit("works_scanned").alias("k"), F.col("work_id").cast("string").alias("v")),
        new_pubs.select(F.lit("people_with_new_works").alias("k"), F.col("person_id").cast("string").alias("v")).distinct(),
        added.select(F.lit("publications_added").alias("k"), F.col("work_id").cast("string").alias("v")),
        refreshed.select(F.lit("people_refreshed").alias("k"), F.col("person_id").cast("string").alias("v")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    names = ["works_scanned", "people_with_new_works", "publications_added", "people_refreshed"]
    return rows.agg(*[F.count_if(F.col("k") == n).alias(n) for n in names])
