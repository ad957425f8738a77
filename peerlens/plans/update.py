"""Incremental catalog update as one DataFrame job."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import cut_lineage
from ..operators import incremental, people, topics, works
from ..sources import readers, versions, writers
from ..sources.work_tables import open_window
from .build import Built, Limits, publish, tag_lists, within_budget


@dataclass
class Catalog:
    """Stored state: one row per person, newest publications, tags."""

    records: DataFrame  # person_id, institution_id, metrics, contacts, domains, lab signals
    publications: DataFrame  # person_id, work_id, title, year, date, position, first_author, recency
    tags: DataFrame  # person_id, pos, tag, kind


def window_works(
    people_: DataFrame, window: tuple[dt.date, dt.date], institutions: DataFrame, changed_works: DataFrame, authorships: DataFrame, work_institutions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """The window's works at tracked institutions, and those of the given people. Cuts a checkpoint."""
    since, until = window
    scanned = works.works_at(changed_works.where(F.col("date").between(since, until)), work_institutions, institutions)
    return scanned, cut_lineage(works.works_of(people_, scanned, authorships))


def update_catalog(
    stored: Catalog,
    window: tuple[dt.date, dt.date],
    institutions: DataFrame,
    changed_works: DataFrame,
    authorships: DataFrame,
    work_institutions: DataFrame,
    fresh: DataFrame,
    work_funders: DataFrame | None = None,
    fresh_tags: DataFrame | None = None,
    found: tuple[DataFrame, DataFrame] | None = None,
) -> tuple[Catalog, DataFrame]:
    """New works of tracked people merged, signals and metrics refreshed, everything unmentioned kept.

    The date range is a literal and reaches the scan; only works at tracked
    institutions and people with new works are shuffled against the stored state. `found` is what `window_works` gave, if
    the caller has it already.
    """
    scanned, new_pubs = found or window_works(stored.records, window, institutions, changed_works, authorships, work_institutions)
    # The merged rows of people that the window touches are read several times below, as its works are.
    touched = new_pubs.select("person_id").distinct()
    old_pubs = stored.publications.drop("recency")
    mine = old_pubs.join(touched, "person_id", "left_semi")
    merged = cut_lineage(works.merge_publications(mine, new_pubs))
    untouched = stored.publications.join(touched, "person_id", "left_anti")
    publications = untouched.unionByName(merged.select(*stored.publications.columns))

    records = stored.records
    if work_funders is not None and "lab_first_authors" in records.columns:
        lab = works.lab_signals(merged, work_funders)
        columns = ["person_id", "lab_first_authors", "lab_senior_papers", "recent_funders"]
        merged_lab = works.merge_lab_signals(records.select(*columns), lab)
        records = records.drop(*columns[1:]).join(merged_lab, "person_id", "left")
    records = incremental.refresh_people(records, fresh)
    if {"email", "profile_url", "title", "profile_source"} <= set(records.columns):
        records = people.with_contact_flags(records)
    tags = stored.tags if fresh_tags is None else topics.keep_stored_tags(stored.tags, fresh_tags)
    added = works.added_publications(stored.publications, merged)
    refreshed = fresh.join(stored.records.select("person_id"), "person_id", "left_semi")
    return Catalog(records, publications, tags), incremental.cdc_stats(scanned, new_pubs, added, refreshed)


def refresh_build(
    root: str,
    as_of: dt.datetime,
    changed_works: DataFrame,
    authorships: DataFrame,
    work_institutions: DataFrame,
    fresh: DataFrame,
    work_funders: DataFrame | None = None,
    fresh_tags: DataFrame | None = None,
    overlap_days: int = 30,
    limits: Limits | None = None,
    target: str | None = None,
    since: dt.date | None = None,
) -> DataFrame:
    """Update the build under `root` and stamp the run (C2, C4, S12). Returns the statistics row.

    Works are scanned from `since`, or from the last run less the overlap. Only institutions with touched people (new works, fresh metrics or
    tags) are read in full and written; the files of the others stay. With a size budget in `limits`, which people
    of other institutions may fall out by, or with `target`, everything is written anew. The new build becomes visible as one version,
    under `root` or under `target`.
    """
    spark = changed_works.sparkSession
    limits = limits or Limits()
    window = incremental.change_window(spark.read.parquet(f"{root}/runs"), as_of.date(), overlap_days, since)
    institutions = cut_lineage(readers.read_stored(spark, root, "institutions"))
    if "extra_ids" not in institutions.columns:
        none = F.lit(None).cast(f"array<{institutions.schema['institution_id'].dataType.simpleString()}>")
        institutions = institutions.withColumn("extra_ids", none)
    kinds = readers.read_stored(spark, root, "tags").select("tag", "kind")
    everyone = readers.read_records(spark, root)
    found = window_works(everyone.select("person_id"), window, institutions, changed_works, authorships, work_institutions)
    changed = None
    if target is None and limits.size_budget is None and versions.holds(spark, root, "records"):
        named = [found[1].select("person_id"), fresh.select("person_id"), *([fresh_tags.select("person_id")] if fresh_tags is not None else [])]
        touched = reduce(DataFrame.unionByName, named).distinct()
        homes = everyone.select("person_id", "institution_id").join(touched, "person_id", "left_semi").select("institution_id").distinct()
        changed = sorted((r[0] for r in homes.where("institution_id is not null").collect()), key=str)  # institutions, not people
    stored = cut_lineage(readers.read_records(spark, root, changed))
    pubs = stored.select("person_id", F.posexplode("recent_publications").alias("_i", "p")).select(
        "person_id", "p.*", F.lit(None).cast(stored.schema["person_id"].dataType).alias("first_author"), (F.col("_i") + 1).alias("recency")
    )
    tags = stored.select("person_id", F.posexplode("tags").alias("pos", "tag")).join(kinds, "tag").select("person_id", "pos", "tag", "kind")
    state = Catalog(stored.drop("recent_publications", "tags", "record_chunk"), pubs, tags)
    after, stats = update_catalog(
        state, window, institutions, changed_works, authorships, work_institutions, fresh, work_funders, fresh_tags, found
    )
    stats = cut_lineage(stats)
    row = stats.first()
    publications = cut_lineage(after.publications)
    scored = after.records.drop("first_author_recent", "last_author_recent", "recent_works", "seniority_score")
    records = works.with_seniority(scored, works.role_counts(publications))
    if "domain_weights" in fresh.columns:
        records = topics.with_domain_names(records.drop("domains"))
    after_tags = cut_lineage(after.tags)
    records = records.join(works.publication_arrays(publications), "person_id", "left").join(tag_lists(after_tags), "person_id", "left")
    records, extra = within_budget(records, limits)
    if target is not None:
        writers.snapshot(spark, root, target)  # run history goes along
    publish(
        Built(cut_lineage(records), publications, after_tags, extra), institutions, target or root, as_of, limits, "update", changed,
        window_from=window[0], window_to=window[1], **row.asDict(),
    )
    return stats


def refresh_from_tables(
    root: str, as_of: dt.datetime, tables: str, fresh: DataFrame, overlap_days: int = 30, since: dt.date | None = None, **options
) -> DataFrame:
    """`refresh_build` with works from `sources.work_tables` under `tables`: only the window's months are read, and nothing of theirs is shuffled by work."""
    spark = fresh.sparkSession
    window = incremental.change_window(spark.read.parquet(f"{root}/runs"), as_of.date(), overlap_days, since)
    return refresh_build(root, as_of, *open_window(spark, tables, window), fresh, overlap_days=overlap_days, since=window[0], **options)
