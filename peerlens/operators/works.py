"""Works, authorship and what they say about a person.

Tables: works(work_id, title, year, date), authorships(work_id, person_id,
position), work_funders(work_id, funder), year_counts(person_id, year, works).
Publications are rows: (person_id, work_id, title, year, date, position,
first_author), newest first by date, then work_id.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.ranking import top_per_group
from ..functions.text import cut


def author_positions(lines: DataFrame) -> DataFrame:
    """Rank authors of a work into first, middle and last, with the first author of last-author papers.

    lines(work_id, person_id, place). The ends come from min/max aggregates, so a
    work with very many authors is never sorted in one task.
    """
    key = F.struct("place", "person_id")
    ends = lines.groupBy("work_id").agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    me = F.struct("place", "person_id")
    position = F.when(me == F.col("_first"), "first").when(me == F.col("_last"), "last").otherwise("middle")
    return (
        lines.join(ends, "work_id")
        .withColumn("position", position)
        .withColumn("first_author", F.when(F.col("position") == "last", F.col("_first.person_id")))
        .withColumn("first_author", F.when(F.col("first_author") != F.col("person_id"), F.col("first_author")))
        .select("work_id", "person_id", "position", "first_author")
    )


def works_of(people: DataFrame, works: DataFrame, authorships: DataFrame) -> DataFrame:
    """One row per tracked person and work, blank titles out.

    Works come first: when they are a date window, its filter also thins `authorships` out, and only the
    window's rows are dealt out by person.
    """
    titled = works.where(F.length(F.trim("title")) > 0)
    # An inner join with distinct people: a semi-join would be pushed below the join with the works and deal out all authorships.
    return authorships.join(titled, "work_id").join(people.select("person_id").distinct(), "person_id").select(
        "work_id", *[c for c in authorships.columns if c != "work_id"], *[c for c in works.columns if c != "work_id"]
    )


def works_at(works: DataFrame, work_institutions: DataFrame, institutions: DataFrame) -> DataFrame:
    """Works with any author at a tracked institution or one of its predecessors."""
    tracked = institutions.select(
        F.explode(F.array_compact(F.concat(F.array("institution_id"), F.coalesce("extra_ids", F.array())))).alias("institution_id")
    ).distinct()
    # The works' own filter, such as a date window, is applied before anything is dealt out by institution.
    near = work_institutions.join(works.select("work_id"), "work_id", "left_semi")
    hits = near.join(tracked, "institution_id", "left_semi").select("work_id")
    return works.join(hits, "work_id", "left_semi")


def newest_first() -> list[Column]:
    """Publication order: date, else the end of the year's line, newest first; the id settles ties."""
    shown = F.coalesce(
        F.col("date").cast("string"), F.concat(F.coalesce(F.col("year"), F.lit(0)).cast("string"), F.lit("-00-00"))
    )
    return [shown.desc(), F.col("work_id").asc()]


def recent_works(pubs: DataFrame, as_of: dt.date, n: int = V.MAX_RECENT) -> DataFrame:
    """The newest `n` titled works of every person, none after `as_of`, with `recency` 1..n."""
    known = pubs.where((F.length(F.trim("title")) > 0) & (F.col("date").isNull() | (F.col("date") <= F.lit(as_of))))
    return top_per_group(known, ["person_id"], newest_first(), n, "recency")


def merge_publications(old: DataFrame, new: DataFrame, n: int = V.MAX_RECENT) -> DataFrame:
    """Union by work id (else title); the stored row wins and its gaps are filled, newest `n` stay.

    Both sides carry person_id, work_id, title, year, date and any of the fill
    columns. One aggregate with map-side combine: no group is collected.
    """
    fill = [c for c in ("position", "first_author", "funders", "affiliations", "keywords") if c in old.columns]
    rows = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    rows = rows.where(F.length(F.trim("title")) > 0).withColumn(
        "_key", F.coalesce(F.col("work_id").cast("string"), F.lower("title"))
    )
    order = F.struct("_src", F.coalesce(F.col("date").cast("string"), F.lit("")), F.col("title"))
    whole = F.min_by(F.struct("work_id", "title", "year", "date"), order).alias("_row")
    filled = [
        F.min_by(F.col(c), F.when(_present(rows, c), order)).alias(c)
        for c in fill
    ]
    merged = rows.groupBy("person_id", "_key").agg(whole, *filled).select("person_id", "_row.*", *fill)
    return top_per_group(merged, ["person_id"], newest_first(), n, "recency")


def _present(df: DataFrame, name: str) -> Column:
    if df.schema[name].dataType.typeName() == "array":
        return F.size(name) > 0
    return F.col(name).isNotNull()


def added_publications(old: DataFrame, new: DataFrame) -> DataFrame:
    """Publications in the new newest-works list that were not stored before (U4)."""
    return new.join(old.select("person_id", "work_id"), ["person_id", "work_id"], "left_anti")


def role_counts(recent: DataFrame) -> DataFrame:
    """First- and last-author papers among recent papers with a known position (A5)."""
    return recent.groupBy("person_id").agg(
        F.count_if(F.col("position") == "first").alias("first_author_recent"),
        F.count_if(F.col("position") == "last").alias("last_author_recent"),
        F.count("position").alias("recent_works"),
    )


def seniority(h_index: Column, works: Column, citations: Column, last: Column, known: Column) -> Column:
    """Score 0-100 from h-index, output, citations and, where known, last-author share."""
    zero = F.lit(0)
    parts = (
        0.4 * F.least(F.coalesce(h_index, zero) / 60, F.lit(1.0))
        + 0.25 * F.least(F.log10(F.coalesce(works, zero) + 1) / 3, F.lit(1.0))
        + 0.2 * F.least(F.log10(F.coalesce(citations, zero) + 1) / 5, F.lit(1.0))
    )
    known = F.coalesce(known, zero)
    with_share = (parts + 0.15 * (F.coalesce(last, zero) / F.greatest(known, F.lit(1)))) / 1.0
    return F.round(100 * F.when(known > 0, with_share).otherwise(parts / 0.85)).cast("int")


def with_seniority(people: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """People with role counts and `seniority_score`."""
    if roles is not None:
        people = people.join(roles, "person_id", "left").fillna(
            0, ["first_author_recent", "last_author_recent", "recent_works"]
        )
    return people.withColumn(
        "seniority_score",
        seniority(*[F.col(c) for c in ("h_index", "works_count", "citation_count", "last_author_recent", "recent_works")]),
    )


def lab_sizes(recent: DataFrame) -> DataFrame:
    """Distinct first authors on a person's last-author papers and the number of such papers.

    Both are absent when no first author is known.
    """
    last = F.col("position") == "last"
    out = recent.groupBy("person_id").agg(
        F.count_distinct(F.when(last, F.col("first_author"))).alias("lab_first_authors"),
        F.count_if(last).alias("lab_senior_papers"),
    )
    return out.where(F.col("lab_first_authors") > 0)


def work_funder_labels(work_funders: DataFrame, n: int | None = None, size: int | None = None) -> DataFrame:
    """Named funders of every work (A7); with `n` the first listed ones, with `size` names cut to it.

    work_funders(work_id, pos, funder)
    """
    named = work_funders.withColumn("funder", cut(F.trim("funder"), size)).where(F.col("funder") != "")
    return named if n is None else top_per_group(named, ["work_id"], [F.col("pos"), F.col("funder")], n)


def top_funders(recent: DataFrame, work_funders: DataFrame, n: int = 3) -> DataFrame:
    """The funders named on most of a person's recent papers, `funder_rank` 1..n."""
    counts = recent.join(work_funders, "work_id").groupBy("person_id", "funder").agg(F.count("*").alias("papers"))
    return top_per_group(counts, ["person_id"], [F.col("papers").desc(), F.col("funder").asc()], n, "funder_rank")


def lab_signals(recent: DataFrame, work_funders: DataFrame) -> DataFrame:
    """Lab sizes and `recent_funders` (at most three, best first) per person."""
    funders = (
        top_funders(recent, work_funders)
        .groupBy("person_id")
        .agg(F.array_sort(F.collect_list(F.struct("funder_rank", "funder"))).alias("_f"))
        .select("person_id", F.col("_f.funder").alias("recent_funders"))
    )
    return lab_sizes(recent).join(funders, "person_id", "full")


def merge_lab_signals(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keep the larger lab with its paper count; new funders first, distinct, at most three."""
    n = new.select(
        "person_id",
        F.col("lab_first_authors").alias("_n"),
        F.col("lab_senior_papers").alias("_p"),
        F.col("recent_funders").alias("_f"),
    )
    wins = F.col("_n").isNotNull() & (F.col("_n") >= F.coalesce("lab_first_authors", F.lit(0)))
    empty = F.array().cast("array<string>")
    funders = F.slice(
        F.array_distinct(F.concat(F.coalesce("_f", empty), F.coalesce("recent_funders", empty))), 1, 3
    )
    return old.join(n, "person_id", "full").select(
        *[c for c in old.columns if c not in ("lab_first_authors", "lab_senior_papers", "recent_funders")],
        F.when(wins, F.col("_n")).otherwise(F.col("lab_first_authors")).alias("lab_first_authors"),
        F.when(wins, F.col("_p")).otherwise(F.col("lab_senior_papers")).alias("lab_senior_papers"),
        F.when(F.size(funders) > 0, funders).alias("recent_funders"),
    )


def output_counts(year_counts: DataFrame, as_of: dt.date) -> DataFrame:
    """Works in the three full years before `as_of`, the three before those, and the last active year (A3, A4)."""
    back = F.lit(as_of.year) - F.col("year")
    works = F.coalesce("works", F.lit(0))
    return year_counts.groupBy("person_id").agg(
        F.sum(F.when(back.between(1, 3), works).otherwise(0)).alias("works_recent_3y"),
        F.sum(F.when(back.between(4, 6), works).otherwise(0)).alias("works_prior_3y"),
        F.max(F.when(works > 0, F.col("year"))).alias("last_publication_year"),
    )


def with_trend(df: DataFrame, recent: str = "works_recent_3y", prior: str = "works_prior_3y") -> DataFrame:
    """`output_trend`, null-safe lab columns and whether there is anything to show (F8)."""
    r, p = F.col(recent), F.col(prior)
    out = df.withColumn(
        "output_trend",
        F.when(r.isNull() | p.isNull(), F.lit(None).cast("string"))
        .when((r >= 3) & (r >= p * 1.25), "rising")
        .when((p >= 3) & (r <= p * 0.6), "declining")
        .otherwise("steady"),
    )
    shown = F.coalesce(r + p > 0, F.lit(False))
    if "lab_first_authors" in df.columns:
        has_lab = F.col("lab_first_authors").isNotNull() & (F.coalesce("lab_senior_papers", F.lit(0)) > 0)
        for c in ("lab_first_authors", "lab_senior_papers"):
            out = out.withColumn(f"shown_{c}", F.when(has_lab, F.col(c)))
        shown = shown | has_lab
    if "recent_funders" in df.columns:
        shown = shown | (F.coalesce(F.size("recent_funders"), F.lit(0)) > 0)
    return out.withColumn("has_lab_signals", shown)


def publication_arrays(recent: DataFrame, *extra: str) -> DataFrame:
    """Fold recent works (at most a handful per person) into one ordered `recent_publications` array."""
    fields = ["work_id", "title", "year", "date", "position", *extra]
    return (
        recent.groupBy("person_id")
        .agg(F.array_sort(F.collect_list(F.struct("recency", *fields))).alias("_p"))
        .select("person_id", F.transform("_p", lambda p: p.dropFields("recency")).alias("recent_publications"))
    )
