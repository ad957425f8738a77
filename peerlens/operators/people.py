"""Selecting, ordering and publishing people.

Tables: authors(person_id, name, orcid, works_count, citation_count, h_index,
institution_id), year_counts(person_id, year, works), institutions(
institution_id, institution_name, country_code, rank, homepage_url, extra_ids).
Records add title, email, profile_url, profile_source, primary_domain,
domain_weights, recent_publications and signals. Ties in every order are
settled by person_id.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.ranking import top_per_group, with_row_number, with_running_sum
from ..functions.text import given
from .topics import with_domain_names

THIRD_PARTY_PROFILES = ["orcid", "openalex"]


# --- selection ------------------------------------------------------------------------------

def select_people(
    authors: DataFrame,
    year_counts: DataFrame,
    as_of: dt.date,
    min_works: int = 20,
    min_citations: int = 500,
    min_h_index: int = 10,
    window_years: int = 10,
) -> DataFrame:
    """People above the thresholds with a work in the last `window_years`."""
    zero = F.lit(0)
    active = year_counts.where((F.col("year") >= as_of.year - window_years) & (F.col("works") > 0))
    return authors.where(
        (F.coalesce("works_count", zero) >= min_works)
        & (F.coalesce("citation_count", zero) >= min_citations)
        & (F.coalesce("h_index", zero) >= min_h_index)
    ).join(active.select("person_id"), "person_id", "left_semi")


def _most_cited() -> list[Column]:
    return [F.coalesce("citation_count", F.lit(0)).desc(), F.col("person_id").asc()]


def top_people(people: DataFrame, n: int | None, key: str = "institution_id") -> DataFrame:
    """The `n` most cited people of every institution (W1); everyone with None."""
    return people if n is None else top_per_group(people, [key], _most_cited(), n)


def pool_institutions(people: DataFrame, aliases: DataFrame, n: int | None) -> DataFrame:
    """People of an institution and of its predecessors in one list, each once, `n` most cited or everyone.

    aliases(institution_id, extra_id): people filed under `extra_id` count for `institution_id`.
    """
    renamed = aliases.select(F.col("extra_id").alias("institution_id"), F.col("institution_id").alias("_home"))
    pooled = people.join(renamed, "institution_id", "left").withColumn(
        "institution_id", F.coalesce("_home", "institution_id")
    ).drop("_home")
    return top_people(one_row(pooled, "person_id", "institution_id"), n)


def one_row(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each key, chosen by a hash of its values, so that the choice does not depend on their order."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    values = F.to_json(whole)  # hashes take no maps, and a hash alone may tie
    return rows.groupBy(*keys).agg(F.min_by(whole, F.struct(F.xxhash64(values), values)).alias("_row")).select("_row.*")


def dedupe_people(records: DataFrame) -> DataFrame:
    """One record per person, the one at the better-ranked institution."""
    return top_per_group(
        records, ["person_id"], [F.coalesce("rank", F.lit(999)).asc(), F.col("institution_id").asc()], 1
    )


def tier_lookup(requests: DataFrame, tiers: Sequence[dict]) -> DataFrame:
    """Largest tier not above the requested size, else the first tier.

    requests(request_id, size); `tiers` is a short settings list of dicts with
    `per_institution`, so it becomes one literal per output column.
    """
    ladder = sorted(tiers, key=lambda t: t["per_institution"], reverse=True)
    out = requests
    for name in ladder[-1]:
        chosen = F.lit(ladder[-1][name])
        for tier in reversed(ladder[:-1]):
            chosen = F.when(F.col("size") >= tier["per_institution"], tier[name]).otherwise(chosen)
        out = out.withColumn(name, chosen)
    return out


# --- contact flags and verification ------------------------------------------------------------

def institutional_profile() -> Column:
    """A profile link that is the institution's own."""
    return given("profile_url") & ~F.coalesce(F.col("profile_source").isin(THIRD_PARTY_PROFILES), F.lit(False))


def with_contact_flags(df: DataFrame) -> DataFrame:
    """`flags`: what is missing from the contact details."""
    flags = F.array_compact(
        F.array(
            F.when(~given("email"), "missing_email"),
            F.when(~given("profile_url"), "missing_profile_url").when(
                ~institutional_profile(), "profile_not_institutional"
            ),
            F.when(~given("title"), "missing_title"),
        )
    )
    return df.withColumn("flags", flags)


def with_verification(df: DataFrame) -> DataFrame:
    """Whether there is a vetted address, an institutional profile, and both."""
    return (
        df.withColumn("has_email", given("email"))
        .withColumn("has_profile", institutional_profile())
        .withColumn("verified", F.col("has_email") & F.col("has_profile"))
    )


def require_contact(df: DataFrame) -> DataFrame:
    """People with an address or an institutional profile."""
    return df.where(
        given("email")
        | (given("profile_url") & ~F.array_contains("flags", "profile_not_institutional"))
    )


def with_role_flags(df: DataFrame) -> DataFrame:
    """`likely_lead` from the seniority score (P6), and whether authorship says anything."""
    known = F.coalesce("first_author_recent", F.lit(0)) + F.coalesce("last_author_recent", F.lit(0))
    return df.withColumn(
        "likely_lead", F.coalesce(F.col("seniority_score") >= V.LEAD_THRESHOLD, F.lit(False))
    ).withColumn("has_authorship", known > 0)


# --- orders --------------------------------------------------------------------------------------

def importance() -> list[Column]:
    """Likely leads and well cited people first."""
    return [
        F.coalesce("seniority_score", F.lit(0)).desc(),
        F.coalesce("citation_count", F.lit(0)).desc(),
        F.col("person_id").asc(),
    ]


def publish_order(records: DataFrame) -> DataFrame:
    """Both contacts, then address, then profile, then institution rank and citations (K4)."""
    profile, email = institutional_profile(), given("email")
    return records.orderBy(
        (email & profile).desc(), email.desc(), profile.desc(), F.col("rank").asc_nulls_last(), *_most_cited()
    )


def catalog_order(mode: str, df: DataFrame) -> list[Column]:
    """Sort keys of the five catalog orders (K1-K3)."""
    cited = F.coalesce("citation_count", F.lit(0)).desc()
    tail = [cited, F.col("person_id").asc()]
    if mode == "pi":
        return [F.col("seniority_score").desc_nulls_last(), *tail]
    if mode == "rank":
        return [F.coalesce("rank", F.lit(999)).asc(), *tail]
    if mode == "name":
        return [F.coalesce("name", F.lit("")).asc(), F.col("person_id").asc()]
    if mode == "relevance":
        has = set(df.columns)
        if "concepts_matched" in has:
            concept = F.coalesce("concept_score", F.lit(0.0))
            blend = 0.5 * concept + 0.5 * F.coalesce("match_score", F.lit(0.0)) if "match_score" in has else concept
            return [F.coalesce("concepts_matched", F.lit(0)).desc(), blend.desc(), *tail]
        if "match_score" in has:
            return [F.coalesce("match_score", F.lit(0.0)).desc(), *tail]
        if {"tier", "first_pos"} <= has:  # from concepts.keyword_search
            return [F.col("tier").asc_nulls_last(), F.col("first_pos").asc(), F.col("person_id").asc()]
    return tail


def order_catalog(df: DataFrame, mode: str = "pi") -> DataFrame:
    """The catalog in one of the orders pi, relevance, citations, rank, name (K1-K3)."""
    return df.orderBy(*catalog_order(mode, df))


def page(df: DataFrame, number: int, size: int = 24, mode: str = "pi") -> DataFrame:
    """One page of results (K6)."""
    return order_catalog(df, mode).offset(number * size).limit(size)


def truncate_catalog(df: DataFrame, n: int) -> DataFrame:
    """The `n` most important people (K5).

    A short list is a top-k per task; a long one is numbered over range
    partitions (cuts a checkpoint), since a limit gathers its rows in one task.
    """
    if n <= 10_000:
        return df.orderBy(*importance()).limit(n)
    return with_row_number(df, importance(), "_n").where(F.col("_n") <= n).drop("_n")


def catalog_completeness(df: DataFrame, n: int | None) -> DataFrame:
    """Rows kept and whether the truncated catalog is complete (K5)."""
    total = F.count("*")
    kept = total if n is None else F.least(total, F.lit(n))
    return df.agg(total.alias("people"), kept.alias("catalog_rows"), (total == kept).alias("catalog_complete"))


# --- publishing ------------------------------------------------------------------------------------

def record_chunks(records: DataFrame, size: int = V.RECORD_CHUNK) -> DataFrame:
    """`record_chunk`: importance position within the institution, `size` people per chunk.

    Cuts a checkpoint; an institution of any size spans many tasks.
    """
    numbered = with_row_number(records, importance(), "_n", keys=["institution_id"])
    return numbered.withColumn("record_chunk", F.floor((F.col("_n") - 1) / size).cast("int")).drop("_n")


def estimated_bytes(records: DataFrame, vector_format: str = "bits") -> DataFrame:
    """Bytes one person costs: full record, slim row and vector."""
    record = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in records.columns])))
    slim = [c for c in CATALOG_FIELDS if c in records.columns]
    row = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in slim])))
    return records.withColumn("bytes", (record + row + V.VECTOR_BYTES[vector_format]).cast("long"))


def prune_to_budget(records: DataFrame, budget: int | None, cost: str = "bytes") -> DataFrame:
    """Drop the least important people until the total fits `budget` (W6). Cuts a checkpoint."""
    if budget is None:
        return records
    running = with_running_sum(records, importance(), cost, "_running")
    return running.where(F.col("_running") <= budget).drop("_running", "_pos")


def pick_scope(institutions: DataFrame, cap: int = V.FILTER_SCOPE_ROWS, people: str = "people") -> DataFrame:
    """Best-ranked institutions until the cap would be passed; the first is always taken.

    Counts are not negative, so once the running sum passes the cap it stays
    above it and nothing later is taken. Cuts a checkpoint.
    """
    counted = institutions.withColumn("_people", F.coalesce(people, F.lit(0)))
    order = [F.coalesce("rank", F.lit(999)).asc(), F.col("institution_id").asc()]
    running = with_running_sum(counted, order, "_people", "running_people", "scope_rank")
    return running.where((F.col("running_people") <= cap) | (F.col("scope_rank") == 1)).drop("_people")


CATALOG_FIELDS = [
    "person_id", "name", "title", "institution_id", "primary_domain", "domains", "citation_count", "email",
    "profile_url", "has_email", "seniority_score", "first_author_recent", "last_author_recent", "recent_works",
    "last_publication_year", "record_chunk", "tags",
]


def to_catalog(records: DataFrame) -> DataFrame:
    """Slim row per person."""
    if "domains" not in records.columns:
        records = with_domain_names(records)
    records = records.withColumn("has_email", given("email")).withColumn(
        "citation_count", F.coalesce("citation_count", F.lit(0))
    )
    return records.select(*[c for c in CATALOG_FIELDS if c in records.columns])


def strip_transient(records: DataFrame, fields: Sequence[str] = ("first_author", "affiliations", "funders", "keywords")) -> DataFrame:
    """Publications without their working fields."""
    present = records.schema["recent_publications"].dataType.elementType.fieldNames()
    drop = [f for f in fields if f in present]
    if not drop:
        return records
    return records.withColumn("recent_publications", F.transform("recent_publications", lambda p: p.dropFields(*drop)))


def assemble_records(people: DataFrame, institutions: DataFrame, *parts: DataFrame) -> DataFrame:
    """One full record per person: every part is joined on person_id.

    Parts hold one row per person (domains, contacts, works, roles, signals,
    tags), so each join keeps the row count.
    """
    out = people
    for part in parts:
        out = out.join(part, "person_id", "left")
    return out.join(institutions.select("institution_id", "institution_name", "country_code", "rank"), "institution_id", "left")


# --- catalog queries ----------------------------------------------------------------------------------

def filter_catalog(
    catalog: DataFrame,
    country: str | None = None,
    institution: str | None = None,
    domains: Sequence[str] = (),
    *hit_sets: DataFrame,
) -> DataFrame:
    """All given conditions together: country, institution, any of `domains`, in every hit set (P5)."""
    if country:
        catalog = catalog.where(F.col("country_code") == country)
    if institution:
        catalog = catalog.where(F.col("institution_name") == institution)
    if domains:
        catalog = catalog.where(F.arrays_overlap("domains", F.array(*[F.lit(d) for d in domains])))
    for hits in hit_sets:
        catalog = catalog.join(hits.select("person_id"), "person_id", "left_semi")
    return catalog


def join_institutions(catalog: DataFrame, institutions: DataFrame) -> DataFrame:
    """Institution columns looked up by id, with what the row itself carries as the fallback."""
    fields = ["institution_name", "country_code", "rank"]
    looked_up = institutions.select("institution_id", *[F.col(c).alias(f"_{c}") for c in fields])
    joined = catalog.join(looked_up, "institution_id", "left")
    for c in fields:
        joined = joined.withColumn(c, F.coalesce(f"_{c}", c) if c in catalog.columns else F.col(f"_{c}"))
    return joined.drop(*[f"_{c}" for c in fields])


def expand_records(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Full record over the slim row; a null in the record keeps the row's value."""
    renamed = records.select("person_id", *[F.col(c).alias(f"_full_{c}") for c in records.columns if c != "person_id"])
    joined = rows.join(renamed, "person_id", "left")
    columns = ["person_id"]
    for c in rows.columns:
        if c != "person_id":
            columns.append((F.coalesce(f"_full_{c}", c) if c in records.columns else F.col(c)).alias(c))
    columns += [F.col(f"_full_{c}").alias(c) for c in records.columns if c not in rows.columns]
    return joined.select(*columns)


def append_rows(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of people not listed yet are added (U3). Of several rows of a person the one with the smallest hash of its values is, in whatever order they come."""
    fresh = one_row(rows, "person_id").join(catalog.select("person_id"), "person_id", "left_anti")
    return catalog.unionByName(fresh, allowMissingColumns=True)


def missing_matches(matches: DataFrame, catalog: DataFrame) -> DataFrame:
    """Institutions of matches whose row the truncated catalog lacks."""
    return (
        matches.join(catalog.select("person_id"), "person_id", "left_anti")
        .where(F.col("institution_id").isNotNull())
        .select("institution_id")
        .distinct()
    )


def coverage(records: DataFrame) -> DataFrame:
    """People, with address, verified: per institution and in all (null institution)."""
    flagged = with_verification(records)
    return flagged.rollup("institution_id").agg(
        F.count("*").alias("people"),
        F.count_if("has_email").alias("with_email"),
        F.count_if("verified").alias("verified"),
    )


