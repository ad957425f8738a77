"""Readers (S1-S7, S14, S15). All schemas are explicit: nothing is inferred from data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import top_per_group
from ..functions.text import blank_to_null, clean_label, cut, short_id
from ..operators.people import join_institutions, to_catalog
from . import versions

AUTHOR_SCHEMA = """
id string, display_name string, orcid string, works_count int, cited_by_count long,
summary_stats struct<h_index:int>,
last_known_institutions array<struct<id:string,display_name:string>>,
topics array<struct<display_name:string,count:double,subfield:struct<display_name:string>,field:struct<display_name:string>>>,
counts_by_year array<struct<year:int,works_count:int>>
"""
WORK_SCHEMA = """
id string, title string, display_name string, publication_year int, publication_date date,
authorships array<struct<author:struct<id:string>,author_position:string,institutions:array<struct<id:string>>,raw_affiliation_strings:array<string>>>,
funders array<struct<display_name:string>>,
keywords array<struct<display_name:string,score:double>>
"""
TOPIC_SCHEMA = "id string, display_name string, keywords array<string>, subfield struct<display_name:string>"
CONTACT_SCHEMA = """
orcid string,
person struct<emails:struct<email:array<struct<email:string>>>,`researcher-urls`:struct<`researcher-url`:array<struct<url:struct<value:string>>>>>,
`activities-summary` struct<employments:struct<`affiliation-group`:array<struct<summaries:array<struct<`employment-summary`:struct<
  `role-title`:string,`department-name`:string,`start-date`:struct<year:struct<value:string>>,`end-date`:struct<year:struct<value:string>>,
  organization:struct<name:string,`disambiguated-organization`:struct<`disambiguated-organization-identifier`:string,`disambiguation-source`:string>>>>>>>>>
"""


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON or Parquet with a fixed schema; fields the files lack come back null."""
    fmt = "parquet" if ".parquet" in path else "json"
    return spark.read.schema(schema).format(fmt).load(path)


def read_authors(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Nested author records as flat tables.

    -> authors, author_topics, year_counts, author_institutions. Each is its own
    plan over the files, so only the columns it needs are read.
    """
    raw = _read(spark, path, AUTHOR_SCHEMA).withColumn("person_id", short_id(F.col("id")))
    topics = raw.select("person_id", F.explode("topics").alias("t")).select(
        "person_id",
        F.col("t.display_name").alias("topic"),
        F.col("t.subfield.display_name").alias("subfield"),
        F.col("t.field.display_name").alias("field"),
        F.coalesce("t.count", F.lit(0.0)).alias("n"),
    )
    return {
        "authors": raw.select(
            "person_id", F.col("display_name").alias("name"), "orcid", "works_count",
            F.col("cited_by_count").alias("citation_count"), F.col("summary_stats.h_index").alias("h_index"),
        ),
        "author_topics": topics,
        "year_counts": raw.select("person_id", F.explode("counts_by_year").alias("y")).select(
            "person_id", "y.year", F.col("y.works_count").alias("works")
        ),
        "author_institutions": raw.select("person_id", F.posexplode("last_known_institutions").alias("pos", "i")).select(
            "person_id", "pos", short_id(F.col("i.id")).alias("institution_id"), F.col("i.display_name").alias("institution_name")
        ),
    }


def read_works(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Works with authorships, funders and keywords as flat tables (S2). Missing optional fields are null.

    -> works, authorships, work_institutions, work_affiliations, work_funders, work_keywords
    """
    raw = _read(spark, path, WORK_SCHEMA).withColumn("work_id", short_id(F.col("id")))
    authors = raw.select("work_id", "authorships", F.posexplode("authorships").alias("place", "a"))
    person = short_id(F.col("a.author.id"))
    firsts = F.filter("authorships", lambda x: x["author_position"] == "first")
    first = short_id(F.get(firsts, F.lit(0))["author"]["id"])
    position = F.col("a.author_position")
    return {
        "works": raw.select(
            "work_id",
            F.trim(F.coalesce(blank_to_null(F.col("title")), F.col("display_name"), F.lit(""))).alias("title"),
            F.col("publication_year").alias("year"),
            F.col("publication_date").alias("date"),
        ),
        "authorships": authors.select(
            "work_id", person.alias("person_id"), position.alias("position"),
            F.when((position == "last") & (first != person), first).alias("first_author"),
        ).where("person_id IS NOT NULL"),
        "work_institutions": authors.select("work_id", F.explode("a.institutions").alias("i")).select(
            "work_id", short_id(F.col("i.id")).alias("institution_id")
        ),
        "work_affiliations": authors.select("work_id", person.alias("person_id"), F.posexplode("a.raw_affiliation_strings").alias("pos", "text")),
        "work_funders": raw.select("work_id", F.posexplode("funders").alias("pos", "f")).select(
            "work_id", "pos", F.col("f.display_name").alias("funder")
        ),
        "work_keywords": raw.select("work_id", F.explode("keywords").alias("k")).select(
            "work_id", F.col("k.display_name").alias("keyword"), F.col("k.score").alias("score")
        ),
    }


def read_topics(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """Topic list: subfield and cleaned keywords of every topic, all of them or the first `n` (S3)."""
    raw = _read(spark, path, TOPIC_SCHEMA)
    keywords = F.filter(F.transform("keywords", lambda k: clean_label(k)), lambda k: k != "")
    keywords = F.coalesce(keywords, F.array().cast("array<string>"))
    return raw.select(
        clean_label(F.col("display_name")).alias("topic"), F.col("subfield.display_name").alias("subfield"),
        (keywords if n is None else F.slice(keywords, 1, n)).alias("keywords"),
    ).where("topic <> ''")


def read_contact_records(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Public contact records: addresses, links and jobs.

    -> contact_emails, contact_urls, employments; `current` jobs have no end
    date, and a registry id counts only when it comes from that registry.
    """
    raw = _read(spark, path, CONTACT_SCHEMA).withColumn("orcid", short_id(F.col("orcid")))
    groups = raw.select("orcid", F.explode("activities-summary.employments.affiliation-group").alias("g"))
    jobs = groups.select("orcid", F.explode("g.summaries").alias("s")).select("orcid", F.col("s.employment-summary").alias("e"))
    registry = F.col("e.organization.disambiguated-organization")
    return {
        "contact_emails": raw.select("orcid", F.posexplode("person.emails.email").alias("pos", "e"))
        .select("orcid", "pos", F.lower("e.email").alias("email"))
        .where(F.length("email") > 0),
        "contact_urls": raw.select("orcid", F.posexplode("person.researcher-urls.researcher-url").alias("pos", "u"))
        .select("orcid", "pos", F.trim("u.url.value").alias("url"))
        .where(F.col("url").startswith("http")),
        "employments": jobs.select(
            "orcid",
            F.col("e.organization.name").alias("org"),
            F.when(registry["disambiguation-source"] == "ROR", registry["disambiguated-organization-identifier"]).alias("ror"),
            blank_to_null(F.trim("e.role-title")).alias("role"),
            blank_to_null(F.trim("e.department-name")).alias("department"),
            F.expr("try_cast(e.`start-date`.year.value AS int)").alias("start"),
            F.col("e.end-date").isNull().alias("current"),
        ),
    }


def affiliation_strings(texts: DataFrame, n: int | None = None, size: int | None = None) -> DataFrame:
    """Distinct affiliation strings with an address per person (S5); with `size` cut to it, with `n` the first so many.

    texts(person_id, pos, text)
    """
    trimmed = texts.where(F.col("text").contains("@")).withColumn("text", cut(F.trim("text"), size))
    first = trimmed.groupBy("person_id", "text").agg(F.min("pos").alias("pos"))
    return first if n is None else top_per_group(first, ["person_id"], [F.col("pos"), F.col("text")], n)


def stored_exists(spark: SparkSession, root: str, name: str) -> bool:
    return versions.holds(spark, root, name) or _exists(spark, f"{root}/{name}")


def read_stored(spark: SparkSession, root: str, name: str, institutions: Sequence | None = None) -> DataFrame:
    """A table of a build: as its manifest has it, or from a plain folder where there is none."""
    if versions.holds(spark, root, name):
        manifest = versions.current(spark, root)
        by_institution = "" not in manifest.tables[name]
        parts = [f"i{x}" for x in institutions] if institutions is not None and by_institution else None
        return _pruned(versions.read_table(spark, root, name, parts, manifest=manifest), institutions)
    return _pruned(spark.read.parquet(f"{root}/{name}"), institutions)


def read_records(spark: SparkSession, root: str, institutions: Sequence | None = None) -> DataFrame:
    """Records of an earlier build; only the files of `institutions` when given (S6, S15). A build of nobody is empty."""
    return read_stored(spark, root, "records", institutions)


def read_catalog(spark: SparkSession, root: str, institutions: Sequence | None = None) -> DataFrame:
    """Slim rows with institution columns; derived from the records when no catalog was written.

    Without `institutions` the (possibly truncated) global catalog is read, with
    them the per-institution rows.
    """
    inst = read_stored(spark, root, "institutions")
    if stored_exists(spark, root, "catalog"):
        by_institution = institutions is not None and stored_exists(spark, root, "catalog_by_institution")
        rows = read_stored(spark, root, "catalog_by_institution" if by_institution else "catalog", institutions)
    else:
        rows = to_catalog(read_records(spark, root, institutions))
    return join_institutions(rows, inst)


def read_vectors(
    spark: SparkSession, root: str, institutions: Sequence | None = None, clusters: Sequence[int] | None = None
) -> DataFrame:
    """The vector index, pruned to clusters or institutions; flat vectors when no index was written."""
    path = f"{root}/vectors" if _exists(spark, f"{root}/vectors") else f"{root}/embeddings"
    df = _pruned(spark.read.parquet(path), institutions)
    return df if clusters is None else df.where(F.col("cluster").isin(list(clusters)))


# Folders are named after the institution with a letter in front, so that no id of digits is read back as a number; the id
# itself is a column of the files.
PART = "institution_part"


def part_name(institution: Column) -> Column:
    return F.concat(F.lit("i"), institution.cast("string"))


def _pruned(df: DataFrame, institutions: Sequence | None) -> DataFrame:
    if institutions is not None:
        df = df.where(F.col("institution_id").isin(list(institutions)))
        if PART in df.columns:
            df = df.where(F.col(PART).isin([f"i{x}" for x in institutions]))
    return df.drop(PART)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
