"""Research areas, tags, the tag vocabulary and facets.

Tables: author_topics(person_id, topic, subfield, field, n),
work_keywords(work_id, keyword, score), person_tags(person_id, pos, tag, kind).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.ranking import top_per_group, with_row_number
from ..functions.text import clean_label


def domain_weights(author_topics: DataFrame, top: int = V.MAX_DOMAINS, rounding=F.round) -> DataFrame:
    """Share of a person's topic mass per subfield, strongest `top`, rounded to 2 (A1).

    One row per person and subfield with `domain_rank`. The share is of the
    total over all subfields; weights that round to 0 are dropped.
    """
    per_subfield = (
        author_topics.where(F.length("subfield") > 0)
        .groupBy("person_id", "subfield")
        .agg(F.sum(F.coalesce("n", F.lit(0))).cast("double").alias("_count"))
    )
    totals = per_subfield.groupBy("person_id").agg(F.sum("_count").alias("_total")).where(F.col("_total") > 0)
    ranked = top_per_group(per_subfield, ["person_id"], [F.col("_count").desc(), F.col("subfield").asc()], top, "domain_rank")
    return (
        ranked.join(totals, "person_id")
        .withColumn("weight", rounding(F.col("_count") / F.col("_total"), 2))
        .where(F.col("weight") > 0)
        .select("person_id", "domain_rank", F.col("subfield").alias("domain"), "weight")
    )


def primary_domain(author_topics: DataFrame) -> DataFrame:
    """Field with the largest mass, the larger name on a tie; only people with subfield mass (A2)."""
    n = F.coalesce("n", F.lit(0))
    with_mass = (
        author_topics.groupBy("person_id")
        .agg(F.sum(F.when(F.length("subfield") > 0, n).otherwise(0)).alias("_m"))
        .where(F.col("_m") > 0)
    )
    fields = author_topics.where(F.length("field") > 0).groupBy("person_id", "field").agg(F.sum(n).cast("double").alias("_n"))
    best = fields.groupBy("person_id").agg(F.max_by("field", F.struct("_n", "field")).alias("primary_domain"))
    return best.join(with_mass.select("person_id"), "person_id", "left_semi")


def domain_arrays(weights: DataFrame, primary: DataFrame) -> DataFrame:
    """`primary_domain` and the ordered `domain_weights` array per person (at most `top` entries)."""
    arrays = (
        weights.groupBy("person_id")
        .agg(F.array_sort(F.collect_list(F.struct("domain_rank", F.col("domain").alias("name"), "weight"))).alias("_d"))
        .select("person_id", F.transform("_d", lambda d: d.dropFields("domain_rank")).alias("domain_weights"))
    )
    return primary.join(arrays, "person_id", "full")


def with_domain_names(df: DataFrame) -> DataFrame:
    """`domains`: names strongest first, the primary one in front when it is not among them (F16)."""
    ordered = F.array_sort(
        F.transform("domain_weights", lambda d, i: F.struct((-d["weight"]).alias("w"), i.alias("i"), d["name"].alias("n")))
    )
    names = F.coalesce(F.transform(ordered, lambda d: d["n"]), F.array().cast("array<string>"))
    primary = F.col("primary_domain")
    return df.withColumn(
        "domains",
        F.when(primary.isNotNull() & ~F.array_contains(names, F.coalesce(primary, F.lit(""))), F.array_prepend(names, primary)).otherwise(names),
    )


def topic_tags(author_topics: DataFrame, n: int = V.MAX_TOPIC_TAGS) -> DataFrame:
    """The strongest distinct topics of a person: count, then name."""
    named = author_topics.withColumn("tag", clean_label(F.col("topic"))).where(F.length("tag") > 0)
    best = named.groupBy("person_id", "tag").agg(F.max(F.coalesce("n", F.lit(0))).alias("_n"))
    return top_per_group(best, ["person_id"], [F.col("_n").desc(), F.col("tag").asc()], n, "tag_rank").select(
        "person_id", "tag_rank", "tag"
    )


def work_keywords(keywords: DataFrame, n: int | None = None, rounding=F.round, least: float = V.MIN_KEYWORD_SCORE) -> DataFrame:
    """A work's keywords worth keeping: score at least `least`, rounded to 2; all of them or the best `n` (A10)."""
    kept = keywords.withColumn("keyword", clean_label(F.col("keyword"))).where(
        (F.length("keyword") > 0) & (F.coalesce("score", F.lit(0.0)) >= least)
    )
    kept = kept.withColumn("score", rounding("score", 2))
    return kept if n is None else top_per_group(kept, ["work_id"], [F.col("score").desc(), F.col("keyword").asc()], n)


def keyword_tags(recent: DataFrame, keywords: DataFrame, topics: DataFrame, n: int = V.MAX_KEYWORD_TAGS) -> DataFrame:
    """Keywords over a person's recent papers by summed score, topic names left out."""
    mine = recent.join(keywords.select("work_id", "keyword", "score"), "work_id").withColumn("_key", F.lower("keyword"))
    named = topics.select("person_id", F.lower("tag").alias("_key"))
    totals = (
        mine.join(named, ["person_id", "_key"], "left_anti")
        .groupBy("person_id", "_key")
        .agg(
            F.round(F.sum("score"), 6).alias("_total"),
            F.min_by("keyword", F.struct("recency", -F.col("score"), "keyword")).alias("tag"),
        )
    )
    return top_per_group(totals, ["person_id"], [F.col("_total").desc(), F.col("_key").asc()], n, "tag_rank").select(
        "person_id", "tag_rank", "tag"
    )


def person_tags(topics: DataFrame, keywords: DataFrame, n: int = V.MAX_TAGS) -> DataFrame:
    """Topics, then keywords, first of a case-insensitive pair, at most `n`; `pos` from 0."""
    both = topics.select("person_id", F.lit(0).alias("_k"), "tag_rank", "tag").unionByName(
        keywords.select("person_id", F.lit(1).alias("_k"), "tag_rank", "tag")
    )
    place = F.struct("_k", "tag_rank")
    distinct = (
        both.groupBy("person_id", F.lower("tag").alias("_key"))
        .agg(F.min_by("tag", place).alias("tag"), F.min(place).alias("_place"))
    )
    return top_per_group(distinct, ["person_id"], [F.col("_place"), F.col("_key")], n, "_pos").select(
        "person_id",
        (F.col("_pos") - 1).alias("pos"),
        "tag",
        F.when(F.col("_place._k") == 0, "t").otherwise("k").alias("kind"),
    )


def keep_stored_tags(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh tags for people who have any, stored ones for everyone else."""
    return fresh.unionByName(old.join(fresh.select("person_id").distinct(), "person_id", "left_anti"))


def tag_counts(tags: DataFrame) -> DataFrame:
    """People per tag and its kind: a topic anywhere makes it a topic (A13). A person holds a tag once."""
    return tags.groupBy("tag").agg(F.count("*").alias("people"), F.max("kind").alias("kind"))


def tag_vocabulary(tags: DataFrame) -> DataFrame:
    """Tags with a dense id from 0: most people first, then name (A13). Cuts a checkpoint."""
    numbered = with_row_number(tag_counts(tags), [F.col("people").desc(), F.col("tag").asc()], "_n")
    return numbered.select((F.col("_n") - 1).alias("tag_id"), "tag", "people", "kind")


def tag_synonyms(vocabulary: DataFrame, topics: DataFrame) -> DataFrame:
    """Subfield and topic keywords of every topic tag in the vocabulary.

    topics(topic, subfield, keywords array)
    """
    return vocabulary.where(F.col("kind") == "t").join(topics.withColumnRenamed("topic", "tag"), "tag").select(
        *[c for c in ("tag_id", "tag") if c in vocabulary.columns], "subfield", "keywords"
    )


def domain_list(records: DataFrame) -> DataFrame:
    """All research areas in use, alphabetical (A15). records(primary_domain, domain_weights or domains)."""
    names = F.col("domains") if "domains" in records.columns else F.col("domain_weights.name")
    every = F.array_compact(F.concat(F.coalesce(names, F.array().cast("array<string>")), F.array("primary_domain")))
    return records.select(F.explode(F.array_distinct(every)).alias("domain")).distinct().orderBy("domain")


def facets(
    catalog: DataFrame,
    domains: DataFrame | None = None,
    published: DataFrame | None = None,
    country: str | None = None,
) -> DataFrame:
    """Country, institution and domain counts in one scan and one shuffle.

    -> facet(kind, value, country_code, rank, people). `domains(domain)` adds
    zero-count areas. `published(institution_name, country_code, rank, people)`
    are totals of a truncated catalog: they replace the counts of the institutions they list. `country`
    narrows the institution list after counting.
    """
    empty = F.array().cast("array<string>")
    hidden = F.lit(False)
    if published is not None:
        listed = published.where(F.coalesce("people", F.lit(0)) > 0)
        catalog = catalog.join(
            listed.select("institution_name", F.lit(True).alias("_listed")), "institution_name", "left"
        )
        hidden = F.coalesce("_listed", F.lit(False))
    none_i = F.lit(None).cast("int")

    def entry(kind, value, code=None, rank=None):
        return F.struct(
            F.lit(kind).alias("kind"),
            value.alias("value"),
            (code if code is not None else F.lit(None).cast("string")).alias("country_code"),
            (rank if rank is not None else none_i).alias("rank"),
        )

    entries = F.concat(
        F.array(
            F.when(~hidden & F.col("country_code").isNotNull(), entry("country", F.col("country_code"))),
            F.when(
                ~hidden & F.col("institution_name").isNotNull(),
                entry("institution", F.col("institution_name"), F.col("country_code"), F.col("rank").cast("int")),
            ),
        ),
        F.transform(F.array_distinct(F.coalesce("domains", empty)), lambda d: entry("domain", d)),
    )
    out = (
        catalog.select(F.explode(F.array_compact(entries)).alias("e"))
        .select("e.*")
        .groupBy("kind", "value", "country_code", "rank")
        .agg(F.count("*").alias("people"))
    )
    extra = []
    if published is not None:
        extra.append(
            listed.select(
                F.lit("institution").alias("kind"), F.col("institution_name").alias("value"), "country_code",
                F.col("rank").cast("int").alias("rank"), F.col("people").cast("long").alias("people"),
            )
        )
        extra.append(
            listed.where(F.col("country_code").isNotNull())
            .groupBy(F.col("country_code").alias("value"))
            .agg(F.sum("people").cast("long").alias("people"))
            .select(F.lit("country").alias("kind"), "value", F.lit(None).cast("string").alias("country_code"), none_i.alias("rank"), "people")
        )
    if domains is not None:
        extra.append(
            domains.select(
                F.lit("domain").alias("kind"), F.col("domain").alias("value"), F.lit(None).cast("string").alias("country_code"),
                none_i.alias("rank"), F.lit(0).cast("long").alias("people"),
            )
        )
    for e in extra:
        out = out.unionByName(e)
    if extra:
        out = out.groupBy("kind", "value", "country_code", "rank").agg(F.sum("people").alias("people"))
    if country is not None:
        out = out.where((F.col("kind") != "institution") | (F.col("country_code") == country))
    return out
