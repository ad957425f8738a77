"""Full build: one lazy graph from the input tables to records, then the published tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.ranking import cut_lineage, store
from ..operators import contacts as C
from ..operators import people as P
from ..operators import topics as T
from ..operators import works as W
from ..operators import vectors as X
from ..operators.profiles import with_person_text
from ..sources import versions, writers
from ..sources.keyword_index import put_keyword_index


@dataclass
class Inputs:
    """Input tables; `contacts` is one row per person, see operators.contacts.resolve_contacts."""

    authors: DataFrame
    institutions: DataFrame
    author_topics: DataFrame
    year_counts: DataFrame
    works: DataFrame
    authorships: DataFrame
    work_funders: DataFrame
    work_keywords: DataFrame
    contacts: DataFrame


@dataclass
class Limits:
    per_institution: int | None = None  # everyone who meets the other criteria, unless a shorter list is asked for
    min_works: int = 20
    min_citations: int = 500
    min_h_index: int = 10
    window_years: int = 10
    require_contact: bool = False
    size_budget: int | None = None
    catalog_rows: int | None = None  # everyone, unless a shorter list is asked for
    record_chunk: int = V.RECORD_CHUNK
    vector_format: str = "bits"


@dataclass
class Built:
    records: DataFrame
    publications: DataFrame
    tags: DataFrame
    extra: dict = field(default_factory=dict)  # before_pruning: people before the size budget cut


def build_records(inputs: Inputs, as_of: dt.date, limits: Limits | None = None) -> Built:
    """Select, describe, dedupe and prune people. Nothing is written.

    Selection comes first, so works, topics and contacts are only shuffled for people who stay.
    """
    limits = limits or Limits()
    chosen = P.select_people(
        inputs.authors, inputs.year_counts, as_of, limits.min_works, limits.min_citations, limits.min_h_index, limits.window_years
    )
    if "extra_ids" in inputs.institutions.columns:
        aliases = inputs.institutions.select("institution_id", F.explode("extra_ids").alias("extra_id"))
        chosen = P.pool_institutions(chosen, aliases, limits.per_institution)
    else:
        chosen = P.top_people(chosen, limits.per_institution)
    chosen = P.dedupe_people(P.join_institutions(chosen, inputs.institutions)).drop("institution_name", "country_code", "rank")
    # Read by every branch below: computed once.
    chosen = cut_lineage(chosen)
    ids = chosen.select("person_id")

    def of_chosen(df):
        return df.join(ids, "person_id", "left_semi")

    recent = cut_lineage(W.recent_works(W.works_of(chosen, inputs.works, inputs.authorships), as_of))
    own_topics = store(of_chosen(inputs.author_topics))  # read by six branches below
    topics = T.topic_tags(own_topics)
    recent_keywords = inputs.work_keywords.join(recent.select("work_id").distinct(), "work_id", "left_semi")
    tags = T.person_tags(topics, T.keyword_tags(recent, T.work_keywords(recent_keywords), topics))
    recent_funders = inputs.work_funders.join(recent.select("work_id").distinct(), "work_id", "left_semi")
    records = P.assemble_records(
        W.with_seniority(chosen, W.role_counts(recent)),
        inputs.institutions,
        T.domain_arrays(T.domain_weights(own_topics), T.primary_domain(own_topics)),
        inputs.contacts,
        W.lab_signals(recent, W.work_funder_labels(recent_funders)),
        W.output_counts(of_chosen(inputs.year_counts), as_of),
        W.publication_arrays(recent),
        tag_lists(tags),
    )
    records = C.with_role(P.with_contact_flags(T.with_domain_names(records)))
    if limits.require_contact:
        records = P.require_contact(records)
    records, extra = within_budget(records, limits)
    return Built(records, recent, tags, extra)


def within_budget(records: DataFrame, limits: Limits) -> tuple[DataFrame, dict]:
    """The most important people that fit the size budget, and how many there were before the cut."""
    if limits.size_budget is None:
        return records, {}
    sized = cut_lineage(P.estimated_bytes(records, limits.vector_format))
    return P.prune_to_budget(sized, limits.size_budget).drop("bytes"), {"before_pruning": sized.count()}


def tag_lists(tags: DataFrame) -> DataFrame:
    """Tags (at most eight per person) folded into one ordered array."""
    lists = tags.groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("_t"))
    return lists.select("person_id", F.col("_t.tag").alias("tags"))


def publish(
    built: Built, institutions: DataFrame, root: str, as_of: dt.datetime, limits: Limits | None = None, kind: str = "full",
    changed: Sequence | None = None, **stats,
) -> None:
    """Write records, catalog, vocabulary, domains, keyword index, institutions and the run's metadata under `root` as one version.

    Readers go by the manifest, which is written when all tables are there; until then, or if the job dies, they see the earlier build.
    With `changed`, `built` holds these institutions only: their files are written, those of the others stay as they are.
    The run is recorded last: a job that dies just before it scans the same window again, which changes nothing.
    """
    limits = limits or Limits()
    if kind == "full":
        stats = {"last_ingestion": as_of.date(), **stats}
    spark = built.records.sparkSession
    draft = versions.Draft(spark, root)
    tags = built.tags
    if changed is not None:
        kinds = draft.read("tags").select("tag", "kind").unionByName(tags.select("tag", "kind")).groupBy("tag").agg(F.min("kind").alias("kind"))
    writers.put_records(draft, built.records, limits.record_chunk, changed)
    records = draft.read("records")
    if changed is not None:
        tags = records.select("person_id", F.posexplode("tags").alias("pos", "tag")).join(kinds, "tag")
    counts = records.groupBy("institution_id").agg(F.count("*").alias("people"))
    draft.put("institutions", institutions.drop("people").join(counts, "institution_id", "left").fillna(0, ["people"]))
    complete = writers.put_catalog(draft, P.to_catalog(records), limits.catalog_rows, changed)
    draft.put("tags", T.tag_vocabulary(tags.join(records.select("person_id"), "person_id", "left_semi")))
    draft.put("domains", T.domain_list(records))
    put_keyword_index(draft, records, changed)
    totals = records.agg(F.count("*").alias("people"), F.count("email").alias("with_email"), F.count_distinct("institution_id").alias("n")).first()
    draft.commit()
    writers.write_run_metadata(
        spark, root, kind, as_of, last_cdc_run=as_of.date(), people=totals["people"],
        with_email=totals["with_email"], institutions=totals["n"], catalog_complete=complete,
        catalog_rows=totals["people"] if complete else limits.catalog_rows,
        pruned=built.extra.get("before_pruning", totals["people"]) - totals["people"],
        **stats,
        per_institution=limits.per_institution, window_years=limits.window_years,
    )


def publish_vectors(records: DataFrame, root: str, encoder=None, vector_format: str = "bits", k: int | None = None) -> None:
    """Embed everyone, train a tree of centroids, assign clusters, write the vector index."""
    embedded = X.embed_texts(with_person_text(records), "embedding_text", encoder).select("person_id", "institution_id", "vector")
    # Clusters come from the quantised rows, as readers see them; they are read several times.
    unit = cut_lineage(X.dequantize(X.quantize(embedded).drop("vector")))
    tree = cut_lineage(X.train_centroid_tree(unit, k))
    assigned = X.assign_in_tree(unit, tree)
    if vector_format == "bits":
        assigned = X.pack_bits(assigned).drop("q")
    writers.write_vector_index(assigned.drop("vector"), X.leaf_centroids(tree), root)
    tree.write.mode("overwrite").parquet(f"{root}/centroid_tree")  # for rows that come later
