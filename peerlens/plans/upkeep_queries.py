"""Queries on updates, quality checks, evaluation, sources and sinks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import cut_lineage, scratch_dir
from ..operators import concepts as K
from ..operators import encoding as E
from ..operators import evaluate as V
from ..operators import incremental as I
from ..operators import people as P
from ..operators import quality as Q
from ..operators import topics as T
from ..operators import vectors as X
from ..operators import works as W
from ..sources import readers, versions, writers
from ..sources.keyword_index import read_keyword_index
from ..sources.work_tables import open_window, write_work_tables
from ..streaming import recent_works as S
from .bindings import AS_OF, Tables
from .build import Inputs, Limits, build_records, publish
from .match_queries import label_centroids, label_profiles, people_vectors
from .people_queries import ROWS_SQL, catalog, records, scored
from .registry import query
from .update import Catalog, refresh_build, update_catalog, window_works
from .work_queries import tags_of

NOW = dt.datetime(2001, 8, 1, 12, 0)


# --- updates -----------------------------------------------------------------------------------------

def dated_runs(t: Tables) -> DataFrame:
    """Run marks per nation: a full build at the first order, an update at the last order of 2000."""
    d = F.to_date("o_orderdate")
    return t.raw("orders").agg(F.min(d).alias("last_ingestion"), F.max(F.when(F.year(d) < 2001, d)).alias("last_cdc_run"))


def update_window(t: Tables):
    return I.change_window(dated_runs(t), AS_OF, 30)


@query(
    "change_window", "C1 C4",
    """SELECT strftime(max(o_orderdate) - INTERVAL 30 DAY, '%Y-%m-%d') AS since, '2001-08-01' AS until, CAST((SELECT count(*) FROM orders WHERE o_orderdate >=
      (SELECT max(o_orderdate) - INTERVAL 30 DAY FROM orders WHERE year(o_orderdate) < 2001)) AS BIGINT) AS works FROM orders WHERE year(o_orderdate) < 2001""",
)
def _(t: Tables):
    since, until = update_window(t)
    changed = t.works.where(F.col("date").between(since, until))
    return changed.agg(F.lit(str(since)).alias("since"), F.lit(str(until)).alias("until"), F.count("*").alias("works"))


REFRESH_SQL = """, fresh AS (SELECT person_id, CASE WHEN person_id % 2 = 0 THEN cites + 7 END AS c, CASE WHEN person_id % 3 = 0 THEN h + 1 END AS h2 FROM people WHERE person_id % 5 <> 0)
"""


def fresh_people(t: Tables) -> DataFrame:
    k = F.col("person_id")
    return t.authors.where(k % 5 != 0).select(
        k, F.when(k % 2 == 0, F.col("citation_count") + 7).alias("citation_count"), F.when(k % 3 == 0, F.col("h_index") + 1).alias("h_index")
    )


@query("refreshed_people", "J10 C5", REFRESH_SQL + "SELECT person_id, coalesce(c, cites) AS citation_count, coalesce(h2, h) AS h_index, nworks AS works_count FROM people LEFT JOIN fresh USING (person_id)")
def _(t: Tables):
    return I.refresh_people(t.authors, fresh_people(t)).select("person_id", "citation_count", "h_index", "works_count")


@query(
    "refreshed_domains", "J10 C5",
    """, r AS (SELECT person_id, domain, domain_rank FROM dom WHERE weight > 0 AND (domain <> 'LARGE' OR person_id % 2 = 1))
    SELECT person_id, CASE WHEN person_id % 4 = 0 THEN 'old' ELSE (SELECT string_agg(domain, '|' ORDER BY domain_rank) FROM dom d WHERE d.person_id = p.person_id AND weight > 0) END AS domains,
      CASE WHEN person_id % 4 = 0 THEN 'kept' ELSE primary_domain END AS primary_domain FROM prim p""",
)
def _(t: Tables):
    fresh = T.domain_arrays(T.domain_weights(t.author_topics), T.primary_domain(t.author_topics))
    none = F.array().cast(fresh.schema["domain_weights"].dataType)
    fresh = fresh.withColumn("domain_weights", F.when(F.col("person_id") % 4 == 0, none).otherwise(F.col("domain_weights")))
    old = F.array(F.struct(F.lit("old").alias("name"), F.lit(1.0).alias("weight")))
    stored = fresh.select("person_id", F.lit("kept").alias("primary_domain"), old.alias("domain_weights"))
    out = I.refresh_people(stored, fresh)
    return out.select("person_id", F.array_join("domain_weights.name", "|").alias("domains"), "primary_domain")


# Institutions below 20 are the tracked ones, the rest stand for untracked: the update must leave their people and works
# alone. It is the split of the synthetic tables that the SQL of updated_publications, updated_records and
# update_statistics states, no bound of the operators.
def stored_state(t: Tables, since: dt.date) -> Catalog:
    old = W.recent_works(t.publications.where(F.col("date") < since), AS_OF)
    lab = W.lab_signals(old, W.work_funder_labels(t.work_funders))
    people = t.authors.where("institution_id < 20").join(lab, "person_id", "left")
    kept = old.join(people.select("person_id"), "person_id", "left_semi")
    return Catalog(people, cut_lineage(kept), tags_of(t, once=lambda rows: rows))


def run_update(t: Tables):
    since, until = update_window(t)
    homes = t.authorship_lines.join(t.authors.select("person_id", "institution_id"), "person_id").select("work_id", "institution_id")
    return update_catalog(
        stored_state(t, since), (since, until), t.institutions.where("institution_id < 20").withColumn("extra_ids", F.lit(None).cast("array<int>")),
        t.works, t.authorships, homes, fresh_people(t), W.work_funder_labels(t.work_funders),
    )


UPDATE_SQL = REFRESH_SQL + """, w AS (SELECT max(o_orderdate) - INTERVAL 30 DAY AS since FROM orders WHERE year(o_orderdate) < 2001),
tracked AS (SELECT person_id FROM people WHERE institution_id < 20),
tp AS (SELECT * FROM pubs WHERE person_id IN (SELECT person_id FROM tracked)),
stored AS (SELECT * FROM tp, w WHERE d < since QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY d DESC, work_id) <= 5),
newp AS (SELECT * FROM tp, w WHERE d >= since),
after_ AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY d DESC, work_id) AS recency FROM (SELECT * FROM stored UNION ALL SELECT * FROM newp) QUALIFY recency <= 5)
"""


@query("updated_publications", "C2 J1 J2 U2", UPDATE_SQL + "SELECT person_id, work_id, position, recency FROM after_")
def _(t: Tables):
    return run_update(t)[0].publications.select("person_id", "work_id", "position", "recency")


@query(
    "update_statistics", "A20 U4",
    UPDATE_SQL + """SELECT (SELECT count(DISTINCT work_id) FROM newp) AS works_scanned, (SELECT count(DISTINCT person_id) FROM newp) AS people_with_new_works,
      (SELECT count(*) FROM after_ a WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.person_id = a.person_id AND s.work_id = a.work_id)) AS publications_added,
      (SELECT count(*) FROM fresh JOIN tracked USING (person_id)) AS people_refreshed""",
)
def _(t: Tables):
    return run_update(t)[1]


@query(
    "updated_records", "C2 A8",
    UPDATE_SQL + """, l1 AS (SELECT person_id, count(DISTINCT first_author) AS fa, count(*) AS sp FROM stored WHERE position = 'last' GROUP BY 1 HAVING count(first_author) > 0),
    l2 AS (SELECT person_id, count(DISTINCT first_author) AS fa, count(*) AS sp FROM after_ WHERE position = 'last' AND person_id IN (SELECT person_id FROM newp) GROUP BY 1 HAVING count(first_author) > 0)
    SELECT p.person_id, coalesce(c, cites) AS citation_count, CASE WHEN l2.fa >= coalesce(l1.fa, 0) THEN l2.fa ELSE l1.fa END AS lab_first_authors,
      CASE WHEN l2.fa >= coalesce(l1.fa, 0) THEN l2.sp ELSE l1.sp END AS lab_senior_papers
    FROM people p JOIN tracked USING (person_id) LEFT JOIN fresh f USING (person_id) LEFT JOIN l1 USING (person_id) LEFT JOIN l2 USING (person_id)""",
)
def _(t: Tables):
    return run_update(t)[0].records.select("person_id", "citation_count", "lab_first_authors", "lab_senior_papers")


@query("kept_tags", "A12 C5", """SELECT person_id, count(*) AS tags, min(tag) AS first FROM (
  SELECT person_id, tag FROM ptags WHERE person_id % 3 = 0 UNION ALL SELECT person_id, 'old tag' FROM people WHERE person_id % 3 <> 0) GROUP BY 1""")
def _(t: Tables):
    old = t.authors.select("person_id", F.lit(0).alias("pos"), F.lit("old tag").alias("tag"), F.lit("k").alias("kind"))
    out = T.keep_stored_tags(old, cut_lineage(tags_of(t)).where("person_id % 3 = 0"))
    return out.groupBy("person_id").agg(F.count("*").alias("tags"), F.min("tag").alias("first"))


@query(
    "streamed_recent_works", "C3",
    """SELECT user_id AS person_id, event_id AS work_id, event_type AS title FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) DESC, event_id) <= 5""",
)
def _(t: Tables):
    schema = t.raw("events").schema
    events = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.root)
    stream = events.select(
        F.col("user_id").alias("person_id"), F.col("event_id").alias("work_id"), F.col("event_type").alias("title"),
        F.year("ts").alias("year"), F.to_date("ts").alias("date"), F.col("ts").cast("timestamp").alias("ts"),
    )
    root = scratch_dir(t.spark, "stream")
    S.stream_recent_works(stream, root).awaitTermination()
    return S.read_recent_works(t.spark, root).select("person_id", "work_id", "title")


# --- quality --------------------------------------------------------------------------------------------

def sizes(t: Tables) -> DataFrame:
    counts = t.authors.groupBy("institution_id").agg(F.count("*").alias("people"))
    return t.institutions.join(counts, "institution_id", "left").fillna(0, ["people"])


def customers_by_nation(t: Tables, every: int = 1) -> DataFrame:
    """People per nation; with `every` > 1 nations whose key it divides lost their odd customers."""
    c = t.raw("customer").where((F.col("c_nationkey") % every != 0) | (F.col("c_custkey") % 2 == 0)) if every > 1 else t.raw("customer")
    counts = c.groupBy(F.col("c_nationkey").alias("institution_id")).agg(F.count("*").alias("people"))
    return t.institutions.join(counts, "institution_id", "left").fillna(0, ["people"])


CHECK = "SELECT '{}' AS name, {} AS ok, '{}' AS severity, CAST({} AS DOUBLE) AS metric"


def verdict(df: DataFrame) -> DataFrame:
    return df.select("name", "ok", "severity", "metric")


@query("check_unique_ids", "Q1", CHECK.format("catalog", "count(*) = count(DISTINCT l_orderkey || '-' || l_linenumber)", "error", "count(*) - count(DISTINCT l_orderkey || '-' || l_linenumber)") + " FROM lineitem")
def _(t: Tables):
    rows = t.raw("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("person_id"))
    return verdict(Q.check_unique(rows))


@query("check_shared_ids", "Q2", "SELECT 'institution_ids' AS name, false AS ok, 'error' AS severity, CAST(count(*) AS DOUBLE) AS metric FROM nation WHERE n_nationkey >= 20")
def _(t: Tables):
    return verdict(Q.check_shared_ids(t.institutions))


@query("check_counts", "Q3", CHECK.format("counts", "count(*) > 0", "error", "count(*)") + " FROM supplier")
def _(t: Tables):
    return verdict(Q.check_counts(t.authors, sizes(t)))


@query("warn_small_institutions", "Q4", ", n AS (SELECT n_nationkey, count(s_suppkey) AS c FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1) " + CHECK.format("small_institutions", "count(*) FILTER (c < 4) = 0", "warning", "count(*) FILTER (c < 4)") + " FROM n")
def _(t: Tables):
    return verdict(Q.warn_small(sizes(t), 8))


@query("check_record_references", "Q5", CHECK.format("records", "count(*) = 0", "error", "count(*)") + " FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(t: Tables):
    rows = t.raw("orders").select(F.col("o_orderkey").alias("person_id"))
    full = t.raw("lineitem").select(F.col("l_orderkey").alias("person_id"))
    return verdict(Q.check_refs(rows, full))


@query("check_vector_index", "Q6 V12", CHECK.format("vectors", "count(*) FILTER (label = 3) + count(*) FILTER (label = 6) = 0", "error", "count(*) FILTER (label = 3) + 2 * count(*) FILTER (label = 6)") + " FROM embeddings")
def _(t: Tables):
    v = X.pack_bits(X.quantize(people_vectors(t)))
    label = F.col("institution_id")
    # Label 3 is missing, label 6 is stored twice with one byte too few.
    cluster = F.explode(F.when(label == 6, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0))))
    stored = v.where(label != 3).withColumn("cluster", cluster).withColumn("bits", F.when(label == 6, F.substring("bits", 1, 7)).otherwise(F.col("bits")))
    return verdict(Q.check_vectors(stored, v.select("person_id"), 64))


@query(
    "compared_builds", "J16",
    """SELECT n_name AS name, count(c_custkey) AS before, CASE WHEN n_nationkey = 7 THEN 0 ELSE count(c_custkey) FILTER (n_nationkey % 5 <> 0 OR c_custkey % 2 = 0) END AS now
    FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey""",
)
def _(t: Tables):
    return Q.compare_builds(customers_by_nation(t), customers_by_nation(t, 5).where("institution_id <> 7"))


@query(
    "check_shrink", "Q7",
    """, b AS (SELECT c_nationkey, count(*) AS before, count(*) FILTER (c_nationkey % 5 <> 0 OR c_custkey % 2 = 0) AS now FROM customer GROUP BY 1),
    n AS (SELECT count(*) FILTER (before >= 50 AND now < before * 0.8) + CASE WHEN sum(now) < sum(before) * 0.8 THEN 1 ELSE 0 END AS m FROM b) """
    + CHECK.format("shrink", "m = 0", "error", "m") + " FROM n",
)
def _(t: Tables):
    return verdict(Q.check_shrink(customers_by_nation(t), customers_by_nation(t, 5)))


@query("check_size", "Q8", CHECK.format("size", "sum(nworks) <= 30000", "error", "sum(nworks)") + " FROM people")
def _(t: Tables):
    return verdict(Q.check_size(t.authors.withColumn("bytes", F.col("works_count")), 30000))


@query(
    "build_status", "Q9",
    """SELECT CASE WHEN (SELECT count(*) FROM supplier) = 0 THEN 'failed' ELSE 'ok' END AS result, count(*) AS people, 25 AS institutions, 0 AS errors,
      CASE WHEN (SELECT min(c) FROM (SELECT count(s_suppkey) AS c FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey)) < 500 THEN 1 ELSE 0 END AS warnings,
      '2001-07-01' AS previous_success FROM supplier""",
)
def _(t: Tables):
    s = sizes(t)
    checks = Q.report(Q.check_unique(t.authors), Q.check_counts(t.authors, s), Q.warn_small(s, 1000), Q.check_refs(t.contacts, t.authors))
    earlier = t.raw("orders").select(
        F.to_timestamp(F.trunc("o_orderdate", "month")).alias("generated_at"),
        F.when(F.month("o_orderdate") == 8, "failed").otherwise("ok").alias("result"),
    )
    out = Q.status(checks, s, "full", NOW, earlier)
    return out.select("result", "people", "institutions", "errors", "warnings", F.date_format("previous_success_at", "yyyy-MM-dd").alias("previous_success"))


# --- evaluation -----------------------------------------------------------------------------------------------

EVAL_SQL = """, v AS (SELECT vec_id AS person_id, label, embedding::DOUBLE[] AS e FROM embeddings),
first_ AS (SELECT label AS profile_id, min(vec_id) AS own FROM embeddings GROUP BY 1),
p AS (SELECT profile_id, own, embedding::DOUBLE[] AS pe FROM first_ JOIN embeddings ON vec_id = own),
cand AS (SELECT * FROM v WHERE person_id NOT IN (SELECT own FROM first_ WHERE profile_id % 2 = 1)),
m AS (SELECT profile_id, person_id, own, round(list_cosine_similarity(pe, e), 6) AS score, row_number() OVER (PARTITION BY profile_id ORDER BY round(list_cosine_similarity(pe, e), 6) DESC, person_id) AS rk
      FROM p, cand),
r AS (SELECT profile_id, CASE WHEN profile_id <> 9 THEN own END AS reference, profile_id * 50 AS chars,
   (SELECT max(score) FROM m WHERE m.profile_id = p.profile_id) AS top, (SELECT min(rk) FROM m WHERE m.profile_id = p.profile_id AND person_id = m.own) AS self_rank FROM p),
j AS (SELECT *, CASE WHEN reference IS NULL THEN 'skipped' WHEN chars < 200 THEN 'failed' WHEN top >= 0.3 THEN 'passed' ELSE 'failed' END AS status FROM r)
"""


def evaluation(t: Tables) -> DataFrame:
    own = t.raw("embeddings").groupBy(F.col("label").alias("profile_id")).agg(F.min("vec_id").alias("person_id"))
    profiles = label_profiles(t).join(own, "profile_id")
    runs = profiles.select(
        "profile_id", F.lit("resume").alias("path"), F.when(F.col("profile_id") != 9, F.col("person_id")).alias("reference"),
        (F.col("profile_id") * 50).alias("document_chars"), "vector",
    )
    candidates = people_vectors(t).join(own.where("profile_id % 2 = 1").select("person_id"), "person_id", "left_anti")
    return V.evaluate(runs, candidates, own)


@query(
    "evaluated_runs", "E1 E3 W9",
    EVAL_SQL + """SELECT profile_id, status, CASE WHEN reference IS NOT NULL AND chars >= 200 THEN top END AS top_score, CASE WHEN reference IS NOT NULL THEN self_rank END AS self_rank FROM j""",
)
def _(t: Tables):
    return evaluation(t).select("profile_id", "status", "top_score", "self_rank")


@query(
    "evaluation_summary", "A21",
    EVAL_SQL + """SELECT count(*) FILTER (status <> 'skipped') AS runs_attempted, count(*) FILTER (status = 'passed') AS runs_passed, count(*) FILTER (status = 'skipped') AS runs_skipped,
      round(count(*) FILTER (status = 'passed') / count(*) FILTER (status <> 'skipped'), 3) AS pass_ratio,
      CASE WHEN count(*) FILTER (status = 'passed') / count(*) FILTER (status <> 'skipped') >= 0.8 THEN 'passing' ELSE 'failing' END AS status,
      count(*) AS people, count(*) FILTER (profile_id = 4) AS people_unresolved FROM j""",
)
def _(t: Tables):
    runs = evaluation(t)
    people = label_profiles(t).select("profile_id", F.when(F.col("profile_id") != 4, F.lit("x")).alias("person_id"))
    return V.summarize_runs(runs, people)


@query("showcase", "P10", EVAL_SQL + "SELECT profile_id AS ref_id FROM j WHERE status = 'passed' AND top >= 0.4 AND profile_id <> 6")
def _(t: Tables):
    runs = evaluation(t).select(
        F.col("profile_id").alias("ref_id"), "status", "top_score", F.array().cast("array<string>").alias("interests"),
        F.when(F.col("profile_id") == 6, " ").otherwise("text").alias("text"),
    )
    return V.showcase(runs)


@query("self_ranks", "W9", EVAL_SQL + "SELECT profile_id, CAST(min(rk) AS INT) AS self_rank FROM m WHERE person_id = own GROUP BY 1")
def _(t: Tables):
    own = t.raw("embeddings").groupBy(F.col("label").alias("profile_id")).agg(F.min("vec_id").alias("person_id"))
    candidates = people_vectors(t).join(own.where("profile_id % 2 = 1").select("person_id"), "person_id", "left_anti")
    return X.own_ranks(label_profiles(t), candidates, own)


@query(
    "distant_self_ranks", "W9",
    EVAL_SQL + """, late AS (SELECT label AS profile_id, max(vec_id) AS last FROM embeddings GROUP BY 1)
    SELECT profile_id, CAST(rk AS INT) AS self_rank FROM m JOIN late USING (profile_id) WHERE person_id = last""",
)
def _(t: Tables):
    by_label = t.raw("embeddings").groupBy(F.col("label").alias("profile_id"))
    own, late = (by_label.agg(f("vec_id").alias("person_id")) for f in (F.min, F.max))
    candidates = people_vectors(t).join(own.where("profile_id % 2 = 1").select("person_id"), "person_id", "left_anti")
    return X.own_ranks(label_profiles(t), candidates, late)


# --- sources and sinks --------------------------------------------------------------------------------------------

@query("written_records", "S6 S8 S15 W4", ROWS_SQL + "SELECT person_id, institution_id, seniority AS seniority_score, 0 AS record_chunk FROM rows WHERE institution_id IN (3, 4, 15)")
def _(t: Tables):
    root = scratch_dir(t.spark, "records")
    writers.write_records(records(t), root)
    return readers.read_records(t.spark, root, [3, 4, 15]).select("person_id", "institution_id", "seniority_score", "record_chunk")


@query("written_catalog", "S7 S9 S15 K5", ROWS_SQL + "SELECT person_id, name, institution_name, rnk AS rank FROM rows ORDER BY seniority DESC, cites DESC, person_id LIMIT 40")
def _(t: Tables):
    root = scratch_dir(t.spark, "catalog")
    writers.write_institutions(t.institutions, root)
    writers.write_catalog(P.to_catalog(records(t)), root, 40)
    return readers.read_catalog(t.spark, root).select("person_id", "name", "institution_name", "rank")


@query("catalog_rows_of_institutions", "S9 S15", ROWS_SQL + "SELECT person_id, country_code FROM rows WHERE institution_id IN (1, 2, 8)")
def _(t: Tables):
    root = scratch_dir(t.spark, "catalog")
    writers.write_institutions(t.institutions, root)
    writers.write_catalog(P.to_catalog(records(t)), root, 40)
    return readers.read_catalog(t.spark, root, [1, 2, 8]).select("person_id", "country_code")


@query("catalog_from_records", "S7", ROWS_SQL + "SELECT person_id, institution_name, cites AS citation_count FROM rows")
def _(t: Tables):
    root = scratch_dir(t.spark, "records")
    writers.write_institutions(t.institutions, root)
    writers.write_records(records(t), root)
    return readers.read_catalog(t.spark, root).select("person_id", "institution_name", "citation_count")


@query("written_vector_index", "S10 S14 V5", """, p AS (SELECT label AS profile_id, arg_min(embedding, vec_id)::DOUBLE[] AS pe FROM embeddings GROUP BY 1),
a AS (SELECT vec_id, (SELECT arg_min(profile_id, (-round(list_cosine_similarity(pe, embedding::DOUBLE[]), 9), profile_id)) FROM p) AS cluster FROM embeddings)
SELECT cluster, count(*) AS people, CAST(8 * count(*) AS BIGINT) AS bytes FROM a WHERE cluster IN (1, 3) GROUP BY 1""")
def _(t: Tables):
    root = scratch_dir(t.spark, "vectors")
    assigned = X.assign_clusters(people_vectors(t), label_centroids(t))
    writers.write_vector_index(X.pack_bits(X.quantize(assigned)).select("person_id", "institution_id", "bits", "cluster"), label_centroids(t), root)
    stored = readers.read_vectors(t.spark, root, clusters=[1, 3])
    return stored.groupBy("cluster").agg(F.count("*").alias("people"), F.sum(F.octet_length("bits")).cast("long").alias("bytes"))


@query("csv_export", "S11", """SELECT c_name AS "Name", '''-' || c_mktsegment AS "Title", n_name AS "University", r_name AS "Country", CAST(n_nationkey + 1 AS VARCHAR) AS "University rank",
  '''=' || c_custkey AS "Email", '' AS "Profile link", 'To contact' AS "Status", 'say "hi", ' || c_custkey AS "Notes", '2001-08-01' AS "Saved"
  FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey""")
def _(t: Tables):
    rows = t.raw("customer").join(t.institutions, F.col("c_nationkey") == F.col("institution_id")).select(
        F.col("c_name").alias("name"), F.concat(F.lit("-"), "c_mktsegment").alias("title"), "institution_name", "country_code", "rank",
        F.concat(F.lit("="), "c_custkey").alias("email"), F.lit(None).cast("string").alias("profile_url"), F.lit("To contact").alias("status"),
        F.concat(F.lit('say "hi", '), "c_custkey").alias("note"), F.lit(NOW).alias("saved_at"),
    )
    path = scratch_dir(t.spark, "csv")
    writers.export_csv(rows, path)
    names = writers.csv_rows(rows).schema
    return t.spark.read.schema(names).option("header", True).option("escape", '"').csv(path).fillna("")


@query("run_metadata", "S12", """SELECT 'full' AS kind, count(*) AS people, '2001-08-01' AS last_ingestion FROM supplier UNION ALL SELECT 'update', count(*), NULL FROM orders""")
def _(t: Tables):
    root = scratch_dir(t.spark, "runs")
    writers.write_run_metadata(t.spark, root, "full", NOW, people=t.raw("supplier").count(), last_ingestion=NOW.date())
    writers.write_run_metadata(t.spark, root, "update", NOW, people=t.raw("orders").count())
    return t.spark.read.parquet(f"{root}/runs").select("kind", "people", F.date_format("last_ingestion", "yyyy-MM-dd").alias("last_ingestion"))


@query("assembled_partials", "S13", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def _(t: Tables):
    parts = t.raw("orders").select(F.col("o_orderpriority").alias("partial_id"), F.col("o_orderstatus").alias("status"))
    expected = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return writers.assemble_partials(parts, expected).groupBy("status").agg(F.count("*").alias("n"))


@query("dictionary_round_trip", "F15", ROWS_SQL + """, d AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS id FROM (SELECT DISTINCT domain AS value FROM rowdom))
SELECT person_id, primary_domain, id AS primary_id, (SELECT string_agg(domain, '|' ORDER BY domain) FROM rowdom r WHERE r.person_id = rows.person_id) AS domains, title, profile_url
FROM rows LEFT JOIN d ON value = primary_domain""")
def _(t: Tables):
    r = cut_lineage(records(t).select("person_id", "primary_domain", "domains", "title", "profile_url"))
    every = r.select("person_id", "primary_domain", F.array_append("domains", F.col("primary_domain")).alias("domains"), "title", "profile_url")
    encoded, tables = E.dictionary_encode(every.withColumn("profile_url", E.encode_url(F.col("profile_url"))), ["domains", "title"])
    ids = encoded.withColumn("primary_id", F.element_at("domains", -1)).select("person_id", "primary_id")
    back = E.dictionary_decode(encoded, tables).withColumn("profile_url", E.decode_url(F.col("profile_url")))
    return back.join(ids, "person_id").select(
        "person_id", "primary_domain", "primary_id", F.array_join(F.array_sort(F.array_distinct("domains")), "|").alias("domains"), "title", "profile_url"
    )


@query("stripped_publications", "P9", """SELECT person_id, count(*) AS papers, 'work_id,title,year,date,position' AS fields FROM recent GROUP BY 1""")
def _(t: Tables):
    full = W.publication_arrays(t.recent, "first_author")
    clean = P.strip_transient(full)
    fields = ",".join(clean.schema["recent_publications"].dataType.elementType.fieldNames())
    return clean.select("person_id", F.size("recent_publications").cast("long").alias("papers"), F.lit(fields).alias("fields"))


@query(
    "read_nested_inputs", "S1 S2 S3",
    """SELECT 'topics' AS part, CAST(sum(n) AS BIGINT) AS n FROM topics UNION ALL SELECT 'years', CAST(sum(n) AS BIGINT) FROM years
    UNION ALL SELECT 'authorships', count(*) FROM lines UNION ALL SELECT 'lab papers', count(first_author) FROM auth
    UNION ALL SELECT 'funders', count(*) FROM works WHERE work_id IN (SELECT work_id FROM lines) UNION ALL SELECT 'topic keywords', CAST(sum(c) AS BIGINT) FROM (SELECT count(DISTINCT p_type) AS c FROM part GROUP BY p_name)""",
)
def _(t: Tables):
    root = scratch_dir(t.spark, "nested")
    named = lambda c: F.struct(F.col(c).alias("display_name"))
    link = lambda c, kind: F.concat(F.lit(f"https://openalex.org/{kind}"), c)
    topics = t.author_topics.groupBy("person_id").agg(
        F.collect_list(F.struct(F.col("topic").alias("display_name"), F.col("n").cast("double").alias("count"), named("subfield").alias("subfield"), named("field").alias("field"))).alias("topics")
    )
    years = t.year_counts.groupBy("person_id").agg(F.collect_list(F.struct("year", F.col("works").cast("int").alias("works_count"))).alias("counts_by_year"))
    authors = t.authors.join(topics, "person_id").join(years, "person_id").select(link("person_id", "A").alias("id"), "topics", "counts_by_year")
    packed = {"compression": "gzip"}
    authors.write.options(**packed).json(f"{root}/authors")
    people = t.authorships.groupBy("work_id").agg(
        F.collect_list(F.struct(F.struct(link("person_id", "A").alias("id")).alias("author"), F.col("position").alias("author_position"))).alias("authorships")
    )
    funders = t.work_funders.select("work_id", F.array(named("funder")).alias("funders"))
    works = t.works.join(people, "work_id").join(funders, "work_id")
    works.select(link("work_id", "W").alias("id"), "title", F.col("date").alias("publication_date"), "authorships", "funders").write.options(**packed).json(f"{root}/works")
    t.topics.select(F.col("topic").alias("display_name"), named("subfield").alias("subfield"), "keywords").write.options(**packed).json(f"{root}/topics")
    a, w = readers.read_authors(t.spark, f"{root}/authors"), readers.read_works(t.spark, f"{root}/works")
    counts = {
        "topics": a["author_topics"].agg(F.sum("n").cast("long").alias("n")),
        "years": a["year_counts"].agg(F.sum("works").alias("n")),
        "authorships": w["authorships"].agg(F.count("*").alias("n")),
        "lab papers": w["authorships"].agg(F.count("first_author").alias("n")),
        "funders": w["work_funders"].agg(F.count("*").alias("n")),
        "topic keywords": readers.read_topics(t.spark, f"{root}/topics").agg(F.sum(F.size("keywords")).alias("n")),
    }
    out = None
    for name, c in counts.items():
        row = c.select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionAll(row)
    return out


@query(
    "read_contact_records", "S4",
    """SELECT s_suppkey AS person_id, 's' || s_suppkey || '@nation' || s_nationkey || '.ac.uk' AS email, 'https://nation' || s_nationkey || '.ac.uk' AS url,
      'NATION_' || s_nationkey AS org, CASE WHEN s_suppkey % 2 = 0 THEN 'ror' || s_nationkey END AS ror, CASE WHEN s_suppkey % 3 > 0 THEN 'Reader' END AS role,
      CAST(1990 + s_suppkey % 30 AS INT) AS start, s_suppkey % 5 = 0 AS current FROM supplier""",
)
def _(t: Tables):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    host = F.concat(F.lit("nation"), n, F.lit(".ac.uk"))
    email = F.struct(F.struct(F.array(F.struct(F.concat(F.lit("S"), k, F.lit("@"), host).alias("email"))).alias("email")).alias("emails"),
                     F.struct(F.array(
                         F.struct(F.struct(F.concat(F.lit("ftp://"), host).alias("value")).alias("url")),
                         F.struct(F.struct(F.concat(F.lit(" https://"), host).alias("value")).alias("url")),
                     ).alias("researcher-url")).alias("researcher-urls"))
    year = lambda c: F.struct(F.struct(c.cast("string").alias("value")).alias("year"))
    registry = F.struct(F.concat(F.lit("ror"), n).alias("disambiguated-organization-identifier"), F.when(k % 2 == 0, "ROR").otherwise("GRID").alias("disambiguation-source"))
    job = F.struct(
        F.when(k % 3 > 0, " Reader ").otherwise(" ").alias("role-title"), year(1990 + k % 30).alias("start-date"),
        F.when(k % 5 > 0, year(F.lit(2021))).alias("end-date"),
        F.struct(F.concat(F.lit("NATION_"), n).alias("name"), registry.alias("disambiguated-organization")).alias("organization"),
    )
    groups = F.array(F.struct(F.array(F.struct(job.alias("employment-summary"))).alias("summaries"))).alias("affiliation-group")
    root = scratch_dir(t.spark, "contacts")
    t.raw("supplier").select(
        F.concat(F.lit("https://orcid.org/"), k).alias("orcid"), email.alias("person"), F.struct(F.struct(groups).alias("employments")).alias("activities-summary")
    ).write.json(root)
    got = readers.read_contact_records(t.spark, root)
    joined = got["contact_emails"].drop("pos").join(got["contact_urls"].drop("pos"), "orcid").join(got["employments"], "orcid")
    return joined.select(F.col("orcid").cast("long").alias("person_id"), "email", "url", "org", "ror", "role", "start", "current")


@query(
    "full_build", "P11 S8 S9 S12 U1 W2",
    """, pooled AS (SELECT person_id, cites, CASE WHEN institution_id >= 20 THEN institution_id - 20 ELSE institution_id END AS home, nworks, h FROM people WHERE nworks >= 20 AND cites >= 500 AND h >= 10),
    top AS (SELECT * FROM pooled QUALIFY row_number() OVER (PARTITION BY home ORDER BY cites DESC, person_id) <= 5)
    SELECT t.person_id, home AS institution_id, s.seniority AS seniority_score, (SELECT string_agg(tag, '|' ORDER BY pos) FROM ptags x WHERE x.person_id = t.person_id) AS tags, c.title
    FROM top t JOIN scored s USING (person_id) JOIN contact c USING (person_id)""",
)
def _(t: Tables):
    inputs = Inputs(t.authors, t.institutions, t.author_topics, t.year_counts, t.works, t.authorships, t.work_funders, t.work_keywords, t.contacts)
    limits = Limits(per_institution=5)
    root = scratch_dir(t.spark, "build")
    publish(build_records(inputs, AS_OF, limits), t.institutions, root, NOW, limits)
    rows = readers.read_catalog(t.spark, root)
    return rows.select("person_id", "institution_id", "seniority_score", F.array_join("tags", "|").alias("tags"), "title")


@query(
    "rewritten_institutions", "C2 J10 S8 S9 S12",
    """, pooled AS (SELECT person_id, CASE WHEN institution_id >= 20 THEN institution_id - 20 ELSE institution_id END AS home FROM people WHERE nworks >= 20 AND cites >= 500 AND h >= 10),
    newest AS (SELECT max(d) AS day FROM works), touched AS (SELECT DISTINCT person_id FROM pubs, newest WHERE d = day)
    SELECT home AS institution_id, count(*) AS people, bool_or(person_id IN (SELECT person_id FROM touched)) AS rewritten FROM pooled GROUP BY 1""",
)
def _(t: Tables):
    """A full build, then an update with the works of the newest day: which institutions have new files."""
    inputs = Inputs(t.authors, t.institutions, t.author_topics, t.year_counts, t.works, t.authorships, t.work_funders, t.work_keywords, t.contacts)
    root, limits = scratch_dir(t.spark, "build"), Limits()
    publish(build_records(inputs, AS_OF, limits), t.institutions, root, NOW, limits)
    before = versions.current(t.spark, root).tables["records"]
    day = t.works.agg(F.max("date")).first()[0]
    homes = t.authorship_lines.join(t.authors.select("person_id", "institution_id"), "person_id").select("work_id", "institution_id")
    nothing = t.authors.select("person_id", "citation_count").where("false")
    refresh_build(root, dt.datetime.combine(day, dt.time(12)), t.works, t.authorships, homes, nothing, limits=limits, since=day)
    after = versions.current(t.spark, root).tables["records"]
    kept = [part for part, folder in after.items() if before.get(part) == folder]  # one name per institution
    counts = readers.read_records(t.spark, root).groupBy("institution_id").agg(F.count("*").alias("people"))
    return counts.withColumn("rewritten", ~readers.part_name(F.col("institution_id")).isin(kept))


@query(
    "published_keyword_search", "T1 T2 C2",
    """, pooled AS (SELECT person_id FROM people WHERE nworks >= 20 AND cites >= 500 AND h >= 10)
    SELECT person_id, 0 AS tier FROM pooled JOIN contact c USING (person_id)
    WHERE c.title LIKE '%Professor%' AND EXISTS (SELECT 1 FROM recent r WHERE r.person_id = pooled.person_id AND r.title LIKE '%HIGH%')""",
)
def _(t: Tables):
    """A full build a month back, an update until now, then a search in the stored index, part of which the update has replaced."""
    inputs = Inputs(t.authors, t.institutions, t.author_topics, t.year_counts, t.works, t.authorships, t.work_funders, t.work_keywords, t.contacts)
    root, limits, then = scratch_dir(t.spark, "build"), Limits(), NOW - dt.timedelta(days=30)
    publish(build_records(inputs, then.date(), limits), t.institutions, root, then, limits)
    homes = t.authorship_lines.join(t.authors.select("person_id", "institution_id"), "person_id").select("work_id", "institution_id")
    nothing = t.authors.select("person_id", "citation_count").where("false")
    refresh_build(root, NOW, t.works, t.authorships, homes, nothing, limits=limits, since=then.date())
    return K.keyword_search(readers.read_catalog(t.spark, root), "prof high", read_keyword_index(t.spark, root)).select("person_id", "tier")


@query(
    "window_from_work_tables", "J1 J2 C2",
    """, w AS (SELECT max(o_orderdate) - INTERVAL 30 DAY AS since FROM orders WHERE year(o_orderdate) < 2001)
    SELECT work_id, person_id, position, first_author, title FROM pubs, w WHERE d >= since""",
)
def _(t: Tables):
    """The update's window out of tables by month and work."""
    root, window = scratch_dir(t.spark, "work_tables"), update_window(t)
    homes = t.authorship_lines.join(t.authors.select("person_id", "institution_id"), "person_id").select("work_id", "institution_id")
    write_work_tables(t.works, t.authorships, homes, root, 8)
    institutions = t.institutions.withColumn("extra_ids", F.lit(None).cast("array<int>"))
    found = window_works(t.authors, window, institutions, *open_window(t.spark, root, window))[1]
    return found.select("work_id", "person_id", "position", "first_author", "title")
