"""Queries on selecting, ordering and publishing people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import people as P
from ..operators import topics as T
from ..operators import works as W
from .bindings import AS_OF, Tables
from .registry import query
from .work_queries import tags_of

TIERS = [  # settings of the coverage ladder
    {"per_institution": 1000, "min_works": 20, "min_citations": 500, "min_h_index": 10},
    {"per_institution": 3000, "min_works": 10, "min_citations": 100, "min_h_index": 5},
    {"per_institution": 10000, "min_works": 5, "min_citations": 20, "min_h_index": 3},
    {"per_institution": 25000, "min_works": 3, "min_citations": 5, "min_h_index": 1},
    {"per_institution": 50000, "min_works": 2, "min_citations": 1, "min_h_index": 1},
]


def scored(t: Tables) -> DataFrame:
    return W.with_seniority(t.authors, W.role_counts(t.recent))


def records(t: Tables) -> DataFrame:
    """Full records without the tags and publications: enough for orders, filters and facets."""
    areas = T.domain_arrays(T.domain_weights(t.author_topics), T.primary_domain(t.author_topics))
    return T.with_domain_names(P.assemble_records(scored(t), t.institutions, areas, t.contacts))


def catalog(t: Tables) -> DataFrame:
    keep = ["institution_name", "country_code", "rank"]
    r = records(t)
    return P.to_catalog(r).join(r.select("person_id", *keep), "person_id")


ROWS_SQL = """, rows AS (
  SELECT s.*, i.institution_name, i.country_code, i.rnk, c.title, c.email, c.profile_url, c.source, p.primary_domain
  FROM scored s JOIN inst i USING (institution_id) JOIN contact c USING (person_id) LEFT JOIN prim p USING (person_id)),
rowdom AS (SELECT person_id, domain FROM dom WHERE weight > 0 UNION SELECT person_id, primary_domain FROM prim)
"""


@query(
    "top_people_overview", "W1 W3 W5 K5 A1 F6",
    ROWS_SQL + """, best AS (SELECT * FROM rows ORDER BY seniority DESC, cites DESC, person_id LIMIT 100)
    SELECT b.person_id, b.name, b.seniority AS seniority_score, b.cites AS citation_count, b.country_code,
      (SELECT string_agg(domain, '|' ORDER BY domain_rank) FROM dom d WHERE d.person_id = b.person_id AND weight > 0) AS areas,
      (SELECT string_agg(title, '|' ORDER BY recency) FROM recent r WHERE r.person_id = b.person_id) AS newest
    FROM best b""",
)
def _(t: Tables):
    top = P.truncate_catalog(scored(t), 100)
    areas = T.domain_arrays(T.domain_weights(t.author_topics), T.primary_domain(t.author_topics))
    full = P.assemble_records(top, t.institutions, areas, W.publication_arrays(t.recent))
    return full.select(
        "person_id", "name", "seniority_score", "citation_count", "country_code",
        F.array_join("domain_weights.name", "|").alias("areas"),
        F.array_join("recent_publications.title", "|").alias("newest"),
    )


@query(
    "select_people", "P1 P2",
    """SELECT person_id, nworks AS works_count, cites AS citation_count, h AS h_index FROM people
    WHERE nworks >= 20 AND cites >= 14000 AND h >= 10 AND person_id IN (SELECT person_id FROM years WHERE yr >= 1991 AND n > 0)""",
)
def _(t: Tables):
    return P.select_people(t.authors, t.year_counts, AS_OF, min_citations=14000).select(
        "person_id", "works_count", "citation_count", "h_index"
    )


@query(
    "top_people", "W1",
    """SELECT person_id, institution_id, cites AS citation_count FROM people
    QUALIFY row_number() OVER (PARTITION BY institution_id ORDER BY cites DESC, person_id) <= 3""",
)
def _(t: Tables):
    return P.top_people(t.authors, 3).select("person_id", "institution_id", "citation_count")


@query(
    "top_customers_by_spend", "W1",
    """, spend AS (SELECT o_custkey AS person_id, CAST(round(sum(o_totalprice)) AS BIGINT) AS cites FROM orders GROUP BY 1)
    SELECT c_custkey AS person_id, c_nationkey AS institution_id, coalesce(cites, 0) AS citation_count
    FROM customer LEFT JOIN spend ON c_custkey = person_id
    QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY coalesce(cites, 0) DESC, c_custkey) <= 20""",
)
def _(t: Tables):
    spend = t.raw("orders").groupBy(F.col("o_custkey").alias("person_id")).agg(
        F.round(F.sum("o_totalprice")).cast("long").alias("citation_count")
    )
    people = t.raw("customer").select(F.col("c_custkey").alias("person_id"), F.col("c_nationkey").alias("institution_id"))
    return P.top_people(people.join(spend, "person_id", "left").fillna(0, ["citation_count"]), 20)


@query(
    "pooled_institutions", "W2",
    """, pool AS (SELECT person_id, cites, CASE WHEN institution_id >= 20 THEN institution_id - 20 ELSE institution_id END AS institution_id FROM people)
    SELECT person_id, institution_id, cites AS citation_count FROM pool
    QUALIFY row_number() OVER (PARTITION BY institution_id ORDER BY cites DESC, person_id) <= 4""",
)
def _(t: Tables):
    aliases = t.institutions.select("institution_id", F.explode("extra_ids").alias("extra_id"))
    return P.pool_institutions(t.authors, aliases, 4).select("person_id", "institution_id", "citation_count")


@query(
    "deduped_people", "U1",
    """, twice AS (SELECT person_id, institution_id FROM people UNION ALL SELECT person_id, (institution_id * 7 + 3) % 25 FROM people)
    SELECT person_id, min(institution_id + 1) AS rank FROM twice GROUP BY 1""",
)
def _(t: Tables):
    a = t.authors.select("person_id", "institution_id")
    twice = a.unionByName(a.withColumn("institution_id", (F.col("institution_id") * 7 + 3) % 25))
    return P.dedupe_people(P.join_institutions(twice, t.institutions)).select("person_id", "rank")


@query(
    "coverage_tiers", "J13",
    """, tiers(per_institution, min_works, min_citations, min_h_index) AS (
      VALUES (1000, 20, 500, 10), (3000, 10, 100, 5), (10000, 5, 20, 3), (25000, 3, 5, 1), (50000, 2, 1, 1))
    SELECT c_custkey AS request_id, CAST(floor(c_acctbal * 6) AS BIGINT) AS size, per_institution, min_works, min_citations, min_h_index
    FROM customer JOIN tiers ON per_institution = coalesce(
      (SELECT max(per_institution) FROM tiers x WHERE x.per_institution <= floor(c_acctbal * 6)), 1000)""",
)
def _(t: Tables):
    requests = t.raw("customer").select(
        F.col("c_custkey").alias("request_id"), F.floor(F.col("c_acctbal") * 6).alias("size")
    )
    return P.tier_lookup(requests, TIERS)


FLAGS_SQL = ROWS_SQL + """, flagged AS (
  SELECT *, email IS NOT NULL AS e, profile_url IS NOT NULL AND coalesce(source NOT IN ('orcid', 'openalex'), true) AS p FROM rows),
named AS (SELECT *, concat_ws('|', CASE WHEN NOT e THEN 'missing_email' END,
  CASE WHEN profile_url IS NULL THEN 'missing_profile_url' WHEN NOT p THEN 'profile_not_institutional' END,
  CASE WHEN title IS NULL THEN 'missing_title' END) AS flags FROM flagged)
"""


@query("contact_flags", "P7 F7", FLAGS_SQL + "SELECT person_id, flags, e AS has_email, p AS has_profile, e AND p AS verified FROM named")
def _(t: Tables):
    out = P.with_verification(P.with_contact_flags(t.contacts))
    return out.select("person_id", F.array_join("flags", "|").alias("flags"), "has_email", "has_profile", "verified")


@query("contactable_people", "P3", FLAGS_SQL + "SELECT person_id FROM named WHERE e OR p")
def _(t: Tables):
    return P.require_contact(P.with_contact_flags(t.contacts)).select("person_id")


@query(
    "likely_leads", "P6",
    ROWS_SQL + "SELECT person_id, seniority >= 60 AS likely_lead, fa + la > 0 AS has_authorship FROM rows",
)
def _(t: Tables):
    return P.with_role_flags(scored(t)).select("person_id", "likely_lead", "has_authorship")


@query(
    "slim_rows", "P4 P11",
    ROWS_SQL + """SELECT person_id, name, title, institution_id, primary_domain, cites AS citation_count, email, email IS NOT NULL AS has_email,
      seniority AS seniority_score, fa AS first_author_recent, la AS last_author_recent, known AS recent_works,
      primary_domain || '|' || (SELECT string_agg(domain, '|' ORDER BY weight DESC, domain_rank) FROM dom d WHERE d.person_id = rows.person_id AND weight > 0) AS domains
    FROM rows""",
)
def _(t: Tables):
    return P.to_catalog(records(t)).drop("profile_url").withColumn("domains", F.array_join("domains", "|"))


@query(
    "filtered_catalog", "P5",
    ROWS_SQL + """SELECT person_id, institution_name FROM rows WHERE country_code = 'ASIA' AND seniority >= 50
      AND person_id IN (SELECT person_id FROM rowdom WHERE domain IN ('Brand#1', 'PROMO'))""",
)
def _(t: Tables):
    hits = scored(t).where("seniority_score >= 50")
    return P.filter_catalog(catalog(t), "ASIA", None, ["Brand#1", "PROMO"], hits).select("person_id", "institution_name")


@query(
    "expanded_records", "P8",
    """SELECT person_id, name, cites AS citation_count, coalesce(title, 'Unknown') AS title, email
    FROM people LEFT JOIN contact USING (person_id)""",
)
def _(t: Tables):
    rows = t.authors.select("person_id", "name", "citation_count", F.lit("Unknown").alias("title"))
    return P.expand_records(rows, t.contacts.select("person_id", "title", "email"))


@query(
    "rows_with_institution", "J11 S7",
    """SELECT person_id, coalesce(i.institution_name, 'row name') AS institution_name, rnk AS rank, i.country_code
    FROM people p LEFT JOIN inst i ON i.institution_id = p.institution_id AND i.institution_id < 15""",
)
def _(t: Tables):
    rows = t.authors.select("person_id", "institution_id", F.lit("row name").alias("institution_name"))
    # Institutions from 15 on stand for unmatched ones, whose rows keep their own name; no bound of the operators.
    out = P.join_institutions(rows, t.institutions.where("institution_id < 15"))
    return out.select("person_id", "institution_name", "rank", "country_code")


@query(
    "appended_rows", "U3",
    """SELECT person_id, CASE WHEN person_id IN (SELECT person_id FROM people WHERE h >= 20) THEN 'old' ELSE 'new' END AS src FROM people""",
)
def _(t: Tables):
    a = t.authors.select("person_id", "h_index")
    old = a.where("h_index >= 20").select("person_id", F.lit("old").alias("src"))
    return P.append_rows(old, a.select("person_id", F.lit("new").alias("src")))


@query(
    "missing_match_institutions", "J12",
    "SELECT DISTINCT institution_id FROM people WHERE person_id NOT IN (SELECT person_id FROM scored ORDER BY seniority DESC, cites DESC, person_id LIMIT 60)",
)
def _(t: Tables):
    return P.missing_matches(t.authors, P.truncate_catalog(scored(t), 60))


@query(
    "contact_coverage", "A19",
    FLAGS_SQL + """SELECT institution_id, count(*) AS people, count(email) AS with_email, count(*) FILTER (e AND p) AS verified
    FROM named GROUP BY ROLLUP (institution_id)""",
)
def _(t: Tables):
    people = t.contacts.join(t.authors.select("person_id", "institution_id"), "person_id")
    return P.coverage(people)


@query(
    "publish_order", "K4",
    FLAGS_SQL + """SELECT person_id, row_number() OVER (ORDER BY (e AND p) DESC, e DESC, p DESC, rnk, cites DESC, person_id) AS place FROM named
    QUALIFY place <= 50""",
)
def _(t: Tables):
    people = P.assemble_records(t.authors, t.institutions, t.contacts)
    first = P.publish_order(people).limit(50).select("person_id", F.monotonically_increasing_id().alias("_i"))
    return first.select("person_id", F.col("_i").cast("long").alias("place")).withColumn("place", F.col("place") + 1)


def _ranked_rows(df: DataFrame, mode: str) -> DataFrame:
    """First page of an order with its positions; the page is 24 rows by definition."""
    first = P.page(df, 0, 24, mode)
    return first.select("person_id", (F.monotonically_increasing_id() + 1).alias("place"))


PAGE = "SELECT person_id, row_number() OVER (ORDER BY {}) AS place FROM rows QUALIFY place <= 24"


@query("order_by_lead_score", "K1 K6", ROWS_SQL + PAGE.format("seniority DESC NULLS LAST, cites DESC, person_id"))
def _(t: Tables):
    return _ranked_rows(scored(t), "pi")


@query("order_by_citations", "K3", ROWS_SQL + PAGE.format("cites DESC, person_id"))
def _(t: Tables):
    return _ranked_rows(t.authors, "citations")


@query("order_by_institution_rank", "K3", ROWS_SQL + PAGE.format("rnk, cites DESC, person_id"))
def _(t: Tables):
    return _ranked_rows(P.join_institutions(t.authors, t.institutions), "rank")


@query("order_by_name", "K3", ROWS_SQL + PAGE.format("name, person_id"))
def _(t: Tables):
    return _ranked_rows(t.authors, "name")


@query("third_page", "K6", ROWS_SQL + "SELECT person_id FROM rows ORDER BY seniority DESC, cites DESC, person_id LIMIT 24 OFFSET 48")
def _(t: Tables):
    return P.page(scored(t), 2).select("person_id")


@query("catalog_completeness", "K5", "SELECT count(*) AS people, least(count(*), 60) AS catalog_rows, count(*) <= 60 AS catalog_complete FROM people")
def _(t: Tables):
    return P.catalog_completeness(t.authors, 60)


@query(
    "record_chunks", "W4 W5 S8",
    """SELECT person_id, institution_id, CAST((row_number() OVER (PARTITION BY institution_id ORDER BY seniority DESC, cites DESC, person_id) - 1) // 3 AS INT) AS record_chunk
    FROM scored""",
)
def _(t: Tables):
    return P.record_chunks(scored(t), 3).select("person_id", "institution_id", "record_chunk")


@query(
    "pruned_to_budget", "W6 A23",
    """SELECT person_id FROM (SELECT person_id, sum(nworks + 100) OVER (ORDER BY seniority DESC, cites DESC, person_id) AS running,
      sum(nworks + 100) OVER () AS total FROM scored) WHERE running <= floor(total * 0.6)""",
)
def _(t: Tables):
    people = scored(t).withColumn("bytes", F.col("works_count") + 100)
    budget = people.agg((F.floor(F.sum("bytes") * 0.6)).alias("b")).first()["b"]  # one number
    return P.prune_to_budget(people, budget).select("person_id")


@query(
    "match_scope", "W7",
    """, sizes AS (SELECT institution_id, rnk, count(person_id) AS people FROM inst LEFT JOIN people USING (institution_id) GROUP BY ALL)
    SELECT institution_id, rank, people FROM (SELECT institution_id, rnk AS rank, people, sum(people) OVER (ORDER BY rnk) AS run, (SELECT count(*) FROM people) AS total FROM sizes)
    WHERE run <= total * 0.4 OR rank = 1""",
)
def _(t: Tables):
    counts = t.authors.groupBy("institution_id").agg(F.count("*").alias("people"))
    sizes = t.institutions.select("institution_id", "rank").join(counts, "institution_id", "left").fillna(0, ["people"])
    cap = counts.agg(F.floor(F.sum("people") * 0.4).alias("c")).first()["c"]  # one number
    return P.pick_scope(sizes, cap).select("institution_id", "rank", "people")


@query(
    "facets", "A16",
    ROWS_SQL + """SELECT 'country' AS kind, country_code AS value, CAST(NULL AS INT) AS rank, count(*) AS people FROM rows GROUP BY 2
    UNION ALL SELECT 'institution', institution_name, rnk, count(*) FROM rows GROUP BY ALL
    UNION ALL SELECT 'domain', d, NULL, count(person_id) FROM (SELECT DISTINCT domain AS d FROM rowdom UNION SELECT DISTINCT 'unused ' || p_type FROM part)
      LEFT JOIN rowdom ON domain = d GROUP BY 2""",
)
def _(t: Tables):
    r = records(t)
    listed = T.domain_list(r).union(t.raw("part").select(F.concat(F.lit("unused "), "p_type").alias("domain")).distinct())
    return T.facets(r, listed).drop("country_code")


@query(
    "facets_with_published_totals", "A17 A18",
    ROWS_SQL + """, pub AS (SELECT institution_name, country_code, rnk, 1000 + institution_id AS people FROM inst WHERE institution_id < 10),
    unlisted AS (SELECT * FROM rows WHERE institution_name NOT IN (SELECT institution_name FROM pub))
    SELECT 'institution' AS kind, institution_name AS value, rnk AS rank, people FROM pub WHERE country_code = 'ASIA'
    UNION ALL SELECT 'institution', institution_name, rnk, count(*) FROM unlisted WHERE country_code = 'ASIA' GROUP BY ALL
    UNION ALL SELECT 'country', country_code, NULL, CAST(sum(n) AS BIGINT) FROM (
       SELECT country_code, people AS n FROM pub UNION ALL SELECT country_code, 1 FROM unlisted) GROUP BY 2
    UNION ALL SELECT 'domain', domain, NULL, count(*) FROM rowdom GROUP BY 2""",
)
def _(t: Tables):
    published = t.institutions.where("institution_id < 10").select(
        "institution_name", "country_code", "rank", (F.col("institution_id") + 1000).alias("people")
    )
    return T.facets(records(t), published=published, country="ASIA").drop("country_code")


@query(
    "estimated_bytes", "A23",
    """SELECT institution_id, CAST(sum(2 * length('{"person_id":' || person_id || ',"name":"' || name || '","institution_id":' || institution_id || ',"email":"' || coalesce(email, '') || '"}')
      - CASE WHEN email IS NULL THEN 2 * length(',"email":""') ELSE 0 END + 84) AS BIGINT) AS bytes FROM people JOIN contact USING (person_id) GROUP BY 1""",
)
def _(t: Tables):
    rows = t.authors.select("person_id", "name", "institution_id").join(t.contacts.select("person_id", "email"), "person_id")
    return P.estimated_bytes(rows).groupBy("institution_id").agg(F.sum("bytes").alias("bytes"))


@query("tagged_catalog", "P4 A12", """SELECT person_id, string_agg(tag, '|' ORDER BY pos) AS tags FROM ptags GROUP BY 1""")
def _(t: Tables):
    tags = tags_of(t).groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("_t"))
    return tags.select("person_id", F.array_join("_t.tag", "|").alias("tags"))
