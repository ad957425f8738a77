"""Queries on works, authorship and per-person signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ranking import store
from ..operators import topics as T
from ..operators import works as W
from .bindings import AS_OF, Tables
from .registry import query


def iso_date():
    return F.date_format("date", "yyyy-MM-dd").alias("date")


@query(
    "author_positions", "W8",
    "SELECT position, count(*) AS n, count(first_author) AS with_first_author FROM auth GROUP BY 1",
)
def _(t: Tables):
    return t.authorships.groupBy("position").agg(F.count("*").alias("n"), F.count("first_author").alias("with_first_author"))


@query("last_author_papers", "W8", "SELECT work_id, person_id, first_author FROM auth WHERE first_author IS NOT NULL")
def _(t: Tables):
    return t.authorships.where(F.col("first_author").isNotNull()).select("work_id", "person_id", "first_author")


@query(
    "recent_works", "W3 S2",
    "SELECT person_id, work_id, title, strftime(d, '%Y-%m-%d') AS date, position, recency FROM recent",
)
def _(t: Tables):
    return t.recent.select("person_id", "work_id", "title", iso_date(), "position", "recency")


@query(
    "works_of_tracked_people", "J1",
    """SELECT person_id, count(*) AS works, strftime(max(d), '%Y-%m-%d') AS newest FROM pubs
    WHERE person_id IN (SELECT person_id FROM people WHERE h >= 20) GROUP BY 1""",
)
def _(t: Tables):
    tracked = t.authors.where("h_index >= 20")
    mine = W.works_of(tracked, t.works, t.authorships)
    return mine.groupBy("person_id").agg(
        F.count("*").alias("works"), F.date_format(F.max("date"), "yyyy-MM-dd").alias("newest")
    )


@query(
    "works_at_institutions", "J2",
    """SELECT yr AS year, count(*) AS works FROM works WHERE work_id IN (
      SELECT l_orderkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
      WHERE s_nationkey < 3 OR s_nationkey BETWEEN 20 AND 22) GROUP BY 1""",
)
def _(t: Tables):
    homes = t.authorship_lines.join(t.authors.select("person_id", "institution_id"), "person_id")
    tracked = t.institutions.where("institution_id < 3")
    return W.works_at(t.works, homes, tracked).groupBy("year").agg(F.count("*").alias("works"))


@query("role_counts", "A5", "SELECT person_id, fa AS first_author_recent, la AS last_author_recent, known AS recent_works FROM roles")
def _(t: Tables):
    return W.role_counts(t.recent)


@query("seniority", "F6 A5", "SELECT person_id, seniority AS seniority_score FROM scored")
def _(t: Tables):
    return W.with_seniority(t.authors, W.role_counts(t.recent)).select("person_id", "seniority_score")


@query(
    "lab_sizes", "A6",
    """SELECT person_id, count(DISTINCT first_author) AS lab_first_authors, count(*) AS lab_senior_papers
    FROM recent WHERE position = 'last' GROUP BY 1 HAVING count(first_author) > 0""",
)
def _(t: Tables):
    return W.lab_sizes(t.recent)


FUNDERS_SQL = """, counted AS (
  SELECT person_id, c_mktsegment AS funder, count(*) AS papers
  FROM recent JOIN works USING (work_id) JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
funder AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY papers DESC, funder) AS funder_rank FROM counted)
"""


@query("top_funders", "A7 S2", FUNDERS_SQL + "SELECT person_id, funder, papers, funder_rank FROM funder WHERE funder_rank <= 3")
def _(t: Tables):
    return W.top_funders(t.recent, W.work_funder_labels(t.work_funders))


@query(
    "merged_lab_signals", "A8",
    """, half AS (SELECT *, yr < 2001 AS older FROM pubs WHERE d <= DATE '2001-08-01'),
    newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id, older ORDER BY d DESC, work_id) AS k FROM half) WHERE k <= 5),
    lab AS (SELECT person_id, older, count(DISTINCT first_author) FILTER (position = 'last') AS fa, count(*) FILTER (position = 'last') AS sp
            FROM newest GROUP BY ALL HAVING count(first_author) > 0),
    fund AS (SELECT person_id, older, funder, row_number() OVER (PARTITION BY person_id, older ORDER BY n DESC, funder) AS k FROM (
       SELECT person_id, older, c_mktsegment AS funder, count(*) AS n FROM newest JOIN orders ON work_id = o_orderkey
       JOIN customer ON o_custkey = c_custkey GROUP BY ALL)),
    united AS (SELECT person_id, funder, min(k + CASE WHEN older THEN 10 ELSE 0 END) AS k FROM fund WHERE k <= 3 GROUP BY ALL),
    joined AS (SELECT person_id, string_agg(funder, '|' ORDER BY k) AS recent_funders FROM (
       SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY k) AS r FROM united) WHERE r <= 3 GROUP BY 1)
    SELECT j.person_id, recent_funders,
      CASE WHEN n.fa IS NOT NULL AND n.fa >= coalesce(o.fa, 0) THEN n.fa ELSE o.fa END AS lab_first_authors,
      CASE WHEN n.fa IS NOT NULL AND n.fa >= coalesce(o.fa, 0) THEN n.sp ELSE o.sp END AS lab_senior_papers
    FROM joined j LEFT JOIN (SELECT * FROM lab WHERE older) o USING (person_id) LEFT JOIN (SELECT * FROM lab WHERE NOT older) n USING (person_id)""",
)
def _(t: Tables):
    pubs, funders = t.publications, W.work_funder_labels(t.work_funders)
    old = W.lab_signals(W.recent_works(pubs.where("year < 2001"), AS_OF), funders)
    new = W.lab_signals(W.recent_works(pubs.where("year >= 2001"), AS_OF), funders)
    return W.merge_lab_signals(old, new).withColumn("recent_funders", F.array_join("recent_funders", "|"))


@query(
    "output_counts", "A3 A4 F8",
    """, c AS (SELECT person_id, CAST(coalesce(sum(n) FILTER (yr IN (1998, 1999, 2000)), 0) AS BIGINT) AS r,
      CAST(coalesce(sum(n) FILTER (yr IN (1995, 1996, 1997)), 0) AS BIGINT) AS p, max(yr) AS y FROM years GROUP BY 1)
    SELECT person_id, r AS works_recent_3y, p AS works_prior_3y, y AS last_publication_year,
      CASE WHEN r >= 3 AND r >= p * 1.25 THEN 'rising' WHEN p >= 3 AND r <= p * 0.6 THEN 'declining' ELSE 'steady' END AS output_trend FROM c""",
)
def _(t: Tables):
    return W.with_trend(W.output_counts(t.year_counts, AS_OF)).drop("has_lab_signals")


@query(
    "merged_publications", "U2",
    """, o AS (SELECT person_id, work_id, title, d, CAST(NULL AS VARCHAR) AS position FROM pubs WHERE yr BETWEEN 1999 AND 2000),
    n AS (SELECT person_id, work_id, 'New ' || title AS title, d, position FROM pubs WHERE yr >= 2000),
    m AS (SELECT person_id, work_id, coalesce(o.title, n.title) AS title, coalesce(o.d, n.d) AS d, coalesce(o.position, n.position) AS position
          FROM o FULL JOIN n USING (person_id, work_id))
    SELECT person_id, work_id, title, strftime(d, '%Y-%m-%d') AS date, position, recency FROM (
      SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY d DESC, work_id) AS recency FROM m) WHERE recency <= 5""",
)
def _(t: Tables):
    pubs = t.publications.select("person_id", "work_id", "title", "year", "date", "position")
    old = pubs.where(F.col("year").between(1999, 2000)).withColumn("position", F.lit(None).cast("string"))
    new = pubs.where("year >= 2000").withColumn("title", F.concat(F.lit("New "), "title"))
    return W.merge_publications(old, new).select("person_id", "work_id", "title", iso_date(), "position", "recency")


@query(
    "added_publications", "U4",
    """, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY d DESC, work_id) AS k FROM pubs WHERE yr < 2001) WHERE k <= 5)
    SELECT person_id, count(*) AS added FROM recent r WHERE NOT EXISTS (
      SELECT 1 FROM o WHERE o.person_id = r.person_id AND o.work_id = r.work_id) GROUP BY 1""",
)
def _(t: Tables):
    old = W.recent_works(t.publications.where("year < 2001"), AS_OF)
    return W.added_publications(old, t.recent).groupBy("person_id").agg(F.count("*").alias("added"))


# --- topics --------------------------------------------------------------------------------------

@query("domain_weights", "A1 S1", "SELECT person_id, domain_rank, domain, weight FROM dom WHERE weight > 0")
def _(t: Tables):
    return T.domain_weights(t.author_topics)


@query("primary_domain", "A2", "SELECT person_id, primary_domain FROM prim")
def _(t: Tables):
    return T.primary_domain(t.author_topics)


@query(
    "domain_names", "F16",
    """SELECT person_id, primary_domain, primary_domain || '|' || string_agg(domain, '|' ORDER BY weight DESC, domain_rank) AS domains
    FROM dom JOIN prim USING (person_id) WHERE weight > 0 GROUP BY person_id, primary_domain""",
)
def _(t: Tables):
    both = T.domain_arrays(T.domain_weights(t.author_topics), T.primary_domain(t.author_topics))
    return T.with_domain_names(both).select("person_id", "primary_domain", F.array_join("domains", "|").alias("domains"))


@query("topic_tags", "A9", "SELECT person_id, rk AS tag_rank, tag FROM ttags")
def _(t: Tables):
    return T.topic_tags(t.author_topics)


@query("work_keywords", "A10 S2", "SELECT work_id, keyword, score FROM kw")
def _(t: Tables):
    return T.work_keywords(t.work_keywords).select("work_id", "keyword", "score")


@query("keyword_tags", "A11", "SELECT person_id, rk AS tag_rank, tag FROM ktags")
def _(t: Tables):
    return T.keyword_tags(t.recent, T.work_keywords(t.work_keywords), T.topic_tags(t.author_topics))


def tags_of(t: Tables, once=store):
    """Everyone's tags. Topics and newest works, a handful of rows per person, are read twice and so written first."""
    topics, recent = once(T.topic_tags(t.author_topics)), once(t.recent)
    return T.person_tags(topics, T.keyword_tags(recent, T.work_keywords(t.keywords_of(recent)), topics))


@query("person_tags", "A12", "SELECT person_id, pos, tag, kind FROM ptags")
def _(t: Tables):
    return tags_of(t)


@query("tag_vocabulary", "A13", "SELECT tag_id, tag, people, kind FROM vocab")
def _(t: Tables):
    return T.tag_vocabulary(tags_of(t))


@query(
    "tag_synonyms", "A14 S3",
    """SELECT tag, subfield, keywords FROM vocab JOIN (
      SELECT p_name AS tag, min(p_type) AS subfield, string_agg(DISTINCT lower(p_type), '|' ORDER BY lower(p_type)) AS keywords FROM part GROUP BY 1) USING (tag)
    WHERE kind = 't'""",
)
def _(t: Tables):
    out = T.tag_synonyms(T.tag_counts(tags_of(t)), t.topics)
    return out.select("tag", "subfield", F.array_join("keywords", "|").alias("keywords"))


@query("domain_list", "A15", "SELECT DISTINCT domain FROM (SELECT domain FROM dom WHERE weight > 0 UNION ALL SELECT primary_domain FROM prim)")
def _(t: Tables):
    return T.domain_list(T.domain_arrays(T.domain_weights(t.author_topics), T.primary_domain(t.author_topics)))
