"""Registry of the queries over the synthetic tables, each with its SQL check where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .bindings import Tables


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register `fn(tables)`; with `sql`, the common table expressions below are put in front."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, covers, lambda spark, root: fn(Tables(spark, root)), BASE + sql if sql else None)
        return fn

    return register


# The bindings of bindings.py written again in SQL, in another shape (windows instead of aggregates).
BASE = """
WITH inst AS (
  SELECT n_nationkey AS institution_id, n_name AS institution_name, r_name AS country_code, n_nationkey + 1 AS rnk
  FROM nation, region WHERE n_regionkey = r_regionkey),
lines AS (
  SELECT l_orderkey AS work_id, l_suppkey AS person_id, min(l_linenumber) AS place FROM lineitem GROUP BY ALL),
placed AS (
  SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY work_id) AS authors, first_value(person_id) OVER w AS fa
  FROM lines WINDOW w AS (PARTITION BY work_id ORDER BY place, person_id)),
auth AS (
  SELECT work_id, person_id, CASE WHEN rn = 1 THEN 'first' WHEN rn = authors THEN 'last' ELSE 'middle' END AS position,
         CASE WHEN rn = authors AND rn > 1 THEN fa END AS first_author FROM placed),
works AS (
  SELECT o_orderkey AS work_id, 'Study ' || o_orderkey || ' of ' || o_orderpriority AS title,
         year(o_orderdate) AS yr, CAST(o_orderdate AS DATE) AS d, o_custkey FROM orders),
pubs AS (SELECT a.*, w.title, w.yr, w.d FROM auth a JOIN works w USING (work_id)),
recent AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY d DESC, work_id) AS recency FROM pubs
                 WHERE d <= DATE '2001-08-01') WHERE recency <= 5),
metrics AS (
  SELECT l_suppkey AS person_id, CAST(sum(l_quantity) AS BIGINT) AS cites, count(DISTINCT l_orderkey) AS nworks
  FROM lineitem GROUP BY 1),
people AS (
  SELECT s_suppkey AS person_id, s_name AS name, s_nationkey AS institution_id,
         greatest(0, CAST(floor(s_acctbal / 200) AS INT)) AS h, coalesce(cites, 0) AS cites, coalesce(nworks, 0) AS nworks
  FROM supplier LEFT JOIN metrics ON s_suppkey = person_id),
years AS (SELECT person_id, yr, count(*) AS n FROM pubs GROUP BY ALL),
topics AS (
  SELECT l_suppkey AS person_id, p_name AS topic, p_type AS subfield, p_brand AS field, count(*) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
sub AS (SELECT person_id, subfield, sum(n) AS n FROM topics GROUP BY ALL),
dom AS (
  SELECT person_id, subfield AS domain, rk AS domain_rank,
         CAST(round(CAST(n * 1.0 / tot AS DECIMAL(18, 12)), 2) AS DOUBLE) AS weight
  FROM (SELECT *, sum(n) OVER (PARTITION BY person_id) AS tot,
               row_number() OVER (PARTITION BY person_id ORDER BY n DESC, subfield) AS rk FROM sub) WHERE rk <= 5),
prim AS (
  SELECT person_id, field AS primary_domain FROM (
    SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY n DESC, field DESC) AS rk
    FROM (SELECT person_id, field, sum(n) AS n FROM topics GROUP BY ALL)) WHERE rk = 1),
roles AS (
  SELECT person_id, count(*) FILTER (position = 'first') AS fa, count(*) FILTER (position = 'last') AS la, count(*) AS known
  FROM recent GROUP BY 1),
scored AS (
  SELECT p.*, coalesce(fa, 0) AS fa, coalesce(la, 0) AS la, coalesce(known, 0) AS known,
         CAST(round(100 * (0.4 * least(h / 60.0, 1) + 0.25 * least(log10(nworks + 1) / 3, 1) + 0.2 * least(log10(cites + 1) / 5, 1)
              + CASE WHEN coalesce(known, 0) > 0 THEN 0.15 * la / known ELSE 0 END)
              / CASE WHEN coalesce(known, 0) > 0 THEN 1 ELSE 0.85 END) AS INT) AS seniority
  FROM people p LEFT JOIN roles USING (person_id)),
ttags AS (
  SELECT person_id, topic AS tag, rk FROM (
    SELECT person_id, topic, row_number() OVER (PARTITION BY person_id ORDER BY max(n) DESC, topic) AS rk
    FROM topics GROUP BY person_id, topic) WHERE rk <= 6),
kw AS (
  SELECT l_orderkey AS work_id, 'K ' || p_brand AS keyword, CAST(round(CAST(max(l_quantity) / 50 AS DECIMAL(18, 9)), 2) AS DOUBLE) AS score
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL HAVING max(l_quantity) / 50 >= 0.3),
ktags AS (
  SELECT person_id, keyword AS tag, rk FROM (
    SELECT person_id, keyword, row_number() OVER (PARTITION BY person_id ORDER BY round(sum(score), 6) DESC, lower(keyword)) AS rk
    FROM recent JOIN kw USING (work_id) GROUP BY person_id, keyword) WHERE rk <= 3),
ptags AS (
  SELECT person_id, tag, kind, row_number() OVER (PARTITION BY person_id ORDER BY kind DESC, rk) - 1 AS pos
  FROM (SELECT *, 't' AS kind FROM ttags UNION ALL SELECT *, 'k' AS kind FROM ktags) QUALIFY pos < 8),
vocab AS (
  SELECT tag, count(*) AS people, max(kind) AS kind, row_number() OVER (ORDER BY count(*) DESC, tag) - 1 AS tag_id
  FROM ptags GROUP BY tag),
contact AS (
  SELECT s_suppkey AS person_id,
    CASE s_suppkey % 7 WHEN 0 THEN 'Associate Professor of Widgets' WHEN 1 THEN 'PhD Student' WHEN 2 THEN 'Postdoctoral Fellow'
      WHEN 3 THEN 'Emeritus Professor' WHEN 4 THEN 'Research Scientist' WHEN 5 THEN 'Lecturer' END AS title,
    CASE WHEN s_suppkey % 3 = 0 THEN 's' || s_suppkey || '@nation' || s_nationkey || '.ac.uk' END AS email,
    CASE WHEN s_suppkey % 5 <> 4 THEN 'https://nation' || s_nationkey || '.ac.uk/p/' || s_suppkey END AS profile_url,
    CASE WHEN s_suppkey % 5 < 2 THEN 'directory' WHEN s_suppkey % 5 = 2 THEN 'orcid' WHEN s_suppkey % 5 = 3 THEN 'openalex' END AS source
  FROM supplier)
"""
