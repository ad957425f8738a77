"""Queries on keyword search, concepts and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import cut_lineage, side_by_side, store
from ..operators import concepts as K
from ..operators import people as P
from ..operators import topics as T
from ..operators import vectors as X
from .bindings import Tables
from .match import hybrid_matches, match_people
from .people_queries import ROWS_SQL, catalog, records, scored
from .registry import query
from .work_queries import tags_of

# A small synonym list for the words of the part names; any table of this shape can be passed.
GROUPS = [
    (0, 0, "ring", False), (0, 1, "rod", False), (0, 2, "bolts", True),
    (1, 0, "blue", False), (1, 1, "cold", False),
    (2, 0, "promo", False), (2, 1, "economy", False),
    (3, 0, "widgets", False), (3, 1, "gizmo", False), (3, 2, "gear", True),
]


def synonym_groups(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(GROUPS, "group_id int, term_pos int, term string, narrower boolean")


# --- keyword search -----------------------------------------------------------------------------------

@query(
    "token_index", "T1",
    """SELECT token, count(*) AS places FROM (SELECT unnest(string_split(lower(name), '#')) AS token FROM people
      UNION ALL SELECT unnest(string_split(lower(title), ' ')) FROM contact WHERE title IS NOT NULL) GROUP BY 1""",
)
def _(t: Tables):
    return K.token_index(records(t)).groupBy("token").agg(F.count("*").alias("places"))


SEARCH_SQL = ROWS_SQL + """, hit AS (SELECT person_id, 0 AS tier FROM rows WHERE {cond}
  UNION ALL SELECT person_id, 1 FROM rows WHERE lower(institution_name) LIKE '%{q}%'
  UNION ALL SELECT person_id, 1 FROM rowdom WHERE lower(domain) LIKE '%{q}%')
SELECT person_id, min(tier) AS tier FROM hit GROUP BY 1"""


@query("keyword_search_indexed", "T2", SEARCH_SQL.format(cond="title LIKE '%Professor%'", q="prof"))
def _(t: Tables):
    rows = catalog(t)
    return K.keyword_search(rows, "Prof", K.token_index(rows)).select("person_id", "tier")


@query("keyword_search_two_words", "T2", SEARCH_SQL.format(cond="title LIKE '%Associate Professor%' OR title LIKE '%Emeritus Professor%' AND false", q="prof ass"))
def _(t: Tables):
    rows = catalog(t)
    return K.keyword_search(rows, "prof ass", K.token_index(rows)).select("person_id", "tier")


@query("keyword_search_scan", "T2", SEARCH_SQL.format(cond="lower(concat_ws(' ', name, title)) LIKE '%brand#1%'", q="brand#1"))
def _(t: Tables):
    return K.keyword_search(catalog(t), "brand#1").select("person_id", "tier")


@query(
    "order_by_keyword_rank", "K2 T2",
    ROWS_SQL + """, hit AS (SELECT person_id, 0 AS tier FROM rows WHERE title LIKE '%Professor%'
      UNION ALL SELECT person_id, 1 FROM rowdom WHERE domain LIKE '%prof%'),
    best AS (SELECT person_id, min(tier) AS tier FROM hit GROUP BY 1)
    SELECT person_id, row_number() OVER (ORDER BY tier, CASE WHEN title LIKE 'Professor%' THEN 2 ELSE 3 END, person_id) AS place FROM best JOIN rows USING (person_id) QUALIFY place <= 24""",
)
def _(t: Tables):
    rows = catalog(t)
    hits = K.keyword_search(rows, "Prof", K.token_index(rows))
    first = P.page(rows.join(hits, "person_id"), 0, 24, "relevance")
    return first.select("person_id", (F.monotonically_increasing_id() + 1).alias("place"))


# --- concepts ------------------------------------------------------------------------------------------

STOP_SQL = """('a','an','and','are','as','at','be','by','for','from','in','into','is','of','on','or','the','to','with','within','via','its','their','our','we','using','use','used','based','toward','towards')"""


@query(
    "concept_words", "T3",
    """, w AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+(?:[''’][a-z]+)?')), '[''’]s$', '') AS w FROM documents),
    b AS (SELECT doc_id, replace(replace(w, '''', ''), '’', '') AS w FROM w),
    s AS (SELECT doc_id, CASE WHEN length(w) <= 3 THEN w WHEN suffix(w, 'ies') AND length(w) > 4 THEN w[:-4] || 'y'
        WHEN suffix(w, 'sses') OR suffix(w, 'xes') OR suffix(w, 'ches') OR suffix(w, 'shes') THEN w[:-3]
        WHEN suffix(w, 's') AND NOT (suffix(w, 'ss') OR suffix(w, 'us') OR suffix(w, 'is')) THEN w[:-2] ELSE w END AS w FROM b)
    SELECT doc_id, count(*) FILTER (w <> '' AND w NOT IN """ + STOP_SQL + """) AS words,
      CAST(coalesce(sum(length(w)) FILTER (w NOT IN """ + STOP_SQL + """), 0) AS BIGINT) AS letters FROM documents LEFT JOIN s USING (doc_id) GROUP BY 1""",
)
def _(t: Tables):
    words = K.with_concept_tokens(t.texts("documents"), "text", "tokens").select("doc_id", F.explode_outer("tokens").alias("w"))
    return words.groupBy("doc_id").agg(F.count("w").alias("words"), F.coalesce(F.sum(F.length("w")), F.lit(0)).alias("letters"))


def concept_queries(t: Tables) -> DataFrame:
    """One query per brand: the name of its first part and the type of its last."""
    return t.raw("part").groupBy(F.col("p_brand").alias("query_id")).agg(
        F.concat(F.min_by("p_name", "p_partkey"), F.lit(" and "), F.lower(F.max_by("p_type", "p_partkey"))).alias("text")
    )


CONCEPT_SQL = """, q AS (SELECT p_brand AS query_id, arg_min(p_name, p_partkey) AS a, lower(arg_max(p_type, p_partkey)) AS b FROM part GROUP BY 1),
g(gid, tpos, term, narrower) AS (VALUES (0,0,'ring',false),(0,1,'rod',false),(0,2,'bolt',true),(1,0,'blue',false),(1,1,'cold',false),
  (2,0,'promo',false),(2,1,'economy',false),(3,0,'widget',false),(3,1,'gizmo',false),(3,2,'gear',true)),
syn AS (SELECT x.term AS word, y.term AS m, CASE WHEN y.narrower THEN 0.75 ELSE 0.9 END::DOUBLE AS w, x.gid * 100 + y.narrower::INT * 10 + y.tpos AS o
  FROM g x JOIN g y USING (gid) WHERE NOT x.narrower AND (y.narrower OR x.term <> y.term)),
two AS (SELECT *, split_part(a, ' ', 1) AS adj, split_part(a, ' ', 2) AS noun FROM q),
alt0 AS (
  SELECT query_id, 0 AS concept_pos, 0 AS o, a AS label, CASE WHEN adj = 'new' THEN noun ELSE a END AS toks, 1.0::DOUBLE AS w FROM two
  UNION ALL SELECT query_id, 0, 10000 + o, m, m, w FROM two JOIN syn ON word = noun WHERE adj = 'new'
  UNION ALL SELECT query_id, 0, 20000 + o, m || ' ' || noun, m || ' ' || noun, round(w * 0.95, 9) FROM two JOIN syn ON word = adj
  UNION ALL SELECT query_id, 0, 30000 + o, adj || ' ' || m, CASE WHEN adj = 'new' THEN m ELSE adj || ' ' || m END, round(w * 0.95, 9) FROM two JOIN syn ON word = noun
  UNION ALL SELECT query_id, 1, 0, b, b, 1.0 FROM two
  UNION ALL SELECT query_id, 1, 10000 + o, m, m, w FROM two JOIN syn ON word = b),
alt AS (SELECT query_id, concept_pos, toks, string_split(toks, ' ') AS words, arg_min(label, o) AS label, arg_min(w, o) AS w, min(o) AS o FROM alt0 GROUP BY query_id, concept_pos, toks),
tsyn AS (SELECT tag, lower(min(p_type)) AS subfield, list(DISTINCT lower(p_type)) AS keywords FROM part JOIN (SELECT tag FROM vocab WHERE kind = 't') ON tag = p_name GROUP BY 1),
txt AS (SELECT tag, 0 AS kind, string_split(regexp_replace(lower(tag), '[# ]+', ' ', 'g'), ' ') AS t, 1.0::DOUBLE AS f FROM vocab
  UNION ALL SELECT tag, 1, [unnest(keywords)], 0.8 FROM tsyn UNION ALL SELECT tag, 2, [subfield], 0.6 FROM tsyn),
hits AS (SELECT query_id, concept_pos, tag, o, max(round(w * f, 9)) AS w FROM alt, txt WHERE list_has_all(t, words) GROUP BY ALL),
reach AS (SELECT query_id, concept_pos, tag, round(max(w) * CASE WHEN people * 1.0 / top >= 0.5 THEN 0.5 ELSE 1 - people::DOUBLE / top END, 9) AS weight
  FROM hits JOIN vocab USING (tag), (SELECT max(people) AS top FROM vocab) GROUP BY query_id, concept_pos, tag, people, top)
"""


def concept_parts(t: Tables):
    """Concepts of the queries and their alternatives, a few rows per query, computed once."""
    parsed = cut_lineage(K.parse_concepts(concept_queries(t)).where("reason IS NULL"))
    return parsed, cut_lineage(K.expand_concepts(parsed, synonym_groups(t)))


def stored_tags(t: Tables) -> DataFrame:
    """Everyone's tags, computed once: matching reads them several times."""
    return store(tags_of(t))


def reached_tags(t: Tables, tags: DataFrame):
    parsed, alternatives = concept_parts(t)
    vocabulary = cut_lineage(T.tag_counts(tags))
    return parsed, alternatives, K.concept_tags(alternatives, vocabulary, T.tag_synonyms(vocabulary, t.topics))


@query(
    "parsed_concepts", "T4",
    """SELECT p_partkey AS query_id, u.i - 1 AS concept_pos, CASE u.i WHEN 1 THEN p_name WHEN 2 THEN 'the analysis' WHEN 3 THEN p_type ELSE 'of the' END AS concept,
      CASE u.i WHEN 2 THEN 'too general' WHEN 4 THEN 'no words to match' END AS reason FROM part, (SELECT unnest([1, 2, 3, 4]) AS i) u""",
)
def _(t: Tables):
    texts = t.raw("part").select(
        F.col("p_partkey").alias("query_id"), F.concat("p_name", F.lit(" + the  analysis AND "), "p_type", F.lit("; of the,")).alias("text")
    )
    return K.parse_concepts(texts)


@query(
    "concept_alternatives", "T5",
    CONCEPT_SQL + "SELECT query_id, concept_pos, label, toks AS tokens, w AS weight FROM alt",
)
def _(t: Tables):
    _, alternatives = concept_parts(t)
    return alternatives.select("query_id", "concept_pos", "label", F.array_join("tokens", " ").alias("tokens"), "weight")


@query("concept_tags", "T6 T7", CONCEPT_SQL + "SELECT query_id, concept_pos, tag, weight FROM reach")
def _(t: Tables):
    return reached_tags(t, stored_tags(t))[2].select("query_id", "concept_pos", "tag", "weight")


@query(
    "concept_reach", "T9",
    CONCEPT_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, concept_pos ORDER BY weight DESC, tag) AS k, count(*) OVER (PARTITION BY query_id, concept_pos) AS tags FROM reach)
    SELECT query_id, concept_pos, tags, string_agg(tag, '|' ORDER BY k) AS examples FROM r WHERE k <= 6 GROUP BY ALL""",
)
def _(t: Tables):
    return K.concept_reach(reached_tags(t, stored_tags(t))[2]).withColumn("examples", F.array_join("examples", "|"))


SCORE_SQL = CONCEPT_SQL + """, hit AS (SELECT query_id, concept_pos, person_id, tag, pos, round(weight / (1 + 0.15 * pos), 9) AS h FROM ptags JOIN reach USING (tag)),
best AS (SELECT query_id, concept_pos, person_id, max(h) AS h, arg_min(tag, (-h, pos)) AS tag FROM hit GROUP BY ALL),
total AS (SELECT query_id, person_id, round(sum(h) / 2, 6) AS score, count(*) AS matched FROM best GROUP BY ALL)
"""


@query("concept_scores", "T8", SCORE_SQL + "SELECT query_id, person_id, score, matched FROM total")
def _(t: Tables):
    tags = stored_tags(t)
    parsed, _, reached = reached_tags(t, tags)
    return K.score_concepts(tags, reached, parsed)[0].drop("concepts")


@query("concept_evidence", "T8", SCORE_SQL + "SELECT query_id, concept_pos, person_id, tag, h AS hit FROM best")
def _(t: Tables):
    tags = stored_tags(t)
    parsed, _, reached = reached_tags(t, tags)
    return K.score_concepts(tags, reached, parsed)[1].drop("via")


@query(
    "concept_scores_without_tags", "T8",
    ROWS_SQL + CONCEPT_SQL.replace("WITH", "") + """,
    d AS (SELECT person_id, domain, CASE WHEN domain_rank IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY person_id ORDER BY weight DESC NULLS LAST, domain_rank) END AS pos
          FROM (SELECT person_id, domain, domain_rank, weight FROM dom WHERE weight > 0 UNION ALL SELECT person_id, primary_domain, NULL, NULL FROM prim)),
    byd AS (SELECT query_id, concept_pos, person_id, max(round(w * 0.6 / (1 + 0.15 * pos), 9)) AS h FROM d JOIN alt ON list_has_all(string_split(lower(replace(domain, '#', ' ')), ' '), words) GROUP BY ALL),
    byt AS (SELECT query_id, concept_pos, person_id, max(round(w * 0.4, 9)) AS h FROM contact JOIN alt ON list_has_all(string_split(lower(replace(title, 'Widgets', 'Widget')), ' '), words)
            WHERE NOT EXISTS (SELECT 1 FROM byd b WHERE b.query_id = alt.query_id AND b.concept_pos = alt.concept_pos AND b.person_id = contact.person_id) GROUP BY ALL)
    SELECT query_id, person_id, round(sum(h) / 2, 6) AS score, count(*) AS matched FROM (SELECT * FROM byd UNION ALL SELECT * FROM byt) GROUP BY ALL""",
)
def _(t: Tables):
    tags = stored_tags(t)
    parsed, alternatives, reached = reached_tags(t, tags)
    no_tags = tags.where("tag IS NULL")
    return K.score_concepts(no_tags, reached, parsed, records(t), alternatives)[0].drop("concepts")


@query("people_for_all_concepts", "U5", SCORE_SQL + "SELECT query_id, count(*) AS people FROM total WHERE matched = 2 GROUP BY 1")
def _(t: Tables):
    tags = stored_tags(t)
    parsed, _, reached = reached_tags(t, tags)
    return K.combine_concepts(K.score_concepts(tags, reached, parsed)[0]).groupBy("query_id").agg(F.count("*").alias("people"))


@query("people_for_any_concept", "U5", SCORE_SQL + "SELECT query_id, count(*) AS people FROM total GROUP BY 1")
def _(t: Tables):
    tags = stored_tags(t)
    parsed, _, reached = reached_tags(t, tags)
    return K.combine_concepts(K.score_concepts(tags, reached, parsed)[0], "any").groupBy("query_id").agg(F.count("*").alias("people"))


@query(
    "order_by_relevance", "K2 U5",
    SCORE_SQL + """, one AS (SELECT person_id, max(matched) AS m, max(score) AS s FROM total GROUP BY 1)
    SELECT person_id, row_number() OVER (ORDER BY m DESC, 0.5 * s + 0.5 * round(h / 50.0, 2) DESC, cites DESC, person_id) AS place FROM one JOIN people USING (person_id) QUALIFY place <= 24""",
)
def _(t: Tables):
    tags = stored_tags(t)
    parsed, _, reached = reached_tags(t, tags)
    hits = K.score_concepts(tags, reached, parsed)[0].groupBy("person_id").agg(
        F.max("matched").alias("concepts_matched"), F.max("score").alias("concept_score")
    )
    rows = t.authors.join(hits, "person_id").withColumn("match_score", F.round(F.col("h_index") / 50, 2))
    return P.page(rows, 0, 24, "relevance").select("person_id", (F.monotonically_increasing_id() + 1).alias("place"))


PROFILE_SQL = """, prof AS (SELECT o_custkey AS profile_id, min(p_name) AS said, max(p_name) AS told, max(p_name) || ' in ' || min(p_brand) AS text FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1)
"""
TAGGING_SQL = """, cand AS (SELECT tag, people, list_filter(string_split(lower(replace(tag, '#', ' ')), ' '), lambda x: x <> 'new') AS w, (SELECT max(people) FROM vocab) AS top FROM vocab),
words AS (SELECT *, list_filter(string_split(said, ' '), lambda x: x <> 'new') AS s, list_filter(string_split(lower(replace(text, '#', ' ')), ' '), lambda x: x NOT IN ('new', 'in')) AS x FROM prof),
fit AS (SELECT profile_id, tag, round((CASE WHEN list_has_all(s, w) THEN 2.0 ELSE least(1.0, 0.5 + 0.25 * len(w)) END)::DOUBLE * (1 - people::DOUBLE / top), 9) AS weight
  FROM words, cand WHERE people::DOUBLE / top <= 0.2 AND list_has_all(list_concat(s, x), w)),
ptag AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY weight DESC, tag) AS tag_rank FROM fit QUALIFY tag_rank <= 12)
"""


def customer_profiles(t: Tables) -> DataFrame:
    lines = t.raw("lineitem").select("l_orderkey", "l_partkey").join(
        t.raw("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    parts = t.raw("part").select("p_partkey", "p_name", "p_brand")
    per_customer = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("o_custkey").alias("profile_id"))
    return per_customer.agg(
        F.array(F.min("p_name")).alias("interests"), F.lit(None).cast("string").alias("summary"),
        F.concat(F.max("p_name"), F.lit(" in "), F.min("p_brand")).alias("text"),
    )


def brand_profiles(t: Tables) -> DataFrame:
    return t.raw("part").groupBy(F.col("p_brand").alias("profile_id")).agg(
        F.array(F.min_by("p_name", "p_partkey")).alias("interests"), F.lit(None).cast("string").alias("summary"),
        F.max_by("p_name", "p_partkey").alias("text"),
    )


BRAND_SQL = """, prof AS (SELECT p_brand AS profile_id, arg_min(p_name, p_partkey) AS said, arg_max(p_name, p_partkey) AS text FROM part GROUP BY 1)
"""


@query("profile_tags", "T10", PROFILE_SQL + TAGGING_SQL + "SELECT profile_id, tag, weight, tag_rank FROM ptag")
def _(t: Tables):
    return K.profile_tags(customer_profiles(t), cut_lineage(T.tag_counts(stored_tags(t))))


OVERLAP_SQL = BRAND_SQL + TAGGING_SQL + """, ov AS (SELECT profile_id, person_id, round(least(1, sum(weight / mx / (1 + 0.15 * pos)) / 2), 6) AS overlap
  FROM ptag JOIN (SELECT profile_id, max(weight) AS mx FROM ptag GROUP BY 1) USING (profile_id) JOIN ptags USING (tag) GROUP BY ALL)
"""


@query("profile_overlap", "T11", OVERLAP_SQL + "SELECT profile_id, person_id, overlap FROM ov")
def _(t: Tables):
    tags = stored_tags(t)
    return K.profile_overlap(K.profile_tags(brand_profiles(t), cut_lineage(T.tag_counts(tags))), tags)


@query(
    "suggested_tags", "T12",
    PROFILE_SQL + TAGGING_SQL + """SELECT profile_id, row_number() OVER (PARTITION BY profile_id ORDER BY weight DESC, tag) AS place, tag, weight FROM ptag JOIN prof USING (profile_id)
    WHERE lower(tag) <> said QUALIFY place <= 8""",
)
def _(t: Tables):
    profiles = store(customer_profiles(t))
    used = profiles.select("profile_id", F.upper(F.get("interests", F.lit(0))).alias("concept"))
    return K.suggest_tags(K.profile_tags(profiles, cut_lineage(T.tag_counts(stored_tags(t)))), used)


# --- vectors ----------------------------------------------------------------------------------------------

def people_vectors(t: Tables) -> DataFrame:
    return t.raw("embeddings").select(
        F.col("vec_id").alias("person_id"), F.col("label").alias("institution_id"), F.col("embedding").alias("vector")
    )


def label_profiles(t: Tables) -> DataFrame:
    """One profile per label: its first vector."""
    return t.raw("embeddings").groupBy(F.col("label").alias("profile_id")).agg(F.min_by("embedding", "vec_id").alias("vector"))


def label_centroids(t: Tables) -> DataFrame:
    return X.with_unit(label_profiles(t).select(F.col("profile_id").alias("cluster"), "vector"), "vector")


VEC_SQL = """, v AS (SELECT vec_id AS person_id, label AS institution_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT label AS profile_id, arg_min(embedding, vec_id)::DOUBLE[] AS pe FROM embeddings GROUP BY 1),
pair AS (SELECT profile_id, person_id, institution_id, round(list_cosine_similarity(pe, e), 6) AS score FROM p, v)
"""
RANKED_SQL = "SELECT profile_id, person_id, institution_id, score, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, person_id) AS rank FROM pair {} QUALIFY rank <= {}"


@query("exact_matches", "V4 K7", VEC_SQL + RANKED_SQL.format("", 20))
def _(t: Tables):
    return X.rank_cosine(label_profiles(t), people_vectors(t), 20)


@query("exact_matches_of_everyone", "V4 K7", VEC_SQL + """, everyone AS (SELECT a.person_id AS profile_id, b.person_id, b.institution_id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a, v b)
SELECT profile_id, person_id, score FROM everyone QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, person_id) <= 3""")
def _(t: Tables):
    v = people_vectors(t)
    return X.rank_cosine(v.select(F.col("person_id").alias("profile_id"), "vector"), v, 3).select("profile_id", "person_id", "score")


@query("matches_among_allowed", "V4 P5", VEC_SQL + RANKED_SQL.format("WHERE institution_id IN (SELECT r_regionkey FROM region)", 15))
def _(t: Tables):
    allowed = people_vectors(t).join(t.raw("region").select(F.col("r_regionkey").alias("institution_id")), "institution_id", "left_semi")
    return X.rank_cosine(label_profiles(t), people_vectors(t), 15, allowed)


@query("unit_vectors", "V2", """SELECT vec_id AS person_id, round(list_sum(list_transform(e, lambda x: x * 3 / n * x * 3 / n)), 6) AS squares, round(e[1] * 3 / n, 6) AS first
FROM (SELECT vec_id, embedding::DOUBLE[] AS e, 3 * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)""")
def _(t: Tables):
    tripled = people_vectors(t).withColumn("vector", F.transform("vector", lambda x: x.cast("double") * 3))
    unit = X.with_unit(tripled)
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    return unit.select("person_id", F.round(squares, 6).alias("squares"), F.round(F.get("vector", F.lit(0)), 6).alias("first"))


@query("quantized_vectors", "V3", """SELECT vec_id AS person_id, array_to_string(list_transform(embedding, lambda x: CAST(greatest(-127, least(127, round_even(x::DOUBLE * 127, 0))) AS INT)), ',') AS q FROM embeddings""")
def _(t: Tables):
    return X.quantize(people_vectors(t)).select("person_id", F.array_join(F.col("q").cast("array<string>"), ",").alias("q"))


QUANT_SQL = """, qv AS (SELECT vec_id AS person_id, label AS institution_id, list_transform(embedding, lambda x: greatest(-127, least(127, round_even(x::DOUBLE * 127, 0)))::DOUBLE) AS e FROM embeddings),
p AS (SELECT label AS profile_id, arg_min(embedding, vec_id)::DOUBLE[] AS pe FROM embeddings GROUP BY 1)
"""


@query("int8_matches", "V3 V4", QUANT_SQL + ", pair AS (SELECT profile_id, person_id, institution_id, round(list_cosine_similarity(pe, e), 6) AS score FROM p, qv) " + RANKED_SQL.format("", 20))
def _(t: Tables):
    return X.rank_cosine(label_profiles(t), X.quantize(people_vectors(t)), 20, value="q")


@query("dequantized_vectors", "V3", """, q AS (SELECT vec_id, list_transform(embedding, lambda x: round_even(x::DOUBLE * 127, 0)::DOUBLE) AS e FROM embeddings)
SELECT vec_id AS person_id, round(e[1] / sqrt(list_dot_product(e, e)), 6) + 0.0 AS first, round(e[64] / sqrt(list_dot_product(e, e)), 6) + 0.0 AS last FROM q""")
def _(t: Tables):
    back = X.dequantize(X.quantize(people_vectors(t)).drop("vector"))
    return back.select("person_id", (F.round(F.get("vector", F.lit(0)), 6) + 0.0).alias("first"), (F.round(F.get("vector", F.lit(63)), 6) + 0.0).alias("last"))


@query("packed_bits", "V5", """SELECT vec_id AS person_id, array_to_string(list_transform(range(0, 8), lambda j: printf('%02X', CAST(list_sum(list_transform(range(0, 8),
  lambda b: CASE WHEN round_even(embedding[j * 8 + b + 1]::DOUBLE * 127, 0) > 0 THEN 1 << (7 - b) ELSE 0 END)) AS INT))), '') AS bits FROM embeddings""")
def _(t: Tables):
    return X.pack_bits(X.quantize(people_vectors(t))).select("person_id", F.hex("bits").alias("bits"))


BITS_SQL = QUANT_SQL + """, pair AS (SELECT profile_id, person_id, institution_id, round(least(1, list_dot_product(pe, list_transform(e, lambda x: CASE WHEN x > 0 THEN 1.0 ELSE -1.0 END::DOUBLE))
  / sqrt(list_dot_product(pe, pe)) / (sqrt(64) * sqrt(2 / pi()))), 6) AS score FROM p, qv)
"""


@query("one_bit_matches", "V6", BITS_SQL + RANKED_SQL.format("", 20))
def _(t: Tables):
    return X.rank_bits(label_profiles(t), X.pack_bits(X.quantize(people_vectors(t))), 64, 20)


@query("one_bit_recall", "E4", VEC_SQL + ", exact AS (" + RANKED_SQL.format("", 10) + "), " + QUANT_SQL.split(",\np AS", 1)[0].lstrip(", ") + """,
 bpair AS (SELECT profile_id, person_id, round(least(1, list_dot_product(pe, list_transform(e, lambda x: CASE WHEN x > 0 THEN 1.0 ELSE -1.0 END::DOUBLE)) / sqrt(list_dot_product(pe, pe)) / (8 * sqrt(2 / pi()))), 6) AS score FROM p, qv),
 near AS (SELECT profile_id, person_id FROM bpair QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, person_id) <= 50)
 SELECT profile_id, count(n.person_id) AS found, count(*) AS wanted, round(count(n.person_id) / count(*), 6) AS recall FROM exact LEFT JOIN near n USING (profile_id, person_id) GROUP BY 1""")
def _(t: Tables):
    profiles, v = label_profiles(t), people_vectors(t)
    near = X.rank_bits(profiles, X.pack_bits(X.quantize(v)), 64, 50)
    return X.recall_at(X.rank_cosine(profiles, v, 10), near)


CLUSTER_SQL = """, assigned AS (SELECT v.*, (SELECT arg_min(profile_id, (-round(list_cosine_similarity(pe, e), 9), profile_id)) FROM p) AS cluster FROM v)
"""


@query("assigned_clusters", "V8", VEC_SQL + CLUSTER_SQL + "SELECT person_id, cluster FROM assigned")
def _(t: Tables):
    return X.assign_clusters(people_vectors(t), label_centroids(t)).select("person_id", "cluster")


@query("cluster_membership", "V7 V12", "SELECT count(*) AS people, count(DISTINCT vec_id) AS ids, 0 AS in_two_clusters, CAST(round(sqrt(count(*))) AS INT) AS clusters FROM embeddings")
def _(t: Tables):
    v = people_vectors(t)
    centroids = X.train_centroids(v, seed=7)
    assigned = X.assign_clusters(v, centroids)
    per_id = assigned.groupBy("person_id").agg(F.count_distinct("cluster").alias("n"))
    counts = assigned.agg(F.count("*").alias("people"), F.count_distinct("person_id").alias("ids"))
    doubled = per_id.agg(F.count_if(F.col("n") > 1).cast("int").alias("in_two_clusters"))
    k = centroids.agg(F.count("*").cast("int").alias("clusters"))
    return side_by_side(counts, doubled, k)


@query(
    "clustered_search", "V9 S14",
    VEC_SQL + CLUSTER_SQL + """, sizes AS (SELECT cluster, count(*) AS n FROM assigned GROUP BY 1),
    near AS (SELECT a.profile_id, b.profile_id AS cluster, row_number() OVER (PARTITION BY a.profile_id ORDER BY round(list_cosine_similarity(a.pe, b.pe), 6) DESC, b.profile_id) AS r FROM p a, p b),
    width AS (SELECT profile_id, CASE WHEN sum(n) FILTER (r <= 2) >= 60 THEN 2 WHEN sum(n) FILTER (r <= 4) >= 60 THEN 4 ELSE 5 END AS w FROM near JOIN sizes USING (cluster) GROUP BY 1),
    lists AS (SELECT near.profile_id, near.cluster FROM near JOIN width USING (profile_id) WHERE r <= w),
    pick AS (SELECT pair.* FROM pair JOIN assigned USING (person_id) JOIN lists ON lists.profile_id = pair.profile_id AND lists.cluster = assigned.cluster)
    SELECT profile_id, person_id, institution_id, score, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, person_id) AS rank FROM pick QUALIFY rank <= 60""",
)
def _(t: Tables):
    centroids = label_centroids(t)
    v = X.assign_clusters(people_vectors(t), centroids)
    return X.search_ivf(label_profiles(t), v, centroids, 60, probe_start=2, probe_max=5)


@query("matches_in_picked_institutions", "V10 S15", VEC_SQL + RANKED_SQL.format("WHERE institution_id IN (2, 5, 7)", 25))
def _(t: Tables):
    return match_people(label_profiles(t), people_vectors(t), institutions=[2, 5, 7], k=25)


@query("matches_in_default_scope", "V10 W7", VEC_SQL + """, n AS (SELECT institution_id, count(*) AS c FROM v GROUP BY 1),
scope AS (SELECT institution_id FROM (SELECT *, sum(c) OVER (ORDER BY institution_id) AS run FROM n) WHERE run <= 120 OR run = c) """
+ RANKED_SQL.format("WHERE institution_id IN (SELECT institution_id FROM scope)", 25))
def _(t: Tables):
    v = people_vectors(t)
    sizes = v.groupBy("institution_id").agg(F.count("*").alias("people")).withColumn("rank", F.col("institution_id") + 1)
    return match_people(label_profiles(t), v, sizes=sizes, k=25, cap=120)


@query("matches_in_trained_index", "V7 V8 V9 V10")
def _(t: Tables):
    v = people_vectors(t)
    centroids = X.train_centroids(v, seed=7)
    return match_people(label_profiles(t), X.assign_clusters(v, centroids), centroids, k=20, approximate=True)


@query(
    "trained_index_self_match", "V7 V8 V9 V10",
    "SELECT label AS profile_id, min(vec_id) AS person_id, CAST(1 AS DOUBLE) AS score FROM embeddings GROUP BY 1",
)
def _(t: Tables):
    v = people_vectors(t)
    centroids = X.train_centroids(v, seed=7)
    found = match_people(label_profiles(t), X.assign_clusters(v, centroids), centroids, k=20, approximate=True)
    return found.where("rank = 1").select("profile_id", "person_id", "score")


@query(
    "trained_index_recall", "V7 V8 V9 V10",
    "SELECT DISTINCT label AS profile_id, true AS enough FROM embeddings",
)
def _(t: Tables):
    """Whether the trained index finds nine of ten of the exact ranking's matches."""
    v, profiles = people_vectors(t), label_profiles(t)
    centroids = X.train_centroids(v, seed=7)
    found = match_people(profiles, X.assign_clusters(v, centroids), centroids, k=20, approximate=True)
    exact = match_people(profiles, v, k=20)
    hits = exact.join(found.select("profile_id", "person_id", F.lit(1).alias("hit")), ["profile_id", "person_id"], "left")
    return hits.groupBy("profile_id").agg((F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


def tree_index(t: Tables):
    v = people_vectors(t)
    tree = cut_lineage(X.train_centroid_tree(v, seed=7))
    return v, tree, X.assign_in_tree(v, tree)


@query(
    "tree_membership", "V7 V8 V12",
    "SELECT count(*) AS people, count(DISTINCT vec_id) AS ids, 0 AS in_two_clusters, 0 AS without_cluster, true AS as_many_clusters, true AS few_products FROM embeddings",
)
def _(t: Tables):
    """Everyone has one leaf of the tree; a row meets its coarse centroids and those of two cells, 8 * sqrt(k) at most on these tables."""
    v, tree, assigned = tree_index(t)
    per_id = assigned.groupBy("person_id").agg(F.count_distinct("cluster").alias("n"))
    counts = assigned.agg(F.count("*").alias("people"), F.count_distinct("person_id").alias("ids"))
    odd = per_id.agg(F.count_if(F.col("n") > 1).cast("int").alias("in_two_clusters"), F.count_if(F.col("n") < 1).cast("int").alias("without_cluster"))
    fans = tree.groupBy("parent").agg(F.count("*").alias("n"))
    wide = fans.agg(F.max(F.when(F.col("parent").isNull(), F.col("n"))).alias("root"), F.max(F.when(F.col("parent").isNotNull(), F.col("n"))).alias("below"))
    leaves = tree.agg(F.count("cluster").alias("leaves"))
    all_ = side_by_side(counts, odd, wide, leaves)
    wanted = F.round(F.sqrt(F.col("people")))
    return all_.select(
        "people", "ids", "in_two_clusters", "without_cluster", (F.abs(F.col("leaves") - wanted) <= F.greatest(F.lit(2), wanted * 0.2)).alias("as_many_clusters"),
        (F.col("root") + 2 * F.coalesce("below", F.lit(0)) <= 8 * F.sqrt("leaves")).alias("few_products"),
    )


@query("tree_index_recall", "V7 V8 V9 V10 E4", "SELECT DISTINCT label AS profile_id, true AS enough FROM embeddings")
def _(t: Tables):
    """Whether the index of the tree finds nine of ten of the exact ranking's twenty."""
    v, tree, assigned = tree_index(t)
    profiles = label_profiles(t)
    found = match_people(profiles, assigned, X.leaf_centroids(tree), k=20, approximate=True)
    hits = match_people(profiles, v, k=20).join(found.select("profile_id", "person_id", F.lit(1).alias("hit")), ["profile_id", "person_id"], "left")
    return hits.groupBy("profile_id").agg((F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


@query(
    "hybrid_matches", "V11",
    OVERLAP_SQL + """, b AS (SELECT profile_id, row_number() OVER (ORDER BY profile_id) % 10 AS label FROM prof),
    pv AS (SELECT b.profile_id, arg_min(embedding, vec_id)::DOUBLE[] AS pe FROM b JOIN embeddings USING (label) GROUP BY 1),
    ms AS (SELECT profile_id, vec_id AS person_id, round(list_cosine_similarity(pe, embedding::DOUBLE[]), 6) AS score FROM pv, embeddings
           QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, person_id) <= 50)
    SELECT m.profile_id, m.person_id, round(greatest(0, least(1, score + 0.15 * coalesce(overlap, 0))), 6) AS match_score
    FROM ms m JOIN people USING (person_id) LEFT JOIN ov ON ov.profile_id = m.profile_id AND ov.person_id = m.person_id""",
)
def _(t: Tables):
    from pyspark.sql import Window

    profiles = brand_profiles(t)
    # 25 brands: a fixed list, numbered in one small window.
    numbered = profiles.select("profile_id", (F.row_number().over(Window.orderBy("profile_id")) % 10).alias("label"))
    query_vectors = numbered.join(label_profiles(t).withColumnRenamed("profile_id", "label"), "label").select("profile_id", "vector")
    matches = X.rank_cosine(query_vectors, people_vectors(t), 50)
    tags = stored_tags(t)
    return hybrid_matches(profiles, matches, T.tag_counts(tags), None, tags, t.authors).select("profile_id", "person_id", "match_score")


@query(
    "match_evidence", "W11 E2",
    VEC_SQL + """, sc AS (SELECT profile_id, institution_id AS person_id, CASE WHEN person_id % 2 = 0 THEN 'area' ELSE 'paper' END AS kind, person_id AS pos, score AS closeness FROM pair)
    SELECT profile_id, person_id, kind, pos, closeness, row_number() OVER (PARTITION BY profile_id, person_id, kind ORDER BY closeness DESC, pos) AS place FROM sc
    WHERE (profile_id + person_id) % 10 < 5 QUALIFY place <= 3""",
)
def _(t: Tables):
    pieces = t.raw("embeddings").select(
        F.col("label").alias("person_id"), F.when(F.col("vec_id") % 2 == 0, "area").otherwise("paper").alias("kind"),
        F.col("vec_id").alias("pos"), F.concat(F.lit("v"), "vec_id").alias("text"), F.col("embedding").alias("vector"),
    )
    labels = t.raw("embeddings").select("label").distinct()
    matches = labels.select(F.col("label").alias("profile_id"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("_o")).select(
        "profile_id", ((F.col("_o") - F.col("profile_id") + 10) % 10).alias("person_id"), (F.col("_o") + 1).alias("rank")
    )
    out = X.match_evidence(matches, label_profiles(t), pieces, max_rank=5)
    return out.select("profile_id", "person_id", "kind", "pos", "closeness", "place")


@query(
    "shared_interests", "U6",
    """, i AS (SELECT DISTINCT p_brand AS profile_id, p_name AS interest FROM part),
    hay AS (SELECT person_id, list_distinct(flatten(list(string_split(tag, ' ')))) AS h FROM ttags GROUP BY 1)
    SELECT i.profile_id, prim.person_id, i.interest FROM i JOIN prim ON prim.primary_domain = i.profile_id JOIN hay USING (person_id) WHERE list_has_all(h, string_split(interest, ' '))""",
)
def _(t: Tables):
    interests = t.raw("part").select(F.col("p_brand").alias("profile_id"), F.lit(0).alias("pos"), F.concat(F.lit("the "), "p_name").alias("interest")).distinct()
    matches = T.primary_domain(t.author_topics).select(F.col("primary_domain").alias("profile_id"), "person_id")
    pieces = T.topic_tags(t.author_topics).select("person_id", F.col("tag").alias("text"))
    out = X.shared_interests(interests, matches, pieces)
    return out.select("profile_id", "person_id", F.regexp_replace("interest", "^the ", "").alias("interest"))


@query(
    "vector_problems", "V13",
    """SELECT vec_id AS person_id, CASE WHEN label = 3 THEN 'missing' WHEN label = 4 THEN 'wrong length' ELSE 'not a number' END AS problem FROM embeddings WHERE label IN (3, 4, 5)""",
)
def _(t: Tables):
    v = people_vectors(t)
    label = F.col("institution_id")
    broken = v.withColumn(
        "vector",
        F.when(label == 4, F.slice("vector", 1, 60)).when(label == 5, F.transform("vector", lambda x, i: F.when(i == 2, F.lit(float("nan"))).otherwise(x)).cast("array<float>")).when(label != 3, F.col("vector")),
    )
    return X.check_vectors_shape(broken, 64).select("person_id", "problem")


@query("embedded_documents", "V1", "SELECT doc_id, CAST(1 AS DOUBLE) AS norm, 64 AS dim FROM documents")
def _(t: Tables):
    out = X.embed_texts(t.texts("documents"), "text", X.hashed_words(64))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return out.select("doc_id", F.round(norm, 3).alias("norm"), F.size("vector").alias("dim"))


@query("seniority_scored_catalog", "P4 F6", ROWS_SQL + "SELECT country_code, CAST(sum(seniority) AS BIGINT) AS total, max(seniority) AS best FROM rows GROUP BY 1")
def _(t: Tables):
    joined = P.join_institutions(scored(t), t.institutions)
    return joined.groupBy("country_code").agg(F.sum("seniority_score").alias("total"), F.max("seniority_score").alias("best"))
