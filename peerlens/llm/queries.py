"""One query per operator over the whole `documents` table, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lattice, ledger, lexical, lines, mixing, multiset, packing, preference, secrets, sharding, simhash, spans, substrings

HELD_OUT_TENTH = (10, 0)
HELD_OUT_THIRD = (3, 1)


def documents(spark: SparkSession, root: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{root}/{table}.parquet")


def held_out(fold: tuple[int, int], id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % fold[0] == fold[1], F.lit(False))


def op1_mix_sources(spark: SparkSession, root: str) -> DataFrame:
    mixed = mixing.mix_sources(documents(spark, root))
    return mixed.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies",
        F.round("rate", 9).alias("rate"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("_row"),
    ).drop("_row")


def op2_simhash_trie(spark: SparkSession, root: str) -> DataFrame:
    near = simhash.near_duplicates(documents(spark, root))
    return near.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SHARDS = 40


def op3_interleaved_shards(spark: SparkSession, root: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, root).select("doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.interleave(rows, SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op4_remove_repeats(spark: SparkSession, root: str) -> DataFrame:
    cut = substrings.remove_repeats(documents(spark, root).select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op5_subword_lattice(spark: SparkSession, root: str) -> DataFrame:
    scored = lattice.score_texts(documents(spark, root), ~held_out(HELD_OUT_TENTH))
    return scored.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_multiset_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    docs = documents(spark, root).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = multiset.fingerprints(docs).withColumn("n_chars", F.length("text").cast("long"))
    paired = multiset.with_successor(marked, "doc_id", ["text", "vector"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    both = paired.select("doc_id", "n_chars", "vector", "fingerprint", "next_vector", edited.alias("edited"))
    both = multiset.fingerprints(both.withColumnsRenamed({"vector": "own", "fingerprint": "own_print"}), "edited")
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), F.col("own_print").alias("fingerprint"), F.col("fingerprint").alias("edited_fingerprint"),
        multiset.likeness(F.col("own"), F.col("vector")).alias("near_edited"), multiset.likeness(F.col("own"), F.col("next_vector")).alias("near_next"),
    )


def op7_best_fit_packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(documents(spark, root)).withColumnRenamed("id", "doc_id")


def op8_rule_ledger(spark: SparkSession, root: str) -> DataFrame:
    rows = ledger.ledger(documents(spark, root).select("doc_id", "text"))
    base, verdict = ledger.policy_mask(ledger.POLICIES["base"]), ledger.policy_mask(ledger.POLICIES["v2"])
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~ledger.passes(base)).alias("base_failed"), ledger.passes(verdict).alias("kept"), "failed",
    )


def op9_linked_secrets(spark: SparkSession, root: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, root).select("doc_id", "text"))
    return found.select("doc_id", *[secrets.count_of(k).alias(f"n_{k}") for k in secrets.KINDS[:3]], F.sha2(secrets.spans_text(secrets.KINDS[:3]), 256).alias("base_sha256"), secrets.spans_text().alias("spans"))


def op10_pairwise_quality(spark: SparkSession, root: str) -> DataFrame:
    docs, labels = documents(spark, root).select("doc_id", "text"), documents(spark, root, "labels")
    model = preference.train(docs, labels.where(~held_out(HELD_OUT_THIRD)), one_sided="neutral")
    scored = preference.quality_scores(docs, model)
    return scored.select("doc_id", held_out(HELD_OUT_THIRD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_mask_groups(spark: SparkSession, root: str) -> DataFrame:
    found = lexical.rank_documents(documents(spark, root), documents(spark, root, "benchmark"))
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")


def op12_token_spans(spark: SparkSession, root: str) -> DataFrame:
    linked = spans.align_tokenizers(documents(spark, root), digest=True)
    return linked.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op13_line_bitmaps(spark: SparkSession, root: str) -> DataFrame:
    cut = lines.dedup_lines(documents(spark, root).select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(lines.kept_text(F.col("text"), F.col("keep")), 256).alias("kept_sha256"))


_REPEATS = r"""
, windows AS (
  SELECT doc_id, i, list_slice(w, i, i + 12) AS seq FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)),
owners AS (SELECT seq, min(doc_id) AS owner FROM windows GROUP BY seq),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM windows JOIN owners USING (seq), range(13) AS t(k) WHERE owner < doc_id),
kept AS (
  SELECT doc_id, count(*) FILTER (WHERE g.pos IS NOT NULL) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p.pos) FILTER (WHERE g.pos IS NULL), '') AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM docs) p LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs d LEFT JOIN kept USING (doc_id)
"""

SQL = {
    "op4_remove_repeats": r"WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)" + _REPEATS,
    "op11_mask_groups": r"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
docs AS (SELECT doc_id, row, t, len(t) AS n FROM split WHERE len(t) > 0),
corpus AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM docs),
postings AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(t) AS term FROM docs) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, corpus GROUP BY term, big_n),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // big_l))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), corpus GROUP BY item_id, row, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= 20
""",
    "op13_line_bitmaps": r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs)),
shared AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE last <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE last IS NULL OR last = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN shared USING (key) GROUP BY doc_id
""",
}

QUERIES = {
    fn.__name__: (fn, SQL.get(fn.__name__))
    for fn in (
        op1_mix_sources, op2_simhash_trie, op3_interleaved_shards, op4_remove_repeats, op5_subword_lattice, op6_multiset_fingerprints,
        op7_best_fit_packing, op8_rule_ledger, op9_linked_secrets, op10_pairwise_quality, op11_mask_groups, op12_token_spans, op13_line_bitmaps,
    )
}
