"""Remove lines that many documents share.

Every long line becomes a row of hashes: its key, its document, its position.
These rows, not the texts, are range-partitioned by key and sorted by document
(largest first) and position. One pass over that order sees the first occurrence
of each key, and how many documents follow. What comes back is one compressed
bitmap per document: the runs of lines that it keeps.

A key that very many documents hold would fill one range. A frequent-items sketch
over all lines, merged from one sketch per task, names the keys that may hold
2 / HOT of all lines or more; those are dealt out over BLOCKS blocks, which are
added up before they meet. The sketch settles where rows lie, never what is
found: a key it names without need is only dealt out.

The rows of hashes, about 50 bytes a line, are written once as a checkpoint;
texts are read once to make them and once to meet the bitmaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import cut_lineage
from .common import bind, fresh

MIN_CHARS = 40
MIN_DOCS = 5
HOT = 1000  # keys at most that are dealt out; the sketch tracks 64 times as many, so that a share of 2 / HOT is never missed
BLOCKS = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"


def split_lines(text: Column) -> Column:
    """Lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without blanks at both ends, A-Z in lower case."""
    cut = F.btrim(line, F.lit(BLANKS))
    # In a text of ASCII only, lower() touches A-Z alone and is much faster.
    return F.when(F.octet_length(cut) == F.char_length(cut), F.lower(cut)).otherwise(F.translate(cut, UPPER, LOWER))


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))


def _occurrences(marked: DataFrame, min_chars: int) -> DataFrame:
    """(k1, k2, id, mark, pos): one row per line whose key has `min_chars` code points or more; the key as 128 bits of hash."""
    # A line shorter than that cannot have a longer key, so only the others are hashed.
    lines = marked.select("id", "mark", F.posexplode(split_lines(F.col("text"))).alias("pos", "line")).where(F.char_length("line") >= min_chars)
    keyed = lines.select("id", "mark", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), F.col("key")).alias("k2"), "id", "mark", "pos")


def hot_keys(occurrences: DataFrame) -> list[int]:
    """At most HOT values of `k1`; every value with 2 / HOT of all rows or more is among them."""
    top = occurrences.agg(F.expr(f"approx_top_k(k1, {HOT}, {64 * HOT})").alias("top"), F.count("*").alias("n")).first()
    return [r["item"] for r in top["top"] or [] if r["count"] * 2 * HOT >= top["n"]]


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, mark, pos) of every line to drop: its key is in `min_docs` documents or more, and not in this one last.

    Cuts a checkpoint. `mark` is the hash of the row's text, `pos` counts from 0. Documents are told apart by id; null is an id, before all others.
    """
    rows = cut_lineage(_occurrences(_marked(docs, id_col, text_col), min_chars))
    hot = F.col("k1").isin(hot_keys(rows))
    block = F.when(hot, F.pmod(F.xxhash64("id"), F.lit(BLOCKS))).otherwise(F.lit(-1)).cast("int")
    ranged = rows.withColumn("block", block).repartitionByRange("k1", "k2", "block")
    # The window asks for nothing that the ranges do not give, so rows are sorted where they lie and streamed once.
    group = Window.partitionBy("k1", "k2", "block")
    stream = group.orderBy(F.col("id").desc_nulls_last(), "mark", "pos")
    first_of_doc = F.when(F.row_number().over(stream) == 1, 1).otherwise((~F.lag("id").over(stream).eqNullSafe(F.col("id"))).cast("int"))
    seen = ranged.select("k1", "k2", "block", "id", "mark", "pos", first_of_doc.alias("new"), F.first("id").over(stream).alias("last"))
    counted = seen.withColumn("docs", F.sum("new").over(stream.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    gone = (F.col("docs") >= min_docs) & ~F.col("id").eqNullSafe(F.col("last"))
    whole = counted.where((F.col("block") < 0) & gone).select("id", "mark", "pos")
    # Of a key that was dealt out, each block gives one line a document to its total; there are HOT such keys (of 64 bits) at most.
    totals = counted.where("block >= 0 and new = 1").groupBy("k1", "k2").agg(F.sum("new").alias("_docs"), F.max("id").alias("_last"))
    totals = totals.where(F.col("_docs") >= min_docs).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "_last")
    met = (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))
    dealt = rows.where(hot).join(F.broadcast(totals), met).where(~F.col("id").eqNullSafe(F.col("_last"))).select("id", "mark", "pos")
    return whole.unionByName(dealt)


def _kept_runs(dropped: Column, n: Column) -> Column:
    """Runs (start, length) of kept lines, from the sorted positions that go."""
    ends = F.concat(dropped, F.array(n))
    runs = F.transform(ends, lambda end, i: F.struct(F.when(i == 0, 0).otherwise(F.get(dropped, i - 1) + 1).alias("start"), end.alias("end")))
    runs = F.filter(runs, lambda r: r["end"] > r["start"])
    return F.transform(runs, lambda r: F.struct(r["start"].alias("start"), (r["end"] - r["start"]).alias("length")))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, mark, n_dropped, dropped) for each document that loses lines: the sorted positions that go.

    Rows with the same id and text share one entry.
    """
    gone = repeated_lines(docs, id_col, text_col, min_chars, min_docs)
    # Rows repeated with one id and text name a position once each.
    each = gone.groupBy("id", "mark").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))  # one document's lines at most
    return each.select("id", "mark", F.size("dropped").cast("long").alias("n_dropped"), "dropped")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Every row of `docs` with n_lines, n_dropped (longs) and `keep`, its bitmap of kept lines as runs (start, length).

    Lines are split at line feeds. A line's key is the line without blanks at both ends, A-Z in lower case. Keys of `min_chars`
    code points or more that `min_docs` different ids or more hold lose all their lines but those of the largest id. A null or
    empty text is one empty line, which stays. A null id counts as one document, smaller than all others; rows repeated with one
    id count as one document. Columns of `docs` named n_lines, n_dropped or keep are replaced; an empty table gives no rows.
    """
    rows = fresh(docs, "n_lines", "n_dropped", "keep").withColumn("_mark", F.xxhash64(text_col))
    bitmaps = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs).select(F.col("id").alias("_id"), F.col("mark").alias("_other"), F.col("n_dropped").alias("_n"), F.col("dropped").alias("_dropped"))
    joined = rows.join(bitmaps, rows[id_col].eqNullSafe(bitmaps["_id"]) & (F.col("_mark") == F.col("_other")), "left")
    n_lines = F.size(split_lines(F.col(text_col)))
    keep = F.when(F.col("_n").isNull(), F.array(F.struct(F.lit(0).alias("start"), n_lines.alias("length")))).otherwise(_kept_runs(F.col("_dropped"), n_lines))
    return joined.select(*rows.drop("_mark").columns, n_lines.cast("long").alias("n_lines"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_dropped"), keep.alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that a bitmap keeps, joined by line feeds."""
    cut = bind(split_lines(text), lambda lines: F.flatten(F.transform(keep, lambda r: F.slice(lines, r["start"] + 1, r["length"]))))
    return F.array_join(cut, "\n")
