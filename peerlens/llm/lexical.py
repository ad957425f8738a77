"""Rank documents for many queries by the terms they share.

Texts are read once for each portion of the queries and leave, per document, its
length and the portion's terms that it holds. Then every task takes its documents in
blocks. For a query, the term's presence bits give each document of the block a mask;
documents of one mask form a group, whose maximum is the sum of the highest parts
that its terms reach in the block. Groups are scored in descending order of their
maximum until that falls below the k-th best score the task has found for the query.

A task returns `k` rows a query at most. All weights and scores are whole numbers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import cut_lineage, scratch_dir, top_per_group, with_running_sum
from .common import fresh

PORTION = 1 << 20  # bytes of query text that go to every task at a time, or one query
FIRST_GROUPS = 64  # documents that are scored first; then twice as many each time
FRAME = 2_000_000  # terms of documents that form a block at most, or one batch

# A term is a run of letters and digits of ASCII and of anything beyond ASCII; A-Z in lower case.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a text in order, from its UTF-8 bytes."""
    return (text or b"").translate(_TABLE).split()


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 * ln((2 N + 2) / (2 df + 1)))"""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def held_terms(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, times) of each document with a term: n of all its terms, and those in the vocabulary, ascending."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).where("text is not null")

    def out(ids, keep, lengths, held):
        offsets = pa.array(np.cumsum([0, *map(len, held)]), pa.int32())
        flat = np.array([p for h in held for p in h], np.int64).reshape(-1, 2)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(flat[:, k].astype(np.int32))) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(lengths, pa.int64()), *lists], names=["id", "n", "terms", "times"])

    def hold(batches: Iterator[pa.RecordBatch]):
        known = shared.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            keep, lengths, held = [], [], []
            for i in range(batch.num_rows):
                found = terms(texts[i].as_py())
                if found:
                    keep.append(i)
                    lengths.append(len(found))
                    counts = Counter(found)
                    held.append(sorted((known[t], counts[t]) for t in counts.keys() & known.keys()))
            yield out(ids, keep, lengths, held)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(hold, f"id {kind}, n long, terms array<int>, times array<int>")


class Block:
    """Postings of some documents: for each term the documents that hold it and what it adds to their scores."""

    def __init__(self, ids, lengths: np.ndarray, offsets: np.ndarray, held: np.ndarray, times: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids, self.n = ids, len(lengths)
        document = np.repeat(np.arange(self.n), np.diff(offsets))
        m = 100 - 25 + (25 * lengths * n_docs) // max(n_terms, 1)
        times = times.astype(np.int64)
        parts = weights[held] * ((1_000_000_000 * times) // (1000 * times + 12 * m[document]))
        order = np.argsort(held, kind="stable")  # within a term, documents stay in order
        self.documents, self.parts = document[order], parts[order]
        self.terms, self.begin = np.unique(held[order], return_index=True)
        self.begin = np.append(self.begin, len(order))
        self.highest = np.maximum.reduceat(self.parts, self.begin[:-1]) if len(order) else self.parts

    def postings(self, query: dict[int, int]):
        """(documents, parts times the query's own count, the highest of these) of each term of the query that the block has."""
        wanted = np.fromiter(query, np.int64, len(query))
        at = np.searchsorted(self.terms, wanted)
        there = at < len(self.terms)
        there[there] = self.terms[at[there]] == wanted[there]
        for t, i in zip(wanted[there].tolist(), at[there].tolist(), strict=True):
            a, b = self.begin[i], self.begin[i + 1]
            yield self.documents[a:b], self.parts[a:b] * query[t], int(self.highest[i]) * query[t]

    def groups(self, found: list):
        """Documents by presence mask, as (maximum of each mask, masks in descending order of it, documents mask by mask, where each begins)."""
        bits = np.zeros((self.n, (len(found) + 63) // 64), np.uint64)
        for j, (documents, _, _) in enumerate(found):
            bits[documents, j // 64] |= np.uint64(1 << (j % 64))
        held = np.flatnonzero(bits.any(axis=1))
        if bits.shape[1] == 1:
            masks, which = np.unique(bits[held, 0], return_inverse=True)
            masks = masks.reshape(-1, 1)
        else:
            masks, which = np.unique(bits[held], axis=0, return_inverse=True)
        most = np.zeros(len(masks), np.int64)
        for j, (_, _, highest) in enumerate(found):
            most += ((masks[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64) * highest
        by_mask = held[np.argsort(which.reshape(-1), kind="stable")]
        size = np.bincount(which.reshape(-1), minlength=len(masks))
        return most, np.argsort(-most, kind="stable"), by_mask, np.cumsum(size) - size, size

    def best(self, query: dict[int, int], k: int, top: list) -> list:
        """The `k` best (score, id) of `top` and the block's documents."""
        found = list(self.postings(query))
        if not found:
            return top
        most, order, by_mask, begin, size = self.groups(found)
        at, portion = 0, FIRST_GROUPS
        while at < len(order):
            floor = top[-1][0] if len(top) == k else 1
            left = order[at:]
            left = left[: np.searchsorted(-most[left], -floor, "right")]  # an equal maximum may win by its id
            if not len(left):
                break
            left = left[: np.searchsorted(np.cumsum(size[left]), portion) + 1]
            documents = np.sort(np.concatenate([by_mask[begin[g] : begin[g] + size[g]] for g in left.tolist()]))
            score = np.zeros(len(documents), np.int64)
            for held, parts, _ in found:
                i = np.minimum(np.searchsorted(held, documents), len(held) - 1)
                score += np.where(held[i] == documents, parts[i], 0)
            good = np.flatnonzero(score >= floor)
            if len(good) > k:  # all that are not below the k-th
                good = good[score[good] >= np.partition(score[good], len(good) - k)[len(good) - k]]
            names = self.ids.take(pa.array(documents[good])).to_pylist()
            top = sorted([*top, *zip(score[good].tolist(), names, strict=True)], key=lambda r: (-r[0], r[1] is None, r[1]))[:k]
            at, portion = at + len(left), 2 * portion
        return top


def _best(held: DataFrame, queries: dict[int, dict[int, int]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(no, id, score): the `k` best documents of each query among those of a task."""
    shared = held.sparkSession.sparkContext.broadcast((queries, weights))
    kind = held.schema["id"].dataType.simpleString()
    id_type = pa.large_string() if kind == "string" else None

    def search(batches: Iterator[pa.RecordBatch]):
        queries, weights = shared.value
        tops: dict[int, list] = {no: [] for no in queries}
        id_kind = None

        def meet(some: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(some).combine_chunks()
            ids, lengths, lists, times = (rows.column(c).chunk(0) for c in range(4))
            block = Block(ids, lengths.to_numpy(), lists.offsets.to_numpy(), lists.flatten().to_numpy(), times.flatten().to_numpy(), weights, n_docs, n_terms)
            for no, query in queries.items():
                tops[no] = block.best(query, k, tops[no])

        some, size = [], 0
        for batch in batches:
            id_kind = batch.column(0).type
            if not batch.num_rows:
                continue
            some.append(batch)
            size += len(batch.column(2).flatten())
            if size > FRAME:
                meet(some)
                some, size = [], 0
        if some:
            meet(some)
        rows = [(no, i, s) for no, top in tops.items() for s, i in top]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], id_kind or id_type), pa.array([r[2] for r in rows], pa.int64())], names=["no", "id", "score"])

    return held.mapInArrow(search, f"no long, id {kind}, score long")


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    portion: int = PORTION,
) -> DataFrame:
    """(item_id, rank, id, score): the `k` best documents of each row of `items`, scores above 0, ties by id.

    A document's score sums weight * ((10^9 tf) div (1000 tf + 12 m)) over the item's terms, repeats included, with
    m = 75 + (25 n N) div L, n its terms, N documents with a term, L terms of all. Null texts have no terms. Every row
    is a document or an item of its own, whatever its id; null ids come last among ties. An item without matches, and an empty table, give no rows.
    Items go to the tasks in portions of `portion` bytes, one pass over the texts each; writes each portion's terms once, beside the checkpoints.
    """
    spark = docs.sparkSession
    sized = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").cast("binary").alias("text"))
    sized = sized.where("text is not null").withColumn("size", F.octet_length("text").cast("long"))
    numbered = cut_lineage(with_running_sum(sized, [F.col("item_id"), F.col("text")], "size", "end", "no").withColumn("portion", F.floor(F.col("end") / portion)))
    found = []
    for (p,) in numbered.select("portion").distinct().orderBy("portion").toLocalIterator():
        queries: dict[int, dict[int, int]] = {}
        vocabulary: dict[bytes, int] = {}
        for r in numbered.where(F.col("portion") == p).select("no", "text").collect():  # bounded by the portion
            counts = Counter(terms(bytes(r["text"])))
            queries[r["no"]] = {vocabulary.setdefault(t, len(vocabulary)): c for t, c in counts.items()}
        held_ = held_terms(docs, vocabulary, id_col, text_col)
        place = scratch_dir(spark, "terms")
        held_.write.option("compression", "zstd").parquet(place)
        held = spark.read.schema(held_.schema).parquet(place)
        n_docs, n_terms = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)
        for r in held.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # a row per term of the portion
            df[r["t"]] = r["count"]
        found.append(_best(held, queries, term_weights(df, n_docs), n_docs, n_terms, k))
    if not found:
        kind = docs.schema[id_col].dataType.simpleString()
        found = [spark.createDataFrame([], f"no long, id {kind}, score long")]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    ranked = top_per_group(every, ["no"], [F.col("score").desc(), F.col("id").asc_nulls_last()], k, "rank")
    return ranked.join(fresh(numbered, "text", "size", "end", "portion"), "no").select("item_id", "rank", "id", "score")
