"""Align the tokens of two tokenizers over the same texts.

Tokenizer A reads a blank and the text, tokenizer B the text, before which it
puts a blank itself. Where a token of each ends at the same byte, both sequences
are cut; tokens between two cuts form a group, and every A token of a group is
linked with every B token of it.

Ends come from the libraries: character offsets of A and the spans of B's proto
are coarse cuts. Tokens that share a character (parts of a multibyte character,
byte fallback) have no span of their own; their ends are refined by the bytes
they decode to.

Neither tokenizer joins anything across a blank that follows something else, so
a text falls into chunks (a word with the blank before it and what clings to it)
that can be aligned one by one, wherever they occur. Each worker keeps the chunks
it has seen. A chunk whose bytes do not come back, which a normalizing vocabulary
may cause, sends its whole text through both tokenizers instead.

The aligned rows are written once. Pairs of ids are counted over them; pairs with
1 / FREQUENT of all occurrences or more, at most FREQUENT of them, are broadcast,
the others are joined, and none of those is hot.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import cut_lineage, scratch_dir

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
FREQUENT = 1_000_000  # pairs that are broadcast at most: 17 bytes each
KEPT = 150_000_000  # characters, and 300 more a chunk, that a worker keeps; then it keeps what it has met more than once
UNIT = 4_000  # characters that are encoded at a time
TEXTS = 1_000_000  # characters of whole texts that are put together at a time
CODE = 1 << 20  # a pair of ids is one number, a * CODE + b; ids are below CODE
BITS = 40  # of a pair
CHUNK = re.compile(r"\s*\S+(?:[^\S ]\s*\S*)*|\s+")
CLOSE = re.compile(r"\s ")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def chunks(text: str) -> list[str]:
    """A blank and the text, cut before each blank that follows something else than white space; the blank itself is left out."""
    if text[:1] != " " and text[-1:] != " " and not CLOSE.search(text):
        return text.split(" ")
    return [c[1:] for c in CHUNK.findall(" " + text)]


def refined(ends: np.ndarray, shared: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: coarse cuts where a token ends a character of its own, else counted on from the last such cut."""
    total = np.cumsum(lengths)
    at = np.maximum.accumulate(np.where(shared, -1, np.arange(len(ends))))
    first = at < 0
    at = np.where(first, 0, at)
    return np.where(first, total, ends[at] + total - total[at])


class Aligner:
    """Both tokenizers and the chunks seen so far. Made from the content of the vocabulary files."""

    def __init__(self, a_json: str, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        alphabet = byte_alphabet()
        vocabulary = json.loads(a_json)["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            if all(c in alphabet for c in entry):
                self.a_bytes[i] = bytes(alphabet[c] for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in entries]) for entries in (self.a_bytes, self.b_bytes))
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(pieces)))]
        self.clear()

    def clear(self) -> None:
        self.index: dict = {}  # chunk -> its number; by number: groups as text, tokens, groups and links, pairs
        self.said: list[str] = []
        self.odd: set[int] = set()
        self.numbers = np.zeros((4, 0), np.int64)
        self.first = np.zeros(1, np.int64)
        self.pairs = self.times = np.zeros(0, np.int64)
        self.met = np.zeros(0, np.int64)  # how often each was met since the store was last cut down
        self.size = 0

    def shrink(self) -> None:
        """Only chunks met more than once stay; if these are most of the store, none."""
        keep = self.met > 1
        names = [c for c, k in zip(self.index, keep.tolist(), strict=True) if k and isinstance(c, str)]
        size = sum(len(c) + 300 for c in names)
        if size > KEPT * 2 // 3:
            self.clear()
            return
        keep[[n for c, n in self.index.items() if not isinstance(c, str)]] = False  # whole texts
        at = np.flatnonzero(keep)
        links = np.diff(self.first)[at]
        where = np.repeat(self.first[at] - np.cumsum(links) + links, links) + np.arange(links.sum())
        self.said = [self.said[i] for i in at.tolist()]
        self.odd.intersection_update(names)
        self.index = {c: i for i, c in enumerate(names)}
        self.numbers, self.pairs, self.times = self.numbers[:, at], self.pairs[where], self.times[where]
        self.first = np.concatenate([[0], np.cumsum(links)])
        self.met, self.size = np.ones(len(at), np.int64), size

    def tokens(self, text: str):
        """(ids of A, its byte ends, ids of B, its byte ends) of a text without a blank before it, or None where bytes differ."""
        whole = (" " + text).encode()
        encoded = self.a.encode(" " + text, add_special_tokens=False)
        a_ids, pieces = encoded.ids, self.b.encode(text, return_type="proto").pieces
        b_ids = [p.id for p in pieces]
        if b"".join(map(self.a_bytes.__getitem__, a_ids)) != whole or b"".join(map(self.b_bytes.__getitem__, b_ids)) != whole:
            return None
        a_ids, b_ids = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        offsets = np.fromiter(chain.from_iterable(encoded.offsets), np.int64).reshape(-1, 2)
        coarse = offsets[:, 1]
        if len(whole) != len(text) + 1:
            points = np.frombuffer((" " + text).encode("utf-32-le"), np.uint32)
            coarse = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])[coarse]
        shared = np.append(offsets[1:, 0] < offsets[:-1, 1], False)  # the next token begins inside this one's last character
        a_ends = refined(coarse, shared, self.a_lengths[a_ids])
        spans = np.array([p.end for p in pieces], np.int64)
        b_ends = refined(spans + 1, np.diff(spans, prepend=0) == 0, self.b_lengths[b_ids])  # after the blank that B adds
        return a_ids, a_ends, b_ids, b_ends

    def cut(self, text: str, ends: np.ndarray):
        """Groups of a text by chunks that end at these bytes: (groups as text, numbers, first pair of each, pairs, times), or None where bytes differ."""
        found = self.tokens(text)
        if found is None:
            return None
        a_ids, a_ends, b_ids, b_ends = found
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_to, b_to = np.searchsorted(a_ends, cuts, "right"), np.searchsorted(b_ends, cuts, "right")
        n_a, n_b = np.diff(a_to, prepend=0), np.diff(b_to, prepend=0)
        chunk, n = np.searchsorted(ends, cuts), len(ends)
        numbers = np.array([np.bincount(chunk, x, n) for x in (n_a, n_b, np.ones(len(cuts)), n_a * n_b)]).astype(np.int64)
        a_said, b_said = [self.names[i] for i in a_ids.tolist()], [self.names[i] for i in b_ids.tolist()]
        borders = zip((a_to - n_a).tolist(), a_to.tolist(), (b_to - n_b).tolist(), b_to.tolist(), strict=True)
        groups = [f"{a_said[i]}|{b_said[j]}" if m - i == 1 == k - j else f"{','.join(a_said[i:m])}|{','.join(b_said[j:k])}" for i, m, j, k in borders]
        last = np.searchsorted(chunk, np.arange(n), "right").tolist()
        said = [";".join(groups[i:j]) for i, j in zip([0, *last], last, strict=False)]
        group = np.arange(len(cuts))
        a_side, b_side = (np.repeat(group, n_a), a_ids, np.ones(len(a_ids), np.int64)), (np.repeat(group, n_b), b_ids, np.ones(len(b_ids), np.int64))
        if int((n_a * n_b).sum()) > 64 * UNIT:  # a long stretch without a common end: each id of it once, with its times
            a_side, b_side = (self._summed(g * CODE + i, w) for g, i, w in (a_side, b_side))
            a_side, b_side = ((k // CODE, k % CODE, w) for k, w in (a_side, b_side))
            n_a, n_b = np.bincount(a_side[0], minlength=len(cuts)), np.bincount(b_side[0], minlength=len(cuts))
        links = n_a * n_b
        g = np.repeat(group, links)
        at = np.arange(len(g)) - np.repeat(np.cumsum(links) - links, links)
        i, j = (np.cumsum(n_a) - n_a)[g] + at // n_b[g], (np.cumsum(n_b) - n_b)[g] + at % n_b[g]
        pairs, times = self._summed((chunk[g] << BITS) + a_side[1][i] * CODE + b_side[1][j], a_side[2][i] * b_side[2][j])
        return said, numbers, np.searchsorted(pairs >> BITS, np.arange(n)), pairs & ((1 << BITS) - 1), times

    @staticmethod
    def _summed(keys: np.ndarray, values: np.ndarray):
        """Keys in order, each once, with the sum of its values."""
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        begin = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[begin], np.add.reduceat(values[order], begin) if len(begin) else values[:0]

    def _keep(self, chunks_: list, found) -> None:
        """`found`: lists of what `cut` gave, in the order of the chunks."""
        for c in chunks_:
            self.index[c] = len(self.index)
        self.numbers = np.concatenate([self.numbers, *(f[1] for f in found)], axis=1)
        firsts, base = [], len(self.pairs)
        for f in found:
            firsts.append(f[2] + base)
            base += len(f[3])
            self.said += f[0]
        self.first = np.concatenate([self.first[:-1], *firsts, [base]])
        self.pairs = np.concatenate([self.pairs, *(f[3] for f in found)])
        self.times = np.concatenate([self.times, *(f[4] for f in found)])
        self.met = np.concatenate([self.met, np.zeros(len(chunks_), np.int64)])

    def _alone(self, key, text: str):
        found = self.cut(text, np.array([len(text.encode()) + 1]))
        if found is None:
            none = np.zeros(0, np.int64)
            found = ([""], np.zeros((4, 1), np.int64), np.zeros(1, np.int64), none, none)
            self.odd.add(key)
        return found

    def learn(self, new: list[str]) -> None:
        """Chunks not seen so far, many encoded as one text; one by one if bytes differ, or where the end is not cut off from what follows."""
        order, found, unit, size = [], [], [], 0

        def one_text():
            ends = np.cumsum([len(c.encode()) + 1 for c in unit])
            got = self.cut(" ".join(unit), ends)
            found.extend([got] if got is not None else [self._alone(c, c) for c in unit])
            order.extend(unit)

        for c in new:
            self.size += len(c) + 300
            if not c or c[-1].isspace():
                order.append(c)
                found.append(self._alone(c, c))
                continue
            unit.append(c)
            size += len(c) + 1
            if size >= UNIT:
                one_text()
                unit, size = [], 0
        if unit:
            one_text()
        if order:
            self._keep(order, found)

    def documents(self, texts: list[str | None]):
        """(groups as text, numbers, first pair of each, pairs, times) of texts; numbers are tokens of A and B, groups and links."""
        if self.size > KEPT:
            self.shrink()
        parts = [chunks(t) if t else [] for t in texts]
        self.learn(list(set(chain.from_iterable(parts)) - self.index.keys()))
        if self.odd:
            whole = [(i, (texts[i],)) for i, p in enumerate(parts) if not self.odd.isdisjoint(p)]
            new = list(dict.fromkeys(key for _, key in whole if key not in self.index))
            if new:
                self._keep(new, [self._alone(key, key[0]) for key in new])
                self.size += sum(len(key[0]) for key in new)
            for i, key in whole:
                parts[i] = [key]
        numbers = [list(map(self.index.__getitem__, p)) for p in parts]
        said = [";".join(map(self.said.__getitem__, n)) for n in numbers]
        counts = np.array([len(n) for n in numbers])
        n, row, at = len(texts), np.repeat(np.arange(len(texts)), counts), np.fromiter(chain.from_iterable(numbers), np.int64, counts.sum())
        self.met += np.bincount(at, minlength=len(self.met))
        totals = np.array([np.bincount(row, x[at], n) for x in self.numbers]).astype(np.int64)
        each, times = np.unique((row << 32) + at, return_counts=True)  # a chunk once per text
        row, at = each >> 32, each & 0xFFFFFFFF
        links = (self.first[1:] - self.first[:-1])[at]
        where = np.repeat(self.first[at] - np.cumsum(links) + links, links) + np.arange(links.sum())
        row = np.repeat(row, links)
        # Texts one after the other, so that a key stays below 64 bits however many there are.
        keys, sums = self._summed((row << BITS) + self.pairs[where], np.repeat(times, links) * self.times[where])
        return said, totals, np.searchsorted(keys >> BITS, np.arange(n + 1)), keys & ((1 << BITS) - 1), sums


def read_vocabularies(a_path: str, b_path: str) -> tuple[str, bytes]:
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return a.read(), b.read()


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, pairs, times) of every row of `docs`.

    `groups` lists the ids, `a1,a2|b1;a3|b2,b3` in order, or with `digest` the SHA-256 of that in hex (`''` without tokens).
    `pairs` are the linked ids, a * CODE + b, ascending, `times` how often each is linked. Texts that are null, empty or not given
    back byte for byte by both tokenizers have no tokens. Vocabulary files are read by the driver and travel with the job.
    """
    vocabularies = read_vocabularies(a_path or f"{TOKENIZERS}/{A_FILE}", b_path or f"{TOKENIZERS}/{B_FILE}")
    shared = docs.sparkSession.sparkContext.broadcast(vocabularies)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def out(aligner: Aligner, ids: pa.Array, texts: list) -> pa.RecordBatch:
        said, numbers, first, pairs, times = aligner.documents(texts)
        if digest:
            said = [sha256(g.encode()).hexdigest() if g else g for g in said]
        lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(v)) for v in (pairs, times)]
        names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
        return pa.RecordBatch.from_arrays([ids, *map(pa.array, numbers), pa.array(said, pa.string()), *lists], names=names)

    def align(batches: Iterator[pa.RecordBatch]):
        if not hasattr(shared, "aligner"):  # a worker's broadcast values outlive its tasks, and so do the chunks it has seen
            shared.aligner = Aligner(*shared.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            begin, some, size = 0, [], 0
            for i in range(batch.num_rows):
                some.append(texts[i].as_py())
                size += len(some[-1] or "")
                if size > TEXTS:
                    yield out(shared.aligner, ids.slice(begin, len(some)), some)
                    begin, some, size = i + 1, [], 0
            if some:
                yield out(shared.aligner, ids.slice(begin, len(some)), some)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(align, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<bigint>, times array<bigint>")


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): in how many rows each pair is linked, and whether no other pair of its A id is in more."""
    counts = cut_lineage(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    a_id = F.expr(f"pair div {CODE}")
    most = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("most"))  # one row per entry of A's vocabulary at most
    return counts.withColumn("a", a_id).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _links(found: DataFrame, shared, rare: bool) -> DataFrame:
    """Of the pairs that are not broadcast (row, pair, times), or of those that are (row, n_best, count_sum)."""

    def split(batches):
        codes, counts, best = shared.value
        for batch in batches:
            pairs, times = batch.column(1), batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), np.diff(pairs.offsets.to_numpy()))
            code, m = pairs.flatten().to_numpy(), times.flatten().to_numpy()
            at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
            known = codes[at] == code if len(codes) else np.zeros(len(code), bool)
            if rare:
                arrays = [batch.column(0).take(pa.array(row[~known])), pa.array(code[~known]), pa.array(m[~known])]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "pair", "times"])
                continue
            row, m, at = row[known], m[known], at[known]
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], row, m * best[at])
            np.add.at(sums[1], row, m * counts[at])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums[0]), pa.array(sums[1])], names=["row", "n_best", "count_sum"])

    schema = "row long, pair long, times long" if rare else "row long, n_best long, count_sum long"
    return found.select("row", "pairs", "times").mapInArrow(split, schema)


def align_tokenizers(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum) of every row of `docs`; see `aligned` for the first six.

    A pair of ids counts the rows that link it. `count_sum` adds the counts over all links of a row, `n_best` is how many links have the highest
    count of their A id, ties included. Every row is a document: repeated rows count each time, ids may be null and of any type,
    other columns are not looked at. Rows without tokens have zeros. Writes the aligned rows once, beside the checkpoints.
    """
    spark = docs.sparkSession
    place = scratch_dir(spark, "aligned")
    numbered = aligned(docs, a_path, b_path, id_col, text_col, digest).withColumn("row", F.monotonically_increasing_id())
    numbered.write.option("compression", "zstd").parquet(place)
    found = spark.read.schema(numbered.schema).parquet(place)
    table = cut_lineage(pair_counts(found))
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = table.where(F.col("n") * FREQUENT >= total).orderBy("pair").toArrow()  # FREQUENT rows at most
    shared = spark.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("pair", "n", "best")))
    rest = table.where(F.col("n") * FREQUENT < total)
    times = F.col("times")
    joined = _links(found, shared, rare=True).join(rest, "pair").select("row", (times * F.col("best").cast("long")).alias("n_best"), (times * F.col("n")).alias("count_sum"))
    sums = _links(found, shared, rare=False).unionByName(joined).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.drop("pairs", "times").join(sums, "row").drop("row")
