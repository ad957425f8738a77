"""Remove passages that an earlier document has: windows of words behind a count-min prefilter.

Pass 1 hashes each window of `WINDOW` words and counts it, once per document,
in two rows of a count-min sketch. A partition's sketch keeps what matters,
whether a counter is 0, 1 or more, as bitmaps cut into slices; the slices of all
partitions are merged as a stream. A counter of 2 or more never misses a
repeated window, it only takes in some that are not.

Pass 2 hashes again and groups exactly, by 96 bits of the hash, only windows whose
two counters both reached 2. Each partition first settles what it can: of several
documents with one window all but the smallest id lose it there and then, and
only that one goes on, so a window that a third of all documents share is one row
per partition in the shuffle.

The sketch is broadcast. Its size follows the input up to 2 * 2**MOST_BITS bits
(128 MB); beyond that more windows pass to the exact step, and none is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

WINDOW = 13
LEAST_BITS, MOST_BITS, SLICE_BITS = 12, 29, 22
CHUNK_WORDS = 150_000  # words hashed at a time
FLUSH = 3_000_000  # windows of a partition gathered before a sketch is written
SETTLE = 600_000  # candidate windows gathered before they are settled
VOCABULARY = 200_000  # words whose hashes a task keeps
NO_ID = (1 << 63) - 1  # null ids come after all others
_BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)  # odd multipliers of the two polynomials


def text_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()  # on bytes: blank, \t, \n, \v, \f, \r


class _Hasher:
    """128-bit window hashes: two polynomials over 64-bit word hashes, modulo 2**64."""

    def __init__(self, window: int):
        self.window, self.index, self.hashes = window, {}, np.zeros((0, 2), np.uint64)

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > VOCABULARY:
            self.index, self.hashes = {}, np.zeros((0, 2), np.uint64)
        index, known = self.index, len(self.index)
        codes = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
        if len(index) > known:
            new = list(index)[known:]
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in new), np.uint64).reshape(-1, 2)
            self.hashes = np.concatenate([self.hashes, digests])
        each = self.hashes[codes]
        n = len(words) - self.window + 1
        total = each[:n].copy()
        for k in range(1, self.window):
            total = total * _BASES + each[k : k + n]
        return total


def _windows(batches: Iterator[pa.RecordBatch], window: int):
    """(ordinals, starts, hashes) of all windows, some CHUNK_WORDS words at a time; documents are numbered as they come, with (id, hash of text)."""
    hasher, words, spans, base = _Hasher(window), [], [], 0

    def settle():
        if len(words) < window:
            return None
        hashes = hasher.of(words)
        starts, owners = [], []
        for ordinal, begin, n in spans:
            if n >= window:
                starts.append(np.arange(begin, begin + n - window + 1))
                owners.append(np.full(n - window + 1, ordinal))
        if not starts:
            return None
        at, owner = np.concatenate(starts), np.concatenate(owners)
        begins = np.array([b for _, b, _ in spans])
        first = begins[np.searchsorted([o for o, _, _ in spans], owner)]
        return owner, (at - first).astype(np.int32), hashes[at]

    keys: list[tuple[int, int]] = []
    for batch in batches:
        ids, marks, texts = (batch.column(i) for i in range(3))
        for i in range(batch.num_rows):
            found = text_words(texts[i].as_py())
            keys.append((ids[i].as_py(), marks[i].as_py()))
            if found:
                spans.append((base + len(keys) - 1, len(words), len(found)))
                words.extend(found)
            if len(words) >= CHUNK_WORDS:
                out = settle()
                if out is not None:
                    yield keys, base, out
                base += len(keys)
                keys, words, spans = [], [], []
    out = settle()
    if out is not None:
        yield keys, base, out


def _positions(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(hashes[:, row] >> np.uint64(64 - bits)).astype(np.uint32) for row in (0, 1)]


def _sketch_rows(gathered: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    hashes = np.concatenate(gathered)
    step = min(bits, SLICE_BITS)
    for row, positions in enumerate(_positions(hashes, bits)):
        positions = np.sort(positions)
        borders = np.searchsorted(positions, np.arange(0, (1 << (bits - step)) + 1, dtype=np.int64) << step)
        for part in np.flatnonzero(np.diff(borders)):
            inside = (positions[borders[part] : borders[part + 1]] & np.uint32((1 << step) - 1)).astype(np.int64)
            more = np.unique(inside[1:][inside[1:] == inside[:-1]])
            yield pa.RecordBatch.from_pydict(
                {"row": pa.array([row], pa.int32()), "part": pa.array([int(part)], pa.int32()), "once": [_pack(np.unique(inside))], "twice": [_pack(more) if len(more) else None]},
                schema=_SKETCH,
            )


_SKETCH = pa.schema([("row", pa.int32()), ("part", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def _pack(positions: np.ndarray) -> bytes:
    """Sorted positions as differences, byte by byte, compressed: near one byte for each."""
    steps = np.diff(positions, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)
    return len(positions).to_bytes(4, "little") + pa.compress(np.ascontiguousarray(steps.T).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes | None) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.decompress(data[4:], 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))


def repeated_sketch(rows: DataFrame, bits: int, window: int = WINDOW) -> list[np.ndarray]:
    """Two bitmaps of 2**bits bits each: counters that at least two documents reached. `rows`: (id, mark, text)."""
    step = min(bits, SLICE_BITS)

    def count(batches):
        gathered, n = [], 0
        for _, _, (owner, _, hashes) in _windows(batches, window):
            order = np.lexsort((hashes[:, 1], hashes[:, 0], owner))
            owner, hashes = owner[order], hashes[order]
            fresh_ = np.ones(len(owner), bool)
            fresh_[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1]).any(axis=1)
            gathered.append(hashes[fresh_])
            n += len(gathered[-1])
            if n >= FLUSH:
                yield from _sketch_rows(gathered, bits)
                gathered, n = [], 0
        if n:
            yield from _sketch_rows(gathered, bits)

    def merge(batches):
        at, once, twice = None, None, None

        def done():
            return pa.RecordBatch.from_pydict({"row": pa.array([at[0]], pa.int32()), "part": pa.array([at[1]], pa.int32()), "once": [None], "twice": [pa.compress(np.packbits(twice).tobytes(), codec="zstd", asbytes=True)]}, schema=_SKETCH)

        for batch in batches:
            for r in range(batch.num_rows):
                key = (batch.column(0)[r].as_py(), batch.column(1)[r].as_py())
                if key != at:
                    if at is not None:
                        yield done()
                    at, once, twice = key, np.zeros(1 << step, np.uint8), np.zeros(1 << step, np.uint8)
                seen = _unpack(batch.column(2)[r].as_py())
                twice[seen[once[seen] == 1]] = 1
                twice[_unpack(batch.column(3)[r].as_py())] = 1
                once[seen] = 1
        if at is not None:
            yield done()

    schema = "row int, part int, once binary, twice binary"
    parts = rows.mapInArrow(count, schema).repartition("row", "part").sortWithinPartitions("row", "part").mapInArrow(merge, schema)
    sketch = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(2)]
    size = (1 << step) // 8
    for r in parts.select("row", "part", "twice").toLocalIterator():  # 2 * 2**(bits - step) slices at most
        sketch[r["row"]][r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(pa.decompress(bytes(r["twice"]), size, codec="zstd", asbytes=True), np.uint8)
    return sketch


# h1, the upper half of h2 with the mark below it, id, and a span: first start * 2**24 + number of starts, as its bitwise
# complement (negative) where the span is decided.
_CANDIDATE = pa.schema([("h1", pa.int64()), ("h2_mark", pa.int64()), ("id", pa.int64()), ("span", pa.int64())])
LONGEST = (1 << 24) - 1


def _settled(gathered: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Group a partition's candidates: windows of all but the smallest id are decided, those of the smallest go on."""
    ids, marks, starts, hashes = (np.concatenate(x) for x in zip(*gathered, strict=True))
    order = np.lexsort((ids, hashes[:, 1], hashes[:, 0]))
    ids, marks, starts, hashes = ids[order], marks[order] & 0xFFFFFFFF, starts[order].astype(np.int64), hashes[order]
    new = np.ones(len(ids), bool)
    new[1:] = (hashes[1:] != hashes[:-1]).any(axis=1)
    lost = ids > ids[new][np.cumsum(new) - 1]
    out = ~lost
    upper = (hashes[out, 1] >> np.uint64(32)).astype(np.int64) << 32
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (hashes[out, 0].view(np.int64), upper | marks[out], ids[out], starts[out] << 24 | 1)], schema=_CANDIDATE)
    if lost.any():
        ids, marks, starts = ids[lost], marks[lost], starts[lost]
        order = np.lexsort((starts, marks, ids))
        ids, marks, starts = ids[order], marks[order], starts[order]
        cut = np.ones(len(ids), bool)
        cut[1:] = (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1]) | (starts[1:] > starts[:-1] + 1)
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(ids)) - 1
        length = starts[last] - starts[first] + 1
        pieces = -(-length // LONGEST)  # a longer run becomes several spans
        piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, length = np.repeat(first, pieces), np.minimum(np.repeat(length, pieces) - piece * LONGEST, LONGEST)
        # What is decided is dealt out by document.
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[first] ^ marks[first], marks[first], ids[first], ~(starts[first] + piece * LONGEST << 24 | length))], schema=_CANDIDATE)


def covered_windows(rows: DataFrame, sketch: list[np.ndarray], bits: int, window: int = WINDOW) -> DataFrame:
    """(id, mark, spans): (first start, number of starts) of windows that a document with a smaller id has too. `rows`: (id, mark, text)."""
    shared = rows.sparkSession.sparkContext.broadcast([s.tobytes() for s in sketch])

    def candidates(batches):
        bitmaps = [np.frombuffer(b, np.uint8) for b in shared.value]
        gathered, n = [], 0
        for keys, base, (owner, starts, hashes) in _windows(batches, window):
            near = np.ones(len(owner), bool)
            for bitmap, at in zip(bitmaps, _positions(hashes, bits), strict=True):
                near &= (bitmap[at >> np.uint32(3)] >> (np.uint8(7) - (at & np.uint32(7)).astype(np.uint8))) & np.uint8(1) == 1
            if near.any():
                known = np.array(keys, np.int64)[owner[near] - base]
                gathered.append((known[:, 0], known[:, 1], starts[near], hashes[near]))
                n += int(near.sum())
            if n >= SETTLE:
                yield from _settled(gathered)
                gathered, n = [], 0
        if n:
            yield from _settled(gathered)

    found = rows.mapInArrow(candidates, "h1 long, h2_mark long, id long, span long").repartition("h1")
    # A window has a row per settled portion at most, or one per occurrence in one document, so no group grows with the
    # documents that share it.
    decided = (F.col("span") < 0).alias("decided")
    half = F.shiftright("h2_mark", 32).alias("h2")
    keyed = found.select("h1", half, decided, "id", F.col("h2_mark").bitwiseAND(F.lit(0xFFFFFFFF)).alias("mark"), "span")
    first = F.min("id").over(Window.partitionBy("h1", "h2", "decided"))
    lost = keyed.withColumn("_first", first).where(F.col("decided") | (F.col("id") > F.col("_first")))
    plain = F.when(F.col("decided"), F.bitwise_not("span")).otherwise(F.col("span"))
    pair = F.struct(F.shiftright(plain, 24).alias("start"), plain.bitwiseAND(F.lit(LONGEST)).alias("n"))
    return lost.select("id", "mark", pair.alias("pair")).groupBy("id", "mark").agg(F.collect_list("pair").alias("spans"))  # at most a document's own windows


def without_repeats(text: str | None, spans: list | np.ndarray | None, window: int = WINDOW) -> tuple[int, int, str]:
    """(words, words removed, the kept words joined by one blank); spans are (first start, number of starts)."""
    words = text_words(text)
    if spans is None or not len(spans):
        return len(words), 0, b" ".join(words).decode("utf-8")
    edge = np.zeros(len(words) + 1, np.int64)
    begin = np.array([s["start"] for s in spans], np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + np.array([s["n"] for s in spans], np.int64) - 1 + window, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode("utf-8")


def sketch_bits(characters: int) -> int:
    """Four counters a row for each window to be expected (a word of six characters with its blank), within the limits."""
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, characters) / 6 * 4))))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with n_words, n_removed and kept_text: each word covered by a window that also starts in a document of a smaller id is gone.

    Windows are judged on the input. Ids are whole numbers; rows that repeat an id never take words from each other, and a
    null id comes after all others. Null and short texts lose nothing. Columns of those names are replaced. No rows give no rows.
    """
    kept = fresh(docs, "n_words", "n_removed", "kept_text", "_sub_id", "_sub_mark", "_sub_spans", "_sub_text", "_out")
    mark = F.hash(text_col).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    keyed = kept.withColumn("_sub_id", F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).withColumn("_sub_mark", mark)
    rows = keyed.select(F.col("_sub_id").alias("id"), F.col("_sub_mark").alias("mark"), F.col(text_col).alias("text"))
    bits = sketch_bits(docs.agg(F.sum(F.length(text_col))).first()[0] or 0)
    lost = covered_windows(rows, repeated_sketch(rows, bits, window), bits, window)
    # Texts travel to their spans once, compressed.
    packed = keyed.withColumn("_sub_text", F.pandas_udf(_shrink, "binary")(F.col(text_col))).drop(text_col)
    joined = packed.join(lost.select(F.col("id").alias("_sub_id"), F.col("mark").alias("_sub_mark"), F.col("spans").alias("_sub_spans")), ["_sub_id", "_sub_mark"], "left")

    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        whole = [_grow(t) for t in texts]
        rest = [without_repeats(t, s, window) for t, s in zip(whole, spans, strict=True)]
        return pd.DataFrame([(t, *r) for t, r in zip(whole, rest, strict=True)], columns=["text", "n_words", "n_removed", "kept_text"])

    out = joined.withColumn("_out", F.pandas_udf(cut, "text string, n_words long, n_removed long, kept_text string")("_sub_text", "_sub_spans"))
    own = [F.col("_out.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in kept.columns]
    return out.select(*own, "_out.n_words", "_out.n_removed", "_out.kept_text")


def _shrink(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else zstandard.compress(t.encode("utf-8", "replace"), 3) for t in texts], dtype=object)


def _grow(data: bytes | None) -> str | None:
    return None if data is None else zstandard.decompress(data).decode("utf-8")
