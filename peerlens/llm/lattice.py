"""Score texts by the likelihood of all their segmentations into subwords.

The pieces come from an existing vocabulary file and are never trained. Its
scores rank the pieces; 1 / (1 + |score|) is their first weight. One pass of
expected counts under those weights over the words of the training rows gives
each piece its frequency, with the first weights as a prior. A word's probability
is the sum over all its segmentations, by the forward recursion in log space;
a text's is the product over its words and one end mark.

Pieces do not cross words, so a word is scored once, wherever it occurs: words
are counted over the whole corpus, scored as a table, and brought back. Words with
1 / FREQUENT of all tokens or more, at most FREQUENT of them, are broadcast; other
words are joined, and none of those is hot.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import cut_lineage

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FREQUENT = 1_000_000  # a word with this share of all tokens or more is frequent; so there are no more of them than this
FLUSH = 400_000  # different words that a task counts before it sends them on
SPACE = "▁"  # how the vocabulary writes the blank before a word
PRIOR = 1000.0  # pieces' worth of the vocabulary's own weights
END = ""  # the end mark among words, which are never empty
NEVER = -1e4


def load_pieces(path: str = VOCABULARY) -> list[tuple[str, float, int]]:
    """(piece, score, byte) of a vocabulary file, without control pieces; `byte` is -1 for ordinary pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i):
            continue
        text = model.id_to_piece(i)
        pieces.append((text, model.get_score(i), int(text[3:5], 16) if model.is_byte(i) else -1))
    return pieces


def first_weights(pieces: list[tuple[str, float, int]]) -> np.ndarray:
    """Probabilities from the vocabulary's scores: 1 / (1 + |score|), byte pieces like the last rank."""
    worst = max(abs(s) for _, s, _ in pieces)
    w = np.array([1 / (1 + (abs(s) if b < 0 else worst)) for _, s, b in pieces])
    return w / w.sum()


class Lattice:
    """All segmentations of many words at once. `logs`: natural logarithms of the pieces' probabilities."""

    def __init__(self, pieces: list[tuple[str, float, int]], logs: np.ndarray):
        self.logs = logs
        self.lengths = np.array([len(t) if b < 0 else 0 for t, _, b in pieces])
        self.bytes = {b: i for i, (_, _, b) in enumerate(pieces) if b >= 0}
        self.single = {t for t, _, b in pieces if b < 0 and len(t) == 1}
        self.automaton = ahocorasick.Automaton()
        for i, (t, _, b) in enumerate(pieces):
            if b < 0:
                self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.spellings: dict[str, float] = {}  # at most one entry per character there is

    def spelled(self, char: str) -> float:
        """Log probability of a character that is no piece: its bytes."""
        if char not in self.spellings:
            self.spellings[char] = float(sum(self.logs[self.bytes[b]] for b in char.encode("utf-8", "replace")))
        return self.spellings[char]

    def _edges(self, words: list[str]):
        text = "\n".join(SPACE + w for w in words)
        lengths = np.array([len(w) + 1 for w in words])
        begin = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        packed = np.fromiter(((end << 20) | i for end, i in self.automaton.iter(text)), np.int64)
        piece, stop = packed & ((1 << 20) - 1), (packed >> 20) + 1
        start, weight = stop - self.lengths[piece], self.logs[piece]
        odd = [i for i, c in enumerate(text) if c not in self.single and c != "\n"] if set(text) - self.single - {"\n"} else []
        if odd:
            at = np.array(odd)
            start, stop = np.concatenate([start, at]), np.concatenate([stop, at + 1])
            weight = np.concatenate([weight, [self.spelled(text[i]) for i in odd]])
            piece = np.concatenate([piece, np.full(len(odd), -1)])
        word = np.searchsorted(begin, start, side="right") - 1
        return begin, lengths, start, stop, weight, piece, word, len(text)

    @staticmethod
    def _recursion(n: int, seeds: np.ndarray, frm: np.ndarray, to: np.ndarray, weight: np.ndarray, level: np.ndarray) -> np.ndarray:
        """log-sum-exp over edges, level by level; positions of one level do not depend on each other."""
        value = np.full(n + 2, NEVER)
        value[seeds] = 0.0
        order = np.lexsort((to, level))
        frm, to, weight, level = frm[order], to[order], weight[order], level[order]
        borders = np.append(np.flatnonzero(np.diff(level, prepend=-1)), len(level))
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            target, x = to[a:b], value[frm[a:b]] + weight[a:b]
            cut = np.flatnonzero(np.diff(target, prepend=-1))
            most = np.maximum.reduceat(x, cut)
            sums = np.add.reduceat(np.exp(x - np.repeat(most, np.diff(np.append(cut, len(x))))), cut)
            value[target[cut]] = most + np.log(sums)
        return value

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural logarithm of each word's probability."""
        if not words:
            return np.zeros(0)
        begin, lengths, start, stop, weight, _, word, n = self._edges(words)
        forward = self._recursion(n, begin, start, stop, weight, stop - begin[word])
        return forward[begin + lengths]

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece over words that occur so often."""
        if not words:
            return np.zeros(len(self.logs))
        begin, lengths, start, stop, weight, piece, word, n = self._edges(words)
        forward = self._recursion(n, begin, start, stop, weight, stop - begin[word])
        ends = begin + lengths
        backward = self._recursion(n, ends, stop, start, weight, ends[word] - start)
        share = np.exp(forward[start] + weight + backward[stop] - forward[ends][word])
        known = piece >= 0
        return np.bincount(piece[known], weights=(share * counts[word])[known], minlength=len(self.logs))


def _text_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()  # on bytes both touch ASCII only


def _strings(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c): every word with its number of tokens in training rows (0 where it occurs in others only), and the end mark.

    `rows`: (train boolean, text). Each task adds up before the shuffle.
    """
    schema = pa.schema([("word", pa.string()), ("c", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]):
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([_strings(list(counts)), pa.array(list(counts.values()), pa.int64())], schema=schema)

        for batch in batches:
            train, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                words = _text_words(texts[i].as_py())
                if train[i].as_py():
                    counts.update(words)
                    counts[b""] += 1
                else:
                    for w in set(words):
                        counts.setdefault(w, 0)
                if len(counts) > FLUSH:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return rows.mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


BATCH = 5_000  # words of a lattice at a time, and no more than so many characters
BATCH_CHARS = 200_000


def _portions(words: list[str]) -> Iterator[slice]:
    begin = chars = 0
    for i, w in enumerate(words):
        chars += len(w)
        if i + 1 - begin >= BATCH or chars >= BATCH_CHARS:
            yield slice(begin, i + 1)
            begin, chars = i + 1, 0
    if begin < len(words):
        yield slice(begin, len(words))


def fit_pieces(counts: DataFrame, pieces: list[tuple[str, float, int]]) -> tuple[np.ndarray, float]:
    """(log probabilities of the pieces, that of the end mark), learned from `counts` (word, c).

    Expected counts are summed up per task; what reaches the driver is one number for each piece of the vocabulary.
    """
    start = first_weights(pieces)
    shared = counts.sparkSession.sparkContext.broadcast((pieces, np.log(start)))

    def gather(batches):
        lattice = Lattice(*shared.value)
        total = np.zeros(len(lattice.logs))
        for batch in batches:
            words, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for part in _portions(words):
                total += lattice.expected(words[part], c[part])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "uses"])

    used = counts.where((F.col("c") > 0) & (F.col("word") != END)).mapInArrow(gather, "piece long, uses double")
    # Whole millionths, so that the sum does not depend on the order.
    used = used.groupBy("piece").agg(F.sum(F.round(F.col("uses") * 1e6).cast("decimal(20,0)")).alias("uses"))
    uses = np.zeros(len(pieces))
    for r in used.collect():  # one row per piece of the vocabulary at most
        uses[r["piece"]] = float(r["uses"]) / 1e6
    ends = counts.where(F.col("word") == END).agg(F.sum("c")).first()[0] or 0
    total = uses.sum() + ends + PRIOR + 1
    return np.log((uses + PRIOR * start) / total), math.log((ends + 1) / total)


def score_words(counts: DataFrame, pieces, logs: np.ndarray, end_log: float) -> DataFrame:
    """Add `log`, the log10 probability of the word."""
    shared = counts.sparkSession.sparkContext.broadcast((pieces, logs))
    schema = pa.schema([("word", pa.string()), ("c", pa.int64()), ("log", pa.float64())])

    def score(batches):
        lattice = Lattice(*shared.value)
        for batch in batches:
            words = batch.column(0).to_pylist()
            parts = [lattice.log_probabilities(words[p]) for p in _portions(words)]
            logs_ = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(logs_ / math.log(10))], schema=schema)

    scored = counts.where(F.col("word") != END).select("word", "c").mapInArrow(score, "word string, c long, log double")
    return scored.unionByName(counts.where(F.col("word") == END).select("word", "c", F.lit(end_log / math.log(10)).alias("log")))


def score_texts(
    docs: DataFrame, train: Column, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text",
    load: Callable[[str], list] = load_pieces,
) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) for every row of `docs`; logarithms to base 10.

    Ids are of any type, or null. `train` says which rows may be learned from (null: no). A null text is empty; an empty text is its end mark. Rows
    repeated with one id and text come back as often. Without training rows the base knows no tokens and the pieces keep
    the vocabulary's weights. `base_score` is the smoothed unigram of whole words, see the query's contract.
    """
    pieces = load(vocabulary)
    learn = F.coalesce(train, F.lit(False))
    counts = cut_lineage(word_counts(docs.select(learn.alias("train"), F.col(text_col).alias("text"))))
    tokens, known = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    logs, end_log = fit_pieces(counts, pieces)
    table = score_words(counts, pieces, logs, end_log)
    base = F.log10((F.col("c") + F.lit(0.1)) / F.lit(tokens + 0.1 * (known + 1)))
    table = cut_lineage(table.withColumn("base", base))
    common = table.where((F.col("c") > 0) & (F.col("c") * FREQUENT >= tokens)).select("word", "base", "log")
    top = {r["word"].encode(): (1, r["base"], r["log"]) for r in common.toLocalIterator()}  # FREQUENT rows at most
    shared = docs.sparkSession.sparkContext.broadcast(top)
    # The end mark is looked up even if the corpus has no training row, and so no such count.
    nothing = (0, math.log10(0.1 / (tokens + 0.1 * (known + 1))), end_log / math.log(10))
    fields = pa.schema(
        [("id", pa.int64()), ("train", pa.bool_()), ("mark", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("log", pa.float64())]
    )

    def split(batches):
        frequent = shared.value
        end = frequent.get(b"", nothing)
        for batch in batches:
            ids, train_, marks, texts = (batch.column(i) for i in range(4))
            schema = fields.set(0, pa.field("id", ids.type))
            rows: list[list] = [[] for _ in range(8)]
            rare_words: list[bytes] = []
            for i in range(batch.num_rows):
                n, k, b, s = 1, *end
                rest = []
                for w, times in Counter(_text_words(texts[i].as_py())).items():
                    n += times
                    got = frequent.get(w)
                    if got is None:
                        rest.append((w, times))
                    else:
                        k += times * got[0]
                        b += times * got[1]
                        s += times * got[2]
                key = ids[i].as_py(), train_[i].as_py(), marks[i].as_py()
                rare_words.append(None)
                for column, v in zip(rows, (*key, None, n, k, b, s), strict=True):
                    column.append(v)
                for w, times in rest:
                    rare_words.append(w)
                    for column, v in zip(rows, (*key, None, times, 0, 0.0, 0.0), strict=True):
                        column.append(v)
                if len(rare_words) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) if t.name != "word" else _strings(rare_words) for c, t in zip(rows, schema, strict=True)], schema=schema)
                    rows, rare_words = [[] for _ in range(8)], []
            if rare_words:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) if t.name != "word" else _strings(rare_words) for c, t in zip(rows, schema, strict=True)], schema=schema)

    keyed = docs.select(F.col(id_col).alias("id"), learn.alias("train"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    kind = keyed.schema["id"].dataType.simpleString()
    parts = keyed.mapInArrow(split, f"id {kind}, train boolean, mark long, word string, n long, known long, base double, log double")
    key = ["id", "train", "mark"]
    # Documents (word is null) and their rarer words go through one outer join; rows without a word are dealt out by their id.
    salt = F.coalesce(F.col("word"), F.concat(F.lit("\n"), F.col("id").cast("string"), F.lit("\n"), F.col("mark").cast("string")))
    rare = table.select(F.col("word").alias("_key"), F.col("c").alias("_c"), F.col("base").alias("_base"), F.col("log").alias("_log"))
    joined = parts.withColumn("_key", salt).join(rare, "_key", "left")
    whole = F.col("word").isNull()
    n = F.col("n")

    def total(mine, theirs):
        return F.sum(F.when(whole, F.col(mine)).otherwise(theirs))

    summed = joined.groupBy(*key).agg(
        F.count(F.when(whole, 1)).alias("_rows"), F.sum(F.when(whole, n)).alias("n_tokens"),
        total("known", n * (F.col("_c") > 0).cast("long")).alias("n_known"),
        total("base", n * F.col("_base")).alias("base_score"), total("log", n * F.col("_log")).alias("score"),
    )
    each = [(F.col(c) / F.col("_rows")).cast("long").alias(c) for c in ("n_tokens", "n_known")]
    scores = [(F.col(c) / F.col("_rows")).alias(c) for c in ("base_score", "score")]
    one = summed.select("id", "train", *each, F.lit(int(tokens)).cast("long").alias("train_tokens"), *scores, F.explode(F.sequence(F.lit(1), F.col("_rows"))).alias("_copy"))
    return one.drop("_copy")
