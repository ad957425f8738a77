"""Quality by Bradley-Terry ranking: P(a is better than b) = sigmoid(score(a) - score(b)).

A score is linear in the features of a text. Preference pairs are a good and a
bad labelled document; logistic loss on the difference of their features gives
the weights. The cut is a quantile of the scores of the labelled documents, the
share of bad ones among them, and a score is shown as sigmoid(score - cut), so
that 1/2 is the cut.

Only the weights come from a bounded part: at most `sample` labelled rows, the first by a
seeded hash of the id, are learned from. The cut is taken over all labelled
documents. Scoring covers every text and has no shuffle.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import cut_lineage
from .common import seeded

SAMPLE = 50_000
PAIRS = 8  # partners of each document
FEATURES = (
    "log_words", "few_words", "word_length", "word_length_off", "symbols", "marks", "bangs", "digits", "uppers", "shouts", "distinct", "top_word",
    "repeated_lines", "line_words", "repeated_pairs", "letters", "spaces", "longest_word",
)
_CLASSES = {"symbols": b"#*$%&|<>~^_=\\/{}[]@", "marks": b".,;:?", "bangs": b"!", "digits": string.digits.encode(), "uppers": string.ascii_uppercase.encode(), "lowers": string.ascii_lowercase.encode()}
_TABLE = np.array([[b in chars for b in range(256)] for chars in _CLASSES.values()], np.int64)


def features(text: str | None) -> list[float]:
    """Numbers of a whole text in a fixed range; of a text without words all 0 but `few_words`."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0, 1.0] + [0.0] * (len(FEATURES) - 2)
    chars, length = max(1, len(text)), sum(map(len, words))
    per_byte = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    symbols, marks, bangs, digits, uppers, lowers = (_TABLE @ per_byte).tolist()
    beyond = int(per_byte[0xC0:].sum())  # characters outside ASCII
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    shouts = sum(1 for w in words if w.isupper() and len(w.strip(string.punctuation)) > 1)
    mean = length / n
    return [
        math.log1p(n), 1.0 if n < 20 else 0.0, min(mean, 20.0), min(abs(mean - 5.0), 10.0), min(symbols / n, 3.0), min(marks / n, 2.0),
        min(bangs / n, 2.0), digits / chars, uppers / chars, shouts / n,
        # words repeat more in longer texts; compare with n ** 0.9
        min(len(counts) / n**0.9, 2.0), max(counts.values()) / n, 1 - len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines))),
        1 - len(set(zip(words, words[1:], strict=False))) / max(1, n - 1), (uppers + lowers + beyond) / chars, 1 - length / chars,
        math.log1p(max(map(len, words))),
    ]


def feature_column(text: Column) -> Column:
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts], dtype=object)

    return F.pandas_udf(of, "array<double>")(text)


@dataclass(frozen=True)
class PairwiseModel:
    """score = weights . (features - centre) / spread, clipped at 4 spreads; shown as sigmoid((score - cut) * slope).

    `NEUTRAL` is the model of no preference: every score is 1/2, the cut, so it keeps everything.
    """

    centre: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]
    cut: float
    slope: float

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return basis(rows, np.array(self.centre), np.array(self.spread)) @ np.array(self.weights)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.raw(rows) - self.cut) * self.slope, -500, 500)))


def basis(rows: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standardised features and their squares, both clipped."""
    z = np.clip((rows - centre) / spread, -4, 4)
    return np.concatenate([z, z * z / 4], axis=1)


NEUTRAL = PairwiseModel((0.0,) * len(FEATURES), (1.0,) * len(FEATURES), (0.0,) * 2 * len(FEATURES), 0.0, 1.0)


def preference_pairs(rows: DataFrame, partners: int = PAIRS, seed: int = 0) -> DataFrame:
    """Feature differences (good minus bad) of `partners` pairs per document of the rarer side and at least one of the other.

    Both sides are numbered by a seeded hash; pair number i joins good i and bad i * step, each modulo its side's size.
    That is an equality join on numbers: no two sides are multiplied. `rows`: _id, _good (boolean), _x (array of double).
    """
    order = Window.partitionBy("_good").orderBy(seeded(seed, "_id"), "_id")  # at most `sample` rows, see train
    numbered = rows.withColumn("_at", F.row_number().over(order) - 1)
    sizes = {r["_good"]: r["n"] for r in numbered.groupBy("_good").agg(F.count("*").alias("n")).collect()}
    good, bad = sizes.get(True, 0), sizes.get(False, 0)
    if not good or not bad:
        raise ValueError("preference pairs need labelled documents of both kinds")
    total = max(good, bad, partners * min(good, bad))
    numbers = rows.sparkSession.range(total).withColumn("_g", F.col("id") % good).withColumn("_b", (F.col("id") + F.floor(F.col("id") / F.lit(math.lcm(good, bad)))) % bad)
    a = numbered.where("_good").select(F.col("_at").cast("long").alias("_g"), F.col("_x").alias("_u"))
    b = numbered.where("not _good").select(F.col("_at").cast("long").alias("_b"), F.col("_x").alias("_v"))
    joined = numbers.join(a, "_g").join(b, "_b")
    return joined.select("id", F.zip_with("_u", "_v", lambda u, v: F.round(u - v, 9)).alias("difference"))  # equal features differ by exactly 0


def _at_ranks(scores: DataFrame, ranks: set[int], few: int = 100_000, bins: int = 1 << 16) -> dict[int, float]:
    """Values of `raw` at ranks counted from 0, exact for any number of rows: bins are counted, and those of the ranks opened.

    The bin number never falls as `raw` rises, so bins keep the order; the driver sees `bins` counts or `few` values at a time.
    """
    low, high, n = scores.agg(F.min("raw"), F.max("raw"), F.count("raw")).first()
    if low == high:
        return dict.fromkeys(ranks, low)
    if n <= few:
        values = sorted(r["raw"] for r in scores.select("raw").collect())
        return {r: values[r] for r in ranks}
    at = F.floor((F.col("raw") - low) / (high - low) * bins)
    out, below = {}, 0
    for bin_, held in sorted((r["at"], r["n"]) for r in scores.groupBy(at.alias("at")).agg(F.count("*").alias("n")).collect()):
        if inside := {r - below for r in ranks if below <= r < below + held}:
            out |= {r + below: v for r, v in _at_ranks(scores.where(at == bin_), inside, few, bins).items()}
        below += held
    return out


def _quantiles(scores: DataFrame, shares: list[float]) -> list[float]:
    """Quantiles of `raw`, between two ranks in proportion."""
    last = scores.count() - 1
    places = [s * last for s in shares]
    values = _at_ranks(scores, {f(p) for p in places for f in (math.floor, math.ceil)})
    return [values[math.floor(p)] + (values[math.ceil(p)] - values[math.floor(p)]) * (p - math.floor(p)) for p in places]


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 0,
    one_sided: str = "raise",
) -> PairwiseModel:
    """Learn from about `sample` rows of `labels` (id, label) at most; null ids and labels are left out. Runs jobs.

    The sampled labels are bounded by `sample`, so they are broadcast to the documents and no text is shuffled. The cut
    comes from the scores of all labelled documents; where not all were learned from, all documents are scored once for
    it, and only their ids and scores are shuffled. Documents
    repeated under one id count once; where labels of one id disagree the higher one counts. Without any labelled document, as with empty tables, the model is NEUTRAL. Where all
    labelled documents are of one kind this raises, or gives NEUTRAL with `one_sided="neutral"`.
    """
    labelled = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) == 1).alias("_good"))
    share = min(1.0, sample / max(1, labelled.count()))
    known = labelled.where(F.pmod(seeded(seed, "_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(F.broadcast(known), F.col("_doc") == F.col("_id"))
    known = cut_lineage(texts.select("_id", "_good", feature_column(F.col("_text")).alias("_f")).groupBy("_id", "_good").agg(F.min("_f").alias("_f")))
    width = len(FEATURES)
    stats = known.agg(*[f(F.col("_f")[i]) for i in range(width) for f in (F.avg, F.stddev_pop)]).first()
    if stats[0] is None:
        return NEUTRAL
    if one_sided == "neutral" and known.agg(F.count_distinct("_good")).first()[0] < 2:
        return NEUTRAL
    centre, spread = np.array(stats[0::2], float), np.array(stats[1::2], float)
    spread = np.where(spread > 1e-6, spread, np.inf)  # a feature that does not vary counts for nothing

    def expand(batch: pd.Series) -> pd.Series:
        return pd.Series(list(basis(np.stack(batch.to_list()), centre, spread)), dtype=object)

    rows = cut_lineage(known.select("_id", "_good", F.pandas_udf(expand, "array<double>")("_f").alias("_x")))
    pairs = preference_pairs(rows, seed=seed)
    # One difference tells the same as its negative with the other label; half are turned so that both labels occur.
    turned = F.col("id") % 2 == 0
    signed = F.when(turned, F.col("difference")).otherwise(F.transform("difference", lambda d: -d))
    data = cut_lineage(pairs.select(array_to_vector(signed).alias("features"), turned.cast("double").alias("label")))
    fitted = LogisticRegression(fitIntercept=False, standardization=False, regParam=1e-3, maxIter=60).fit(data)
    weights = np.array(fitted.coefficients.toArray())
    if share < 1:
        fit = PairwiseModel(tuple(centre), tuple(spread), tuple(weights), 0.0, 1.0)

        def raw_of(texts: pd.Series) -> pd.Series:
            return pd.Series(fit.raw(np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))))

        every = docs.select(F.col(id_col).alias("_doc"), F.pandas_udf(raw_of, "double")(F.col(text_col)).alias("raw"))
        scored = every.join(labelled, F.col("_doc") == F.col("_id")).groupBy("_id", "_good").agg(F.min("raw").alias("raw"))
    else:
        raw = F.aggregate(F.zip_with("_x", F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        scored = rows.select("_good", raw.alias("raw"))
    scored = cut_lineage(scored.select("_good", "raw"))
    share = scored.agg(F.avg((~F.col("_good")).cast("double"))).first()[0]
    cut, low, high = _quantiles(scored, [share, share / 2, (1 + share) / 2])
    # The cut lies between the best of the bad share and the next one above.
    above = scored.where(F.col("raw") > cut).agg(F.min("raw")).first()[0]
    cut = (cut + above) / 2 if above is not None else cut
    slope = 4 / max(high - low, 1e-6)
    return PairwiseModel(tuple(centre), tuple(spread), tuple(weights), float(cut), float(slope))


def quality_scores(docs: DataFrame, model: PairwiseModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the score of every text, null and empty ones included, 0 to 1. A column of that name is replaced."""

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))))

    return docs.withColumn(score_col, F.pandas_udf(of, "double")(F.col(text_col)))


def keep_good(docs: DataFrame, model: PairwiseModel, text_col: str = "text") -> DataFrame:
    """Documents at or above the cut."""
    return quality_scores(docs, model, text_col, "_score").where("_score >= 0.5").select(*[F.col(f"`{c}`") for c in docs.columns])
