"""Quality rules as a ledger of bits.

Each rule is evaluated once per document; its failure is one bit of a long and
its measurement a column. Policies are masks over the bits: a document passes a
policy when none of the policy's bits is set, so a new version or an ablation
reads the ledger and never the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the measurements that rules look at, all longs: n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, n_upper_words. Null and empty texts measure 0. Columns of those names are replaced.

    Repeated windows are found by 64-bit hashes of their words within one text; only texts where two are equal are sorted.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = fresh(docs, *[n for n in names if n != text_col])
    rows = kept.withColumn("_words", words(F.col(text_col)))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("_lines", lines).withColumn("_n", F.size("_words"))
    hashes = F.transform(F.sequence(F.lit(1), F.col("_n") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))
    none = F.array().cast("array<bigint>")
    rows = rows.withColumn("_hashes", F.when(F.col("_n") > WINDOW, hashes).otherwise(none))
    pairs = F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    twice = F.size("_hashes") > F.size(F.array_distinct("_hashes"))
    rows = rows.withColumn("_pairs", F.when(twice, pairs))

    def again(x, i):
        def same(j):
            return F.coalesce(F.get("_pairs", j)["h"] == x["h"], F.lit(False))

        return same(i - 1) | same(i + 1)

    starts = F.array_sort(F.transform(F.filter("_pairs", again), lambda x: x["at"]))
    rows = rows.withColumn("_starts", starts)
    covered = F.transform("_starts", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", i + 1), p + WINDOW) - p))

    def add(s, v):
        return s + v

    zero = F.lit(0).cast("long")
    chars = F.aggregate("_words", zero, lambda s, w: s + F.length(w))
    upper = F.size(F.filter("_words", lambda w: w.rlike("[A-Z].*[A-Z]") & ~w.rlike("[a-z]")))
    out = {
        "n_words": F.col("_n"), "word_chars": chars,
        "n_symbols": F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]", "")),
        "n_lines": F.size("_lines"), "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.coalesce(F.aggregate(covered, F.lit(0), add), F.lit(0)), "n_upper_words": upper,
    }
    return rows.select(*[F.col(f"`{c}`") for c in kept.columns], *[c.cast("long").alias(n) for n, c in out.items()])


def standard_rules() -> list[Rule]:
    """Bit 0 first. The order is part of the ledger: add new rules at the end only."""
    n = F.col("n_words")
    return [
        Rule("few_words", n < 20),
        Rule("repeated_windows", 100 * F.col("n_repeat_words") > 30 * n),
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        Rule("word_length", (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 12 * n)),
        Rule("shouting", 2 * F.col("n_upper_words") > n),
    ]


# Versions of the policy, by rule names.
POLICIES = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbols", "repeated_lines"],
    "v2": ["few_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "shouting"],
}


def ledger(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """`measured` rows with `failed`, a long whose bit i is set where rule i fails. A rule that gives null does not fail."""
    rules = rules or standard_rules()
    if len(rules) > 63:
        raise ValueError("a ledger holds at most 63 rules")
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.coalesce(rule.fails, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured(docs, text_col).withColumn("failed", bits)


def policy_mask(names: list[str], rules: list[Rule] | None = None) -> int:
    known = [r.name for r in rules or standard_rules()]
    return sum(1 << known.index(n) for n in names)


def passes(mask: int) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask)) == 0


def ablations(ledgers: DataFrame, mask: int, rules: list[Rule] | None = None) -> DataFrame:
    """(rule, n_failed, n_only, n_kept, n_kept_without): what each rule of the policy does, and what leaving it out would keep.

    Documents are counted once per pattern of bits, with partial counts before the shuffle; the rest is arithmetic on
    at most 2**rules patterns.
    """
    rules = rules or standard_rules()
    patterns = ledgers.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(rules) if mask >> i & 1]))
    rows = patterns.select("bits", "n", each.alias("_r")).select("bits", "n", "_r.rule", "_r.bit")

    def count(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    bits, bit = F.col("bits"), F.col("bit")
    return rows.groupBy("rule").agg(
        count(bits.bitwiseAND(bit) != 0).alias("n_failed"), count(bits == bit).alias("n_only"),
        count(bits == 0).alias("n_kept"), count(bits.bitwiseAND(F.bitwise_not(bit)) == 0).alias("n_kept_without"),
    )
