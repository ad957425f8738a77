import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerlens.llm import lattice, packing, queries

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small():
    pieces = [(f"<0x{b:02X}>", 0.0, b) for b in range(256)]
    texts = ["▁", "a", "b", "c", "▁a", "ab", "bc", "abc", "▁ab", "aa", "é"]
    return pieces + [(t, -float(i), -1) for i, t in enumerate(texts)]


def _all_ways(word, logs, pieces):
    """Sum over every segmentation, written out."""
    text, ways = "▁" + word, {t: i for i, (t, _, b) in enumerate(pieces) if b < 0}
    byte = {b: i for i, (_, _, b) in enumerate(pieces) if b >= 0}

    def go(at):
        if at == len(text):
            return [(1.0, Counter())]
        out = []
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in ways:
                i = ways[text[at:end]]
                out += [(math.exp(logs[i]) * p, c + Counter([i])) for p, c in go(end)]
        if text[at] not in ways:
            p = math.exp(sum(logs[byte[b]] for b in text[at].encode()))
            out += [(p * q, c) for q, c in go(at + 1)]
        return out

    return go(0)


def test_forward_recursion_sums_all_segmentations(small):
    logs = np.log(lattice.first_weights(small))
    net = lattice.Lattice(small, logs)
    words = ["a", "abc", "aabcab", "bé", "xab", "日本a", "cab", "a▁b"]
    got = net.log_probabilities(words)
    for w, v in zip(words, got, strict=True):
        assert math.isclose(v, math.log(sum(p for p, _ in _all_ways(w, logs, small))), rel_tol=1e-9)
    counts = np.arange(1, len(words) + 1)
    want = np.zeros(len(small))
    for w, n in zip(words, counts, strict=True):
        ways = _all_ways(w, logs, small)
        total = sum(p for p, _ in ways)
        for p, c in ways:
            for i, k in c.items():
                want[i] += n * k * p / total
    assert np.allclose(net.expected(words, counts), want)
    assert math.isclose(net.log_probabilities(["abc" * 20_000])[0], net.log_probabilities(["abc" * 20_000, "a"])[0])


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _base(docs, train):
    counts = Counter(t for i, x in docs for t in ([*_words(x), "\n"] if train(i) else []))
    total, distinct = sum(counts.values()), len(counts)
    return counts, total, lambda ws: sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)


def test_score_query_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lattice, "FREQUENT", 500)  # both ways to a word's score
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()]
    counts, total, base = _base(docs, lambda i: zlib.crc32(str(i).encode()) % 10 != 0)
    got = {r["doc_id"]: r for r in queries.op5_subword_lattice(spark, ROOT).collect()}
    assert len(got) == len(docs)
    pieces = lattice.load_pieces()
    table = spark.createDataFrame([("" if w == "\n" else w, n) for w, n in counts.items()], "word string, c long")
    logs, end = lattice.fit_pieces(table, pieces)
    assert math.isclose(np.exp(logs).sum() + math.exp(end), 1, rel_tol=1e-6)
    net, held = lattice.Lattice(pieces, logs), []
    for i, text in docs:
        ws, r = _words(text), got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 10 == 0, len(ws) + 1, total)
        assert r["n_known"] == sum(counts[w] > 0 for w in [*ws, "\n"])
        assert math.isclose(r["base_score"], base([*ws, "\n"]), rel_tol=1e-9)
        assert math.isclose(r["score"], (net.log_probabilities(ws).sum() + end) / math.log(10), rel_tol=1e-9)
        if r["held_out"]:
            held.append((r["score"], r["n_tokens"]))
    start = lattice.Lattice(pieces, np.log(lattice.first_weights(pieces) * (1 - math.exp(end))))
    plain = sum((start.log_probabilities(_words(t)).sum() + end) / math.log(10) for i, t in docs if got[i]["held_out"])
    assert sum(s for s, _ in held) > plain  # learning raises the likelihood of texts that were not learned from


def test_scores_of_odd_rows(table):
    rows = [(1, "The cat"), (1, "The cat"), (2, None), (3, ""), (None, "the the dog"), (4, "x" * 30_000), (5, "日本 THE É")]
    docs = table("doc_id long, text string, word string, train int", *[(*r, "clash", 1) for r in rows])
    out = lattice.score_texts(docs, F.col("doc_id") != 5).collect()
    assert sorted((r["id"] is None, r["id"] or 0) for r in out) == sorted((i is None, i or 0) for i, _ in rows)
    counts, total, base = _base([(i, t) for i, t in rows], lambda i: i not in (5, None))
    for r in out:
        text = next(t for i, t in rows if i == r["id"])
        assert r["n_tokens"] == len(_words(text)) + 1 and math.isclose(r["base_score"], base([*_words(text), "\n"]), rel_tol=1e-9) and r["score"] < 0
    assert lattice.score_texts(docs.where("false"), F.lit(True)).collect() == []
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in lattice.score_texts(docs, F.lit(False)).collect())


def _best_fit(lengths, capacities, cost):
    """One piece at a time; the filler is what the pieces still to come can add, less the room that is open."""
    bins, todo = [], sorted(lengths, reverse=True)
    for at, n in enumerate(todo):
        fits = [b for b in bins if b[0] - b[1] >= n]
        if fits:
            b = min(fits, key=lambda b: b[0] - b[1])
        else:
            shorter = sum(x for x in todo[at:] if x < n)
            b = [packing.cheapest(n, capacities, cost, shorter - sum(c - u for c, u in bins)), 0]
            bins.append(b)
        b[1] += n
    return sorted(u for _, u in bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_of_one_size_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [min(64, int(rng.expovariate(1 / 12)) + 1) for _ in range(400)]
    plan = packing.plan_bins(Counter(lengths), (64,))
    used = sorted(u for _, number, u in plan.bins for _ in range(number))
    assert used == _best_fit(lengths, (64,), packing.sequence_cost)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    hist = {n: rng.randint(1, 10**rng.randint(0, 6)) for n in rng.sample(range(1, 513), 60)}
    capacities = (64, 128, 512)
    plan = packing.plan_bins(hist, capacities)
    ranks = {}
    for length, first, n, *_ in plan.runs:
        assert ranks.get(length, 0) == first
        ranks[length] = first + n
    assert ranks == hist
    total = sum(k * v for k, v in hist.items())
    assert sum(number * used for _, number, used in plan.bins) == total
    at = 0
    for first, number, used in plan.bins:
        assert first == at and 0 < used <= 512
        at += number
    down = sum(number * min(c for c in capacities if c >= used) for _, number, used in plan.bins)
    fixed = sum(number * 512 for _, number, used in packing.plan_bins(hist, (512,)).bins)
    assert total <= down <= fixed and len(plan.runs) < 5000


def _packed_holds(rows, docs, capacities):
    most, want = capacities[-1], Counter()
    for i, t in docs:
        n = len(_words(t)) + 1
        want.update((i, k, k * most, min(most, n - k * most)) for k in range((n - 1) // most + 1))
    assert Counter((r["id"], r["piece"], r["first_word"], r["length"]) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["bin"], []).append(r)
    assert sorted(bins) == list(range(len(bins)))
    for parts in bins.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert {(r["used"], r["capacity"]) for r in parts} == {(at, min(c for c in capacities if c >= at))}


def test_packing_query_places_everything(spark):
    root = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{root}/documents.parquet").collect()]
    rows = [r.asDict() | {"id": r["doc_id"]} for r in queries.op7_best_fit_packing(spark, root).collect()]
    _packed_holds(rows, docs, packing.CAPACITIES)
    used = {r["bin"]: (r["used"], r["capacity"]) for r in rows}
    assert sum(u for u, _ in used.values()) > 0.97 * sum(c for _, c in used.values())
    again = {(r["doc_id"], r["piece"]): (r["bin"], r["offset"]) for r in queries.op7_best_fit_packing(spark, root).collect()}
    assert again == {(r["doc_id"], r["piece"]): (r["bin"], r["offset"]) for r in rows}


def test_packing_of_odd_rows(table):
    rows = [(1, "a b c"), (1, "a b c"), (None, None), (2, ""), (3, "w " * 1000), (4, "w " * 63)]
    docs = table("doc_id long, text string, bin int, length string", *[(*r, 1, "clash") for r in rows])
    out = packing.pack(docs, (16, 64))
    _packed_holds(out.collect(), rows, (16, 64))
    merged = packing.sequences(out).collect()
    assert sum(len(r["parts"]) for r in merged) == out.count()
    assert packing.pack(docs.where("false")).collect() == []
    with pytest.raises(ValueError):
        packing.pack(docs, ())


def test_string_ids_are_scored_alike(table):
    rows = [(i, t) for i, t in enumerate(["one two two", "three", None, "one é"])]
    train = F.col("text").isNotNull()
    numbers = {r["id"]: r["score"] for r in lattice.score_texts(table("doc_id long, text string", *rows), train).collect()}
    names = {r["id"]: r["score"] for r in lattice.score_texts(table("doc_id string, text string", *[(f"d{i}", t) for i, t in rows]), train).collect()}
    assert names == {f"d{i}": s for i, s in numbers.items()}
