import hashlib
import random
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from peerlens.llm import components, queries, simhash, substrings

ROOT = "/root/testdata/sf0.001"


def _fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(prints):
    """Smallest id reachable over links of 3 bits, by all pairs."""
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_query_against_all_pairs(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()}
    prints = {i: _fingerprint(t) for i, t in docs.items()}
    classes = _classes(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op2_simhash_trie(spark, ROOT).collect()}
    assert got == {i: (f"{prints[i]:016x}", classes[i]) for i in docs}
    assert len(set(classes.values())) < len(classes)


def _near(seed, n, chains=6):
    rng = random.Random(seed)
    values = {rng.getrandbits(64) for _ in range(n)} | {0, (1 << 64) - 1, 1 << 63}
    for _ in range(chains):
        x = rng.getrandbits(64)
        for _ in range(40):
            values.add(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                x ^= 1 << b
    return sorted(values)


def _linked(values):
    a = np.array(values, np.uint64)
    return {(i, j) for i in range(len(a)) for j in (np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 3) + i + 1).tolist()}


def test_subtrees_find_the_links_of_their_half():
    """All links that differ in one upper bit at most, and nothing that is no link."""
    a = np.array(_near(1, 500), np.uint64)
    every = _linked(a)
    least = {(i, j) for i, j in every if bin(int(a[i] ^ a[j]) >> 32).count("1") <= 1}
    got = [(int(x), int(y)) for u, v in simhash.subtree_links(a, None) for x, y in zip(u, v, strict=True)]
    assert least <= set(got) <= every and len(got) == len(set(got))
    left, right = a[::2], a[1::2]
    both = {tuple(sorted((2 * int(x), 2 * int(y) + 1))) for u, v in simhash.subtree_links(left, right) for x, y in zip(u, v, strict=True)}
    assert {p for p in least if sum(p) % 2} <= both <= every


def test_trie_join_connects_what_links_connect(spark):
    """Small leaves: node pairs are opened again and again, down to single fingerprints in a crowded place."""
    values = sorted({*_near(2, 300), *range(0, 700, 3)})
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    for leaf in (4, 4096):
        groups = {r["node"]: r["root"] for r in components.components(simhash.fingerprint_links(frame, leaf=leaf)).collect()}
        index = {v: i for i, v in enumerate(signed)}
        parts = _components(len(values), _linked(values))
        for v, i in index.items():
            assert groups.get(v, v) == min(signed[j] for j in parts[i])


def _components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in links:
        root[find(i)] = find(j)
    members = {}
    for i in range(n):
        members.setdefault(find(i), []).append(i)
    return [members[find(i)] for i in range(n)]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    edges = spark.createDataFrame(chain + star + [(5000, 5000), (7, 7)] + chain[:5], "a long, b long").repartition(5)
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}
    assert components.components(edges.where("false")).collect() == []


def test_simhash_of_odd_rows(table):
    text = "one two three four five six seven eight nine ten " * 3
    docs = table("doc_id long, text string, fp int, root string", (9, text, 1, "x"), (4, text, 1, "y"), (4, text, 1, "y"), (None, text, 1, "z"), (7, None, 1, "n"), (8, "", 1, "e"), (5, " \n", 1, "w"), (1, "Word", 1, "k"), (2, "wORD", 1, "k"), (3, "é " * 50_000, 1, "long"))
    got = sorted(((r["id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(9, 4), (4, 4), (4, 4), (None, 4), (7, 5), (8, 5), (5, 5), (1, 1), (2, 1), (3, 3)], key=str)
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5]
    assert simhash.without_near_duplicates(docs.where("doc_id is null")).count() == 1
    assert simhash.near_duplicates(docs.where("false")).collect() == [] and simhash.without_near_duplicates(docs.where("false")).collect() == []


def test_each_component_keeps_a_row_where_an_id_has_several_texts(table):
    one = "one two three four five six seven eight nine ten " * 3
    two = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3
    rows = [(5, one, "a"), (5, two, "b"), (9, two, "c"), (5, two, "d")]
    for extra, want in (([], [(5, one), (5, two)]), ([(3, one, "e")], [(3, one), (5, two)]), ([(None, "no id " * 9, "f"), (None, "no number " * 9, "g")], [(5, one), (5, two), (None, "no id " * 9), (None, "no number " * 9)])):
        found = []
        for order in (1, -1):
            docs = table("doc_id long, text string, more string", *(rows + extra)[::order])
            found.append(sorted(map(tuple, simhash.without_near_duplicates(docs).collect()), key=str))
        assert [r[:2] for r in found[0]] == sorted(want, key=str)
        assert found[0] == found[1]


def _removed(docs, window=13):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs.items()}
    owner = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            owner.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - window + 1) if owner[tuple(w[k : k + window])] < i for j in range(window)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_repeats_query_against_brute_force(spark):
    root = "/root/testdata/sf0.01"
    want = _removed({r["doc_id"]: r["text"] for r in spark.read.parquet(f"{root}/documents.parquet").collect()})
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op4_remove_repeats(spark, root).collect()}
    assert got == {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, (n, k, t) in want.items()}
    assert sum(k for _, k, _ in want.values()) > 1000


def test_repeats_hold_when_everything_passes_the_sketch_and_portions_are_small(spark, monkeypatch):
    for name, value in (("MOST_BITS", 12), ("CHUNK_WORDS", 200), ("SETTLE", 300), ("FLUSH", 500), ("SLICE_BITS", 9), ("VOCABULARY", 50)):
        monkeypatch.setattr(substrings, name, value)
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").repartition(7)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(docs).collect()}
    assert got == _removed({r["doc_id"]: r["text"] for r in docs.collect()})


def test_repeats_of_odd_rows(table):
    passage = " ".join(f"w{i}" for i in range(20))
    rows = [(5, f"start {passage} end"), (3, f"{passage}\n{passage}"), (3, "x " * 40), (8, "x " * 40), (8, "x " * 40), (None, passage), (1, None), (2, ""), (4, "short text"), (9, f"é\x0b{passage}\x1cq {passage}")]
    docs = table("doc_id long, text string, n_words string, starts int", *[(*r, "clash", 7) for r in rows])
    out = substrings.remove_repeats(docs)
    assert out.columns == ["doc_id", "text", "starts", "n_words", "n_removed", "kept_text"]
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect())
    want = Counter([(5, 22, 20, "start end"), (3, 40, 0, f"{passage} {passage}"), (3, 40, 0, ("x " * 40).strip()), (None, 20, 20, ""), (1, 0, 0, ""), (2, 0, 0, ""), (4, 2, 0, "short text")])
    want[(8, 40, 40, "")] = 2
    assert all(got[k] == n for k, n in want.items()), got
    assert sum(got.values()) == len(rows)
    assert got[(9, 41, 39, "é w19\x1cq")] == 1
    assert substrings.remove_repeats(docs.where("false")).collect() == []


def test_runs_longer_than_a_span_are_split(monkeypatch, table):
    monkeypatch.setattr(substrings, "LONGEST", 3)
    n = 10
    hashes = np.arange(2 * n, dtype=np.uint64).reshape(n, 2)
    gathered = [(np.full(n, i), np.full(n, 7), np.arange(n), hashes) for i in (1, 2)]
    decided = list(substrings._settled(gathered))[1]
    spans = [(~x >> 24, ~x & 0xFFFFFF) for x in decided["span"].to_pylist()]
    assert spans == [(0, 3), (3, 3), (6, 3), (9, 1)] and decided["id"].to_pylist() == [2] * 4 and decided["h2_mark"].to_pylist() == [7] * 4
    passage = " ".join(f"w{i}" for i in range(60))
    docs = table("doc_id long, text string", (1, passage), (2, f"{passage} end"), (3, f"start {passage}")).repartition(1)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(docs).collect()}
    assert got == {1: (60, 0, passage), 2: (61, 60, "end"), 3: (61, 60, "start")}


def test_a_window_shared_by_all_is_one_row_per_portion(spark):
    """What goes into the shuffle does not grow with the documents that share a window."""
    passage = " ".join(f"p{i}" for i in range(13))
    docs = spark.range(0, 4000, 1, 4).select(F.col("id"), F.xxhash64("id").alias("mark"), F.lit(passage).alias("text"))
    bits = 12
    lost = substrings.covered_windows(docs, substrings.repeated_sketch(docs, bits), bits)
    assert lost.count() == 3999 and lost.where("id = 0").count() == 0
