import math
import random
import re
from collections import Counter

import pytest

from peerlens.llm import lexical, queries

ROOT = "/root/testdata/sf0.001"


def _terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def _brute(docs, items, k=20):
    held = [(i, Counter(_terms(t))) for i, t in docs if _terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, counts in held:
            m = 75 + (25 * sum(counts.values()) * n_docs) // n_terms
            score = 0
            for t in _terms(text):
                if counts[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def _found(docs, items, **options):
    return sorted(map(tuple, lexical.rank_documents(docs, items, **options).collect()), key=repr)


def test_query_against_all_documents(spark):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{ROOT}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = queries.op11_mask_groups(spark, ROOT).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=repr) == _brute(docs, items)


@pytest.mark.parametrize("k, portion", [(20, lexical.PORTION), (3, 40)])
def test_odd_rows_ties_and_portions(table, monkeypatch, k, portion):
    rng = random.Random(k)
    vocabulary = ["the", "The", "é", "Über", "a1", "日本", "x", "don't", "ÀB", "ab", "q9"] + [f"w{i}" for i in range(150)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(30)))) for i in range(200)]
    docs += [(None, "é x"), (None, "é x"), (3, docs[3][1]), (900, None), (901, ""), (902, " .,-"), (903, "the " * 5000), (904, "the\x00a1_ab\x7fx")]
    docs += [(1000 - i, "ab ÀB ab") for i in range(50)]
    items = [(1, "the THE ab-é"), (2, None), (3, "nowhere"), (None, "x"), (4, ""), (5, " ".join(vocabulary)), (5, "Über a1"), (6, "the the ab " * 50)]
    monkeypatch.setattr(lexical, "FIRST_GROUPS", 1)
    assert _found(table("doc_id long, text string, n long, terms string", *[(*d, 1, "t") for d in docs]), table("item_id long, text string", *items), k=k, portion=portion) == _brute(docs, items, k)


def test_groups_below_the_best_are_not_scored(monkeypatch):
    import numpy as np
    import pyarrow as pa

    # 1000 documents hold a common term; three hold a rare one as well and stand in the group that is scored first.
    held = [[0, 1] if i < 3 else [0] for i in range(1000)]
    offsets = np.cumsum([0, *map(len, held)])
    flat = np.array([t for h in held for t in h])
    block = lexical.Block(pa.array(range(1000)), np.full(1000, 10), offsets, flat, np.ones(len(flat), np.int64), np.array([10, 9000]), 1000, 10_000)
    seen, plain = [], np.searchsorted
    monkeypatch.setattr(lexical.np, "searchsorted", lambda a, v, *r: (seen.append(np.size(v)), plain(a, v, *r))[1])
    monkeypatch.setattr(lexical, "FIRST_GROUPS", 1)
    top = block.best({0: 1, 1: 1}, 3, [])
    assert [i for _, i in top] == [0, 1, 2] and max(seen) < 10


def test_string_ids_and_empty_tables(table):
    docs, items = [("b", "one two"), ("a", "one two"), (None, "two two")], [("i", "two"), (None, "one")]
    assert _found(table("doc_id string, text string", *docs), table("item_id string, text string", *items)) == _brute(docs, items)
    nothing = table("doc_id long, text string")
    asked = table("item_id long, text string", (1, "x"))
    assert _found(nothing, asked) == _found(nothing, table("item_id long, text string")) == []
    assert _found(table("doc_id long, text string", (1, "x")), table("item_id long, text string", (1, None))) == []
