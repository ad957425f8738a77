import math
import zlib
from collections import Counter

import pyspark.sql.functions as F
import pytest

from peerlens.llm import mixing, queries, sharding

ROOT = "/root/testdata/sf0.01"


def _targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Share by weight, stop at the cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, rest, open_ = {s: 0.0 for s in names}, share * sum(sizes.values()), set(names)
    while open_ and rest > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += rest * weight[s] / total
        rest = sum(max(0.0, target[s] - cap * sizes[s]) for s in open_)
        for s in list(open_):
            if target[s] >= cap * sizes[s]:
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


def _checked(rows, near):
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    want = _targets(dict(sizes))
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(near * t, 2), (s, taken[s], t)


def test_mix_meets_targets_and_repeats(spark):
    rows = queries.op1_mix_sources(spark, ROOT).collect()
    again = queries.op1_mix_sources(spark, ROOT).collect()
    assert len(rows) == spark.read.parquet(f"{ROOT}/documents.parquet").count()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    _checked(rows, 0.01)


def test_rates_are_the_tilts_of_least_entropy(spark):
    """Within one source log(rate) is proportional to the size, up to the cap."""
    rows = [r for r in queries.op1_mix_sources(spark, ROOT).collect() if r["size"] and 0 < r["rate"] < 1.999]
    slopes = {}
    for r in rows:
        slopes.setdefault(r["source"], []).append(math.log(r["rate"]) / r["size"])
    assert len(slopes) >= 5
    for s in slopes.values():
        assert max(s) - min(s) <= 1e-5 * abs(max(s, key=abs)) + 1e-9


def test_mix_with_nulls_repeats_and_empty_texts(spark, table):
    rows = [(i, "w " * (i % 7), f"s{i % 3}", 1) for i in range(60)] + [(None, None, None, 2), (5, "a b", None, 3), (5, "a b", None, 3), (6, "", "empty", 4)]
    docs = table("doc_id long, text string, source string, copies int", *rows)
    mixed = mixing.mix_sources(docs)
    _checked([r.asDict() | {"taken": r["copies"] * r["size"]} for r in mixed.withColumn("_", F.explode(F.sequence(F.lit(1), "rows"))).collect()], 0.1)
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns
    counts = {(r["id"], r["source"], r["size"]): r["copies"] for r in mixed.collect()}
    want = Counter()
    for i, t, s, x in rows:
        want[(i, t, s, x)] += counts[(i, s, len((t or "").split()))]
    assert Counter(tuple(r) for r in whole.collect()) == +want


def test_mix_of_nothing(table):
    docs = table("doc_id long, text string, source string")
    assert mixing.mix_sources(docs).collect() == [] and mixing.mixed_documents(docs).collect() == []
    only_empty = table("doc_id long, text string, source string", (1, "", "a"), (2, None, None))
    mixed = mixing.mix_sources(only_empty).collect()
    assert [(r["rate"], r["copies"], r["size"]) for r in mixed] == [(1.0, 1, 0)] * 2
    assert sorted(map(tuple, mixing.mixed_documents(only_empty).collect()), key=repr) == [(1, "", "a"), (2, None, None)]


def test_empty_texts_beside_others_come_once(table):
    docs = table("doc_id long, text string, source string", (1, "", "a"), (2, None, "a"), *[(i, "word " * (i % 7 + 1), "a" if i % 2 else "b") for i in range(3, 60)])
    assert [r["copies"] for r in mixing.mix_sources(docs).where("size = 0").collect()] == [1, 1]
    assert mixing.mixed_documents(docs).where("doc_id < 3").count() == 2


def _shards_hold(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards_match_the_mixture(spark):
    rows = queries.op3_interleaved_shards(spark, ROOT).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    _shards_hold(rows, 40)
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["grown_shard"], r["law"]) == (len(raw) + 16, zlib.crc32(raw), None, "rows")
    total = Counter(r["source"] for r in rows)
    for shard in range(40):
        inside = Counter(r["source"] for r in rows if r["shard"] == shard)
        for s, n in total.items():
            assert abs(inside[s] - n / 40) < 2
    # brute force of the method
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in queries.op3_interleaved_shards(spark, ROOT).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}


def test_shards_of_odd_tables(spark, table, tmp_path):
    rows = [(i % 5 if i % 4 else None, None if i % 3 else "x", i, 7) for i in range(83)] + [(1, "x", 1, 7)] * 5
    docs = table("doc_id long, source string, slot int, more int", *rows)
    placed = sharding.interleave(docs, 7)
    assert sorted(placed.columns) == sorted(["doc_id", "source", "more", "shard", "slot"])
    _shards_hold(placed.collect(), 7)
    _shards_hold(sharding.interleave(docs.limit(3), 7).collect(), 7)
    assert sharding.interleave(docs.where("false"), 7).collect() == []
    named = table("doc_id long, source string, text string", *[(i, "ab"[i % 2], f"t{i}") for i in range(30)])
    sharding.write_shards(named, sharding.interleave(named.drop("text"), 4), str(tmp_path / "out"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("doc_id", "text").collect()) == [(i, f"t{i}") for i in range(30)]
    for shard in range(4):
        files = sorted((tmp_path / "out" / f"shard={shard}").glob("*.parquet"))
        slots = [r["slot"] for f in files for r in spark.read.parquet(str(f)).collect()]
        assert slots == list(range(len(slots))) and slots


@pytest.mark.parametrize("n", [1, 39, 40, 41, 1001])
def test_borders_of_shards_are_whole_numbers(spark, n):
    _shards_hold(sharding.interleave(spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source")), 40).collect(), 40)
