import os
import subprocess
import sys

import corpus_pipeline
from peerlens.llm import mixing, packing, preference, queries, secrets, simhash

ROOT = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    columns, kept, seen = docs.columns, docs, []
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(at))
        stage(spark, kept, ROOT).write.parquet(out)
        kept = spark.read.parquet(out)
        seen.append(kept)
        if at < 4:
            assert sorted(kept.columns) == sorted(columns), name
    good, near, clean, mixed, packed = seen
    model = preference.train(docs, spark.read.parquet(f"{ROOT}/labels.parquet"))
    want = {r["doc_id"] for r in docs.collect() if model.score(preference.np.array([preference.features(r["text"])]))[0] >= 0.5}
    assert {r["doc_id"] for r in good.collect()} == want and len(want) < docs.count()
    firsts = {r["component_id"] for r in simhash.near_duplicates(good).collect()}
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(firsts)
    texts = {r["doc_id"]: r["text"] for r in near.collect()}
    for r in clean.collect():
        assert r["text"] == secrets.redact(texts[r["doc_id"]], secrets.linked_spans(texts[r["doc_id"]])) and r["n_chars"] == len(r["text"])
    copies = {r["id"]: r["copies"] for r in mixing.mix_sources(clean).collect()}
    counts = {}
    for r in mixed.collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert counts == {i: c for i, c in copies.items() if c}
    words = {r["doc_id"]: len(r["text"].split()) + 1 for r in mixed.collect()}
    assert sum(r["length"] for r in packed.collect()) == sum(words[i] * c for i, c in counts.items())
    assert all(r["capacity"] in packing.CAPACITIES for r in packed.collect())


def test_run_is_the_stages_in_a_row(spark):
    rows = corpus_pipeline.run(spark, ROOT)
    assert rows.count() > 0 and "bin" in rows.columns
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


def test_empty_tables_and_labels_of_one_kind(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"{ROOT}/{name}.parquet") for name in ("documents", "labels"))
    some = spark.createDataFrame(docs.limit(40).collect(), docs.schema)
    cases = {"no_docs": (docs.where("false"), labels), "no_labels": (some, labels.where("false")), "nothing": (docs.where("false"), labels.where("false")), "one_kind": (some, labels.where("quality = 1"))}
    for name, (d, l) in cases.items():
        root = str(tmp_path / name)
        d.write.parquet(f"{root}/documents.parquet")
        l.write.parquet(f"{root}/labels.parquet")
        scored = queries.op10_pairwise_quality(spark, root).collect()
        assert len(scored) == d.count() and all(r["score"] == 0.5 and r["predicted"] == 1 for r in scored), name
        assert corpus_pipeline.quality(spark, d, root).count() == d.count(), name
        if name != "one_kind":
            assert (corpus_pipeline.run(spark, root).count() > 0) == (name == "no_labels"), name


def test_every_query_runs_where_workers_lack_the_package(tmp_path):
    """A process in another folder, without PYTHONPATH; only the driver knows where the package is."""
    code = """
import os, sys
sys.path.insert(0, ROOT_)
import __spark_entry__ as entry
from peerlens.session import local_session
spark = local_session(4)
for name, run in entry.queries().items():
    if name.startswith("op") and name[2].isdigit() or name == "pipeline":
        run(spark, DATA).write.format("noop").mode("overwrite").save()
        print("ran", name)
"""
    code = code.replace("ROOT_", repr(os.path.dirname(os.path.abspath(corpus_pipeline.__file__)))).replace("DATA", repr(ROOT))
    bare = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=bare, capture_output=True, text=True, timeout=900)
    ran = [line.split()[1] for line in done.stdout.splitlines() if line.startswith("ran ")]
    assert len(ran) == 14, done.stderr[-2000:]


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(corpus_pipeline.__file__)
    for folder, _, names in os.walk(f"{root}/peerlens"):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    with open(f"{folder}/{n}") as f:
                        assert "llm" not in f.read()
