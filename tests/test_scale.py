"""Steps that are worked out once, or before anything large is dealt out. Rows against the same step worked out plainly."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from peerlens.functions.ranking import scratch_dir
from peerlens.operators import concepts as K
from peerlens.plans import load_queries, match_queries
from peerlens.plans.bindings import Tables
from peerlens.plans.build import Inputs, Limits, build_records


@pytest.fixture
def tables(spark, tmp_path):
    orders = [(o, o % 4, dt.datetime(2000, 1 + o % 12, 1), "1-HIGH") for o in range(40)] + [(None, 1, None, None)]
    lines = [(o % 41, o % 7, o % 5, o % 3, float(o % 50)) for o in range(160)] + [(None, 1, 1, 1, 9.0), (3, 1, 1, None, 40.0)]
    parts = [(p, f"name {p % 3}", f"Brand#{p}", ["LARGE", "SMALL"][p % 2]) for p in range(5)] + [(4, "name 9", "Brand#4", None)]
    people = [(s, f"Person {s}", s % 2, 5000.0) for s in range(7)]
    for name, schema, rows in [
        ("orders", "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string", orders),
        ("lineitem", "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_quantity double", lines),
        ("part", "p_partkey long, p_name string, p_brand string, p_type string", parts),
        ("supplier", "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", people),
        ("customer", "c_custkey long, c_mktsegment string", [(c, f"M{c}") for c in range(4)]),
        ("nation", "n_nationkey int, n_name string, n_regionkey int", [(0, "A_B", 0), (1, "C", 0)]),
        ("region", "r_regionkey int, r_name string", [(0, "R")]),
    ]:
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return Tables(spark, str(tmp_path))


def rows(df):
    return sorted(map(repr, df.collect()))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keywords_of_some_works(tables):
    wanted = tables.raw("lineitem").where("l_orderkey % 5 = 0").select(F.col("l_orderkey").alias("work_id"))
    got = tables.keywords_of(wanted.unionAll(wanted))
    assert rows(got) == rows(tables.work_keywords.where("work_id % 5 = 0"))
    lines = plan(got).splitlines()
    semi, inner = (next(i for i, x in enumerate(lines) if f"Join {kind}" in x) for kind in ("LeftSemi", "Inner"))
    assert semi > inner  # the lines are thinned out before they meet the parts


def test_authorships_come_out_of_one_exchange(tables):
    df = tables.authorships
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    keys = {x.split("#")[0] for x in text.split("Exchange hashpartitioning(")[1:]}
    assert keys == {"l_orderkey"}  # the lines once; their ends and the join go by it


def test_tags_are_worked_out_once(tables, monkeypatch):
    calls, tags_of = [], match_queries.tags_of
    monkeypatch.setattr(match_queries, "tags_of", lambda t: calls.append(1) or tags_of(t))
    load_queries()["concept_scores_without_tags"].run(tables.spark, tables.root)
    assert len(calls) == 1


def test_alternatives_are_folded_once(table):
    concepts = table("query_id int, concept_pos int, concept string", (1, 0, "blue Ríngs"))
    groups = table("group_id int, term_pos int, term string, narrower boolean", (0, 0, "ring", False), (0, 1, "Gold bands", True))
    df = K.expand_concepts(concepts, groups)
    assert {(r.label, tuple(r.tokens), r.weight) for r in df.collect()} == {("blue Ríngs", ("blue", "ring"), 1.0), ("blue gold band", ("blue", "gold", "band"), 0.7125)}
    assert "ArrowEvalPython [_fold_wide(CASE WHEN RLIKE(label" not in plan(df)


def test_profiles_are_read_once(table):
    profiles = table("profile_id int, interests array<string>, summary string, text string", (1, ["Blue rings"], None, "cold gear"), (2, None, None, None), (3, [None], "rod", None))
    vocabulary = table("tag string, people long", ("blue ring", 1), ("gear", 1), ("cold rod", 1))
    df = K.profile_tags(profiles, vocabulary, total=50)
    assert {(r.profile_id, r.tag, r.weight) for r in df.collect()} == {(1, "blue ring", 1.96), (1, "gear", 0.735)}
    assert "interests" not in plan(df)


def test_topics_of_a_build_are_read_once(tables):
    t = tables
    topics = t.author_topics.withColumn("subfield", F.concat("subfield", F.lit(" marked")))
    inputs = Inputs(t.authors, t.institutions.drop("extra_ids"), topics, t.year_counts, t.works, t.authorships, t.work_funders, t.work_keywords, t.contacts)
    built = build_records(inputs, dt.date(2001, 8, 1), Limits(min_works=1, min_citations=1, min_h_index=1))
    assert built.records.count() == 7
    assert " marked" not in plan(built.records)


def test_nested_inputs_are_written_compressed(tables):
    load_queries()["read_nested_inputs"].run(tables.spark, tables.root)
    base = scratch_dir(tables.spark, "x").rsplit("/", 1)[0].removeprefix("file:")
    files = [f for f in glob.glob(f"{base}/nested-*/*/part-*")]
    assert files and all(f.endswith(".json.gz") for f in files)
