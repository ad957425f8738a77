import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from peerlens.llm import lines, queries

ROOT = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


def _key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def _brute(rows, min_chars=40, min_docs=5):
    """Kept text, lines and dropped lines of each (id, text), by a dictionary of keys."""
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(_key(line)) >= min_chars:
                holders[_key(line)].add(i)
    last = {k: max(ids, key=lambda i: (i is not None, i)) for k, ids in holders.items() if len(ids) >= min_docs}
    out = []
    for i, text in rows:
        every = (text or "").split("\n")
        kept = [line for line in every if last.get(_key(line), i) == i or _key(line) not in last]
        out.append((i, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def _found(df, **bounds):
    cut = lines.dedup_lines(df, **bounds)
    return sorted(((r[0], r[1], r[2], r[3]) for r in cut.select("doc_id", "n_lines", "n_dropped", lines.kept_text(F.col("text"), F.col("keep"))).collect()), key=repr)


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()]
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in _brute(rows)]
    got = queries.op13_line_bitmaps(spark, ROOT).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_odd_rows_against_brute_force(table):
    common, other = "A line that Many documents hold, word for word", "É line with letters beyond ASCII, ŽLUŤOUČKÝ kůň"
    rows = [(i, f"own {i}\n  {common}\t\n{other if i % 2 else other.lower()}\n{common.upper()}") for i in range(12)]
    rows += [(None, None), (None, common), (None, "x\n" + common), (3, rows[3][1]), (20, ""), (21, "\n"), (22, f"{common}\r\n{common}\r\n\n"), (23, "\n" * 2000 + common + "x" * 100_000)]
    rows += [(24 + i, f"\x1c{common}\x1c") for i in range(5)]  # no blanks of this kind
    got = _found(table("doc_id long, text string", *rows))
    assert got == _brute(rows)
    assert sum(r[2] for r in got) > 20


def test_a_key_of_most_lines_is_dealt_out(spark, table, monkeypatch):
    rng = random.Random(5)
    passages = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(12)) for _ in range(30)]
    rows = [(i, "\n".join([passages[0]] * 3 + rng.sample(passages, rng.randrange(4)))) for i in range(300)]
    df = table("doc_id long, text string", *rows)
    keys = lines._occurrences(lines._marked(df, "doc_id", "text"), 40)
    assert lines.hot_keys(keys)
    dealt = _found(df)
    monkeypatch.setattr(lines, "hot_keys", lambda rows: [])
    assert dealt == _found(df) == _brute(rows)


@pytest.mark.parametrize("schema", ["doc_id long, text string", "doc_id string, text string"])
def test_empty_tables_and_string_ids(table, schema):
    assert _found(table(schema)) == []
    if "doc_id string" in schema:
        rows = [(f"d{i}", "the very same long line in each of them, always\nown") for i in range(6)]
        assert _found(table(schema, *rows)) == _brute(rows)


def test_columns_of_the_input_stay(table):
    df = table("doc_id long, text string, keep string, id long, mark long, k1 long, block int, last long", (1, "a\nb", "x", 7, 8, 9, 1, 2))
    out = lines.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "id", "mark", "k1", "block", "last", "n_lines", "n_dropped", "keep"]
    row = out.first()
    assert (row["id"], row["mark"], row["n_lines"], row["n_dropped"], [tuple(r) for r in row["keep"]]) == (7, 8, 2, 0, [(0, 2)])


def test_bitmaps_are_short_runs(table):
    shared = "a long line that is found in every one of the documents"
    rows = [(i, "\n".join([f"first {i}", "second", shared, shared, "last"])) for i in range(6)]
    runs = {r["doc_id"]: [tuple(k) for k in r["keep"]] for r in lines.dedup_lines(table("doc_id long, text string", *rows)).collect()}
    assert runs == {i: [(0, 2), (4, 1)] for i in range(5)} | {5: [(0, 5)]}
