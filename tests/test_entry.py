import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = "/root/testdata/sf0.001"


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_check_belongs_to_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) > 100


def test_the_contract_loads_without_a_session():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = f"import sys; sys.path.insert(0, {root!r}); import __spark_entry__ as e; assert e.oracle_sql() and e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd="/tmp", timeout=120)


@pytest.mark.parametrize(
    "name", ["author_positions", "domain_weights", "seniority", "facets", "record_chunks", "emails_in_documents", "exact_matches", "update_statistics"]
)
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    rel = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in rel.description]
    want = sorted(repr(tuple(r[columns.index(c)] for c in sorted(columns))) for r in rel.fetchall())
    df = entry.queries()[name](spark, ROOT)
    got = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    assert got == want
