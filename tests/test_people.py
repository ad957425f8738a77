import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from peerlens.functions.ranking import top_per_group, with_row_number, with_running_sum
from peerlens.operators import encoding as E
from peerlens.operators import people as P
from peerlens.sources import writers

PERSON = "person_id string, institution_id string, citation_count long, seniority_score int"


def test_selection(table):
    authors = table(
        "person_id string, works_count int, citation_count long, h_index int",
        ("ok", 30, 900, 12), ("few works", 3, 900, 12), ("few citations", 30, 9, 12), ("inactive", 30, 900, 12), ("no h", 30, 900, None),
    )
    years = table("person_id string, year int, works int", *[(p, 2024, 1) for p in ("ok", "few works", "few citations", "no h")], ("inactive", 2010, 4), ("inactive", 2024, 0))
    assert [r.person_id for r in P.select_people(authors, years, dt.date(2026, 1, 1)).collect()] == ["ok"]


def test_pooled_people_most_cited_once(table):
    people = table(PERSON, ("A", "I1", 5, 0), ("B", "I2", 9, 0), ("A", "I2", 5, 0), ("C", "I1", 7, 0))
    aliases = table("institution_id string, extra_id string", ("I1", "I2"))
    got = P.pool_institutions(people, aliases, 2).orderBy(F.desc("citation_count")).collect()
    assert [(r.person_id, r.institution_id) for r in got] == [("B", "I1"), ("C", "I1")]


@pytest.mark.parametrize("size,expected", [(3000, 3000), (200, 1000), (9999, 3000), (60000, 50000)])
def test_tiers(table, size, expected):
    tiers = [{"per_institution": n, "min_works": n // 100} for n in (1000, 3000, 10000, 50000)]
    got = P.tier_lookup(table("request_id int, size int", (1, size)), tiers).first()
    assert (got.per_institution, got.min_works) == (expected, expected // 100)


def test_flags_and_contact(table):
    df = table(
        "person_id int, email string, profile_url string, profile_source string, title string",
        (1, "a@b.edu", "u", "directory", "Prof"), (2, None, "u", "orcid", None), (3, "", None, None, "x"),
    )
    flagged = P.with_contact_flags(df)
    assert [r.flags for r in flagged.orderBy("person_id").collect()] == [
        [], ["missing_email", "profile_not_institutional", "missing_title"], ["missing_email", "missing_profile_url"],
    ]
    assert [r.person_id for r in P.require_contact(flagged).collect()] == [1]


def people(spark, n=2500):
    return spark.range(n).select(
        F.concat(F.lit("A"), "id").alias("person_id"), F.lit("I1").alias("institution_id"), F.col("id").alias("citation_count"), F.lit(50).alias("seniority_score")
    )


def test_chunks_of_one_large_institution(spark):
    got = {r.person_id: r.record_chunk for r in P.record_chunks(people(spark)).collect()}
    assert len(set(got.values())) == 3
    assert got["A2499"] == 0 and got["A0"] == 2


def test_prune_matches_the_plain_running_sum(spark):
    df = people(spark, 500).withColumn("bytes", F.pmod(F.xxhash64("person_id"), F.lit(50)) + 1)
    total = df.agg(F.sum("bytes")).first()[0]
    budget = total // 3
    w = Window.orderBy(*P.importance()).rowsBetween(Window.unboundedPreceding, 0)
    plain = {r.person_id for r in df.withColumn("r", F.sum("bytes").over(w)).where(F.col("r") <= budget).collect()}
    for parts in (1, 7):
        assert {r.person_id for r in P.prune_to_budget(df.repartition(parts), budget).collect()} == plain
    assert P.prune_to_budget(df, None).count() == 500
    assert P.prune_to_budget(df, total).count() == 500


def test_prune_fifty_people(spark):
    df = people(spark, 50).withColumn("bytes", F.lit(1))
    kept = {r.person_id for r in P.prune_to_budget(df, 20).collect()}
    assert len(kept) <= 21 and "A49" in kept and "A0" not in kept


def test_truncation(spark):
    df = people(spark, 30)
    assert P.truncate_catalog(df, 10).count() == 10
    assert P.catalog_completeness(df, 10).first().catalog_complete is False
    assert P.catalog_completeness(df, 100).first().catalog_complete is True


def test_long_truncation_is_exact(spark):
    df = people(spark, 12_000)
    kept = P.truncate_catalog(df, 11_000)
    assert kept.count() == 11_000
    assert kept.agg(F.min("citation_count")).first()[0] == 1000


def test_scope_stops_at_the_first_overflow(table):
    inst = table("institution_id string, rank int, people int", ("a", 1, 60), ("b", 2, 50), ("c", 3, 1), ("d", None, 1))
    assert [r.institution_id for r in P.pick_scope(inst, 100).collect()] == ["a"]
    assert [r.institution_id for r in P.pick_scope(inst, 10).collect()] == ["a"]
    assert {r.institution_id for r in P.pick_scope(inst, 111).collect()} == {"a", "b", "c"}


def test_row_numbers_and_sums_do_not_depend_on_partitioning(spark):
    # A third of all rows share one key and one order value.
    df = spark.range(3000).select("id", F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 17 + 1).alias("k"), (F.col("id") % 3).alias("o"))
    order = [F.col("o").desc(), F.col("id").asc()]
    plain = {r.id: r.n for r in df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(*order))).collect()}
    for parts in (1, 7):
        got = with_row_number(df.repartition(parts), order, "n", ["k"])
        assert {r.id: r.n for r in got.collect()} == plain
    sums = with_running_sum(df, order, "id", "s").collect()
    w = Window.orderBy(*order)
    assert {(r.id, r.s, r._pos) for r in sums} == {
        (r.id, r.s, r.p) for r in df.withColumn("s", F.sum("id").over(w)).withColumn("p", F.row_number().over(w)).collect()
    }


def test_top_of_a_group_beyond_the_group_limit(spark):
    df = spark.range(5000).select("id", F.lit(1).alias("k"))
    got = top_per_group(df, ["k"], [F.col("id").desc()], 1500)
    assert got.count() == 1500 and got.agg(F.min("id")).first()[0] == 3500


def test_dedupe_keeps_the_better_rank(table):
    df = table("person_id string, institution_id string, rank int", ("A", "I2", 9), ("A", "I1", 3), ("B", "I3", None))
    assert {(r.person_id, r["rank"]) for r in P.dedupe_people(df).collect()} == {("A", 3), ("B", None)}


def test_orders(table):
    df = table("person_id string, name string, rank int, seniority_score int, citation_count long", ("a", "Zoe", 2, None, 900), ("b", "Ann", 1, 40, 10), ("c", "Bea", None, 90, 5), ("d", "Cy", 1, 40, 20))
    ids = lambda mode: [r.person_id for r in P.order_catalog(df, mode).collect()]
    assert ids("pi") == ["c", "d", "b", "a"]
    assert ids("citations") == ["a", "d", "b", "c"]
    assert ids("rank") == ["d", "b", "a", "c"]
    assert ids("name") == ["b", "c", "d", "a"]
    blended = df.withColumn("concepts_matched", F.lit(1)).withColumn("concept_score", F.lit(0.2)).withColumn("match_score", F.when(F.col("person_id") == "b", 0.9).otherwise(0.1))
    assert P.order_catalog(blended, "relevance").first().person_id == "b"


def test_expand_keeps_row_values_for_nulls(table):
    rows = table("person_id string, name string, email string", ("A", "n", "row@x.y"), ("B", "m", None))
    full = table("person_id string, email string, h_index int", ("A", None, 4))
    got = {r.person_id: (r.name, r.email, r.h_index) for r in P.expand_records(rows, full).collect()}
    assert got == {"A": ("n", "row@x.y", 4), "B": ("m", None, None)}


def test_appended_and_missing(table):
    catalog = table("person_id string, name string", ("A", "old"))
    rows = table("person_id string, name string, rank int", ("A", "new", 1), ("B", "b", 2))
    assert {(r.person_id, r.name) for r in P.append_rows(catalog.withColumn("rank", F.lit(0)), rows).collect()} == {("A", "old"), ("B", "b")}
    matches = table("person_id string, institution_id string", ("A", "I1"), ("Z", "I2"), ("Y", "I2"), ("X", None))
    assert [r.institution_id for r in P.missing_matches(matches, catalog).collect()] == ["I2"]


def test_dictionary_round_trip(table):
    df = table(
        "person_id string, institution_id string, domains array<string>, profile_url string",
        ("A", "I2", ["b", "a"], "https://orcid.org/0000"), ("B", "I1", [], "https://uni.edu/p"), ("C", None, None, None),
    )
    coded, tables = E.dictionary_encode(df.withColumn("profile_url", E.encode_url(F.col("profile_url"))), ["institution_id", "domains"])
    assert {r.person_id: (r.institution_id, r.domains, r.profile_url) for r in coded.collect()} == {
        "A": (1, [1, 0], "0|0000"), "B": (0, [], "https://uni.edu/p"), "C": (None, None, None),
    }
    back = E.dictionary_decode(coded, tables).withColumn("profile_url", E.decode_url(F.col("profile_url")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_partials_need_every_part(table):
    parts = table("partial_id string, person_id string", ("p1", "A"), ("p2", "B"), *[(f"other{i}", "Z") for i in range(9)])
    assert writers.assemble_partials(parts, ["p1", "p2"]).count() == 2
    with pytest.raises(ValueError, match="p3"):
        writers.assemble_partials(parts, ["p1", "p2", "p3"])


def test_csv_defuses_formulas(table):
    df = table(
        "name string, title string, institution_name string, country_code string, rank int, email string, profile_url string, status string, note string, saved_at string",
        ("=1+1", 'A "quoted", title', None, "US", 3, "@x", "-u", "To contact", "\tx", "2026-01-02T03:04:05Z"),
    )
    got = writers.csv_rows(df).first()
    assert got["Name"] == "'=1+1" and got["Email"] == "'@x" and got["Profile link"] == "'-u" and got["Notes"] == "'\tx"
    assert got["University"] == "" and got["Saved"] == "2026-01-02" and got["University rank"] == "3"


def test_repeated_rows_are_chosen_in_whatever_order(table):
    from peerlens.operators import people as P

    schema = "person_id string, institution_id string, name string"
    rows = [("A", "I1", "a"), ("A", "I1", "b"), ("A", "I1", None), ("B", "I2", "c")]
    catalog = table(schema, ("B", "I2", "listed"))
    some, other = (P.append_rows(catalog, table(schema, *r).coalesce(1)).collect() for r in (rows, rows[::-1]))
    assert sorted(map(repr, some)) == sorted(map(repr, other)) and len(some) == 2
    assert P.one_row(table(schema, *rows), "person_id", "institution_id").count() == 2
