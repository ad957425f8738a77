import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from peerlens.operators import concepts as K
from peerlens.operators import incremental as I
from peerlens.operators import quality as Q
from peerlens.operators.people import estimated_bytes
from peerlens.operators.works import works_at, works_of
from peerlens.plans.build import Inputs, Limits, build_records, publish, publish_vectors
from peerlens.plans.update import Catalog, refresh_build, refresh_from_tables, update_catalog
from peerlens.sources import keyword_index, readers, versions, writers
from peerlens.sources import work_tables as W
from peerlens.sources.keyword_index import read_keyword_index
from peerlens.streaming import recent_works as S

NOW = dt.datetime(2026, 6, 1, 12)
PUB = "person_id string, work_id string, title string, year int, date date, position string, first_author string"


def d(text):
    return dt.date.fromisoformat(text)


def write_json(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


# --- readers ----------------------------------------------------------------------------------------

def test_authors_become_flat_tables(spark, tmp_path):
    path = write_json(
        tmp_path / "a.json",
        [
            {"id": "https://openalex.org/A1", "display_name": "Ada", "works_count": 3, "cited_by_count": 9, "summary_stats": {"h_index": 2},
             "last_known_institutions": [{"id": "https://openalex.org/I1"}],
             "topics": [{"display_name": "T", "count": 4, "subfield": {"display_name": "S"}, "field": {"display_name": "F"}}],
             "counts_by_year": [{"year": 2025, "works_count": 2}]},
            {"id": "A2", "display_name": "Bob"},
        ],
    )
    got = readers.read_authors(spark, path)
    assert {r.person_id: (r.citation_count, r.h_index) for r in got["authors"].collect()} == {"A1": (9, 2), "A2": (None, None)}
    assert tuple(got["author_topics"].first()) == ("A1", "T", "S", "F", 4.0)
    assert tuple(got["year_counts"].first()) == ("A1", 2025, 2)
    assert got["author_institutions"].first().institution_id == "I1"


def test_works_with_and_without_optional_fields(spark, tmp_path):
    path = write_json(
        tmp_path / "w.json",
        [
            {"id": "https://openalex.org/W1", "title": " T ", "publication_year": 2025, "publication_date": "2025-03-01",
             "authorships": [{"author": {"id": "https://openalex.org/A1"}, "author_position": "first"},
                             {"author": {"id": "A2"}, "author_position": "last", "institutions": [{"id": "I1"}], "raw_affiliation_strings": ["x a@b.c"]}],
             "funders": [{"display_name": "NIH"}], "keywords": [{"display_name": "Peptide", "score": 0.5}]},
            {"id": "W2", "display_name": "Named"},
        ],
    )
    got = readers.read_works(spark, path)
    assert {r.work_id: (r.title, r.date) for r in got["works"].collect()} == {"W1": ("T", d("2025-03-01")), "W2": ("Named", None)}
    assert {tuple(r) for r in got["authorships"].collect()} == {("W1", "A1", "first", None), ("W1", "A2", "last", "A1")}
    assert tuple(got["work_institutions"].first()) == ("W1", "I1")
    assert tuple(got["work_affiliations"].first()) == ("W1", "A2", 0, "x a@b.c")
    assert got["work_funders"].first().funder == "NIH" and got["work_keywords"].first().score == 0.5


def test_contact_records(spark, tmp_path):
    def job(org, role, end=None, source="ROR", start="2019"):
        return {"employment-summary": {"role-title": role, "department-name": " ", "start-date": {"year": {"value": start}}, "end-date": end,
                "organization": {"name": org, "disambiguated-organization": {"disambiguated-organization-identifier": "https://ror.org/1", "disambiguation-source": source}}}}

    path = write_json(
        tmp_path / "c.json",
        [{"orcid": "https://orcid.org/0000-1", "person": {"emails": {"email": [{"email": "Ada@U.edu"}]}, "researcher-urls": {"researcher-url": [{"url": {"value": "https://u.edu"}}, {"url": {"value": "ftp://x"}}]}},
          "activities-summary": {"employments": {"affiliation-group": [{"summaries": [job("U", " Prof ")]}, {"summaries": [job("V", "", {"year": {"value": "2020"}}, "GRID", "n/a")]}]}}},
         {"orcid": "0000-2"}],
    )
    got = readers.read_contact_records(spark, path)
    assert [r.email for r in got["contact_emails"].collect()] == ["ada@u.edu"]
    assert [r.url for r in got["contact_urls"].collect()] == ["https://u.edu"]
    assert {tuple(r) for r in got["employments"].collect()} == {
        ("0000-1", "U", "https://ror.org/1", "Prof", None, 2019, True), ("0000-1", "V", None, None, None, None, False),
    }


def test_topic_list(spark, tmp_path):
    path = write_json(tmp_path / "t.json", [{"display_name": " IBD  Research ", "subfield": {"display_name": "G"}, "keywords": ["a  b", " "] + [f"k{i}" for i in range(20)]}, {"display_name": ""}])
    got = readers.read_topics(spark, path).collect()
    assert len(got) == 1 and got[0].topic == "IBD Research" and got[0].keywords == ["a b"] + [f"k{i}" for i in range(20)]
    assert len(readers.read_topics(spark, path, n=12).first().keywords) == 12


def test_affiliation_strings(table):
    rows = table("person_id int, pos int, text string", (1, 0, "no address"), (1, 1, " a@b.c " + "x" * 400), (1, 2, "d@e.f"), (1, 3, "d@e.f"))
    assert [len(r.text) for r in readers.affiliation_strings(rows).orderBy("pos").collect()] == [406, 5]
    got = readers.affiliation_strings(rows, n=10, size=300).orderBy("pos").collect()
    assert [len(r.text) for r in got] == [300, 5]


# --- incremental --------------------------------------------------------------------------------------

def runs(table, *rows):
    return table("last_ingestion date, last_cdc_run date", *rows)


def test_change_window(table):
    assert I.change_window(runs(table, (d("2026-01-31"), None)), d("2026-03-01")) == (d("2026-01-01"), d("2026-03-01"))
    assert I.change_window(runs(table, (d("2026-01-31"), d("2026-02-10"))), d("2026-03-01"), 10)[0] == d("2026-01-31")
    assert I.change_window(runs(table, (d("2026-01-31"), None)), d("2026-03-01"), since=d("2025-01-01"))[0] == d("2025-01-01")


def test_update_without_a_full_build_is_refused(table):
    with pytest.raises(I.NoFullBuild):
        I.change_window(runs(table, (None, None)), d("2026-03-01"))
    with pytest.raises(I.NoFullBuild):
        I.change_window(runs(table), d("2026-03-01"))


def test_one_new_paper(table):
    records = table(
        "person_id string, institution_id string, citation_count long, h_index int, email string, profile_url string, title string, profile_source string, lab_first_authors long, lab_senior_papers long, recent_funders array<string>",
        ("A", "I1", 9000, 40, None, "u", "Prof", "orcid", 4, 5, ["NIH"]), ("B", "I1", 10, 2, "b@u", "u", None, "directory", None, None, None),
    )
    pubs = table(PUB + ", recency int", ("A", "W1", "old", 2025, d("2025-01-01"), "first", None, 1))
    tags = table("person_id string, pos int, tag string, kind string", ("A", 0, "Kept", "t"), ("B", 0, "Kept", "t"))
    works = table(
        "work_id string, title string, year int, date date", ("W1", "renamed", 2025, d("2025-01-01")), ("W2", "new", 2026, d("2026-05-20")),
        ("W3", " ", 2026, d("2026-05-21")), ("W4", "elsewhere", 2026, d("2026-05-22")), ("W5", "too old", 2020, d("2020-01-01")),
    )
    authorships = table("work_id string, person_id string, position string, first_author string", *[(w, "A", "last", "S") for w in ("W1", "W2", "W3", "W4", "W5")])
    homes = table("work_id string, institution_id string", ("W1", "I1"), ("W2", "OLD"), ("W3", "I1"), ("W4", "I9"), ("W5", "I1"))
    institutions = table("institution_id string, extra_ids array<string>", ("I1", ["OLD"]))
    fresh = table("person_id string, citation_count long, h_index int", ("A", 9500, None), ("Z", 1, 1))
    funders = table("work_id string, pos int, funder string", ("W2", 0, "NSF"))
    new_tags = table("person_id string, pos int, tag string, kind string", ("A", 0, "Fresh", "t"))
    after, stats = update_catalog(
        Catalog(records, pubs, tags), (d("2026-05-01"), d("2026-06-01")), institutions, works, authorships, homes, fresh, funders, new_tags,
    )
    assert [(r.work_id, r.title, r.recency) for r in after.publications.orderBy("recency").collect()] == [("W2", "new", 1), ("W1", "old", 2)]
    a, b = after.records.orderBy("person_id").collect()
    assert (a.citation_count, a.h_index, a.lab_first_authors, a.recent_funders) == (9500, 40, 4, ["NSF", "NIH"])
    assert a.flags == ["missing_email", "profile_not_institutional"] and b.flags == ["missing_title"]
    assert {(r.person_id, r.tag) for r in after.tags.collect()} == {("A", "Fresh"), ("B", "Kept")}
    s = stats.first()
    assert (s.works_scanned, s.people_with_new_works, s.publications_added, s.people_refreshed) == (2, 1, 1, 1)


def test_stream_equals_batch_and_survives_a_replay(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.range(300).select(
        F.concat(F.lit("P"), F.when(F.col("id") < 100, 0).otherwise(F.col("id") % 7)).alias("person_id"), (F.col("id") % 250).cast("string").alias("work_id"),
        F.lit("t").alias("title"), F.lit(2024).alias("year"), F.date_add(F.lit(d("2024-01-01")), (F.col("id") % 25).cast("int")).alias("date"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60).alias("ts"),
    )
    rows.repartition(3).write.parquet(source)
    root = str(tmp_path / "out")

    def stream():
        return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)

    S.stream_recent_works(stream(), root, buckets=4).awaitTermination()
    want = {(r.person_id, r.work_id) for r in S.newest_per_person(rows).collect()}

    def result():
        return sorted((r.person_id, r.work_id) for r in S.read_recent_works(spark, root).collect())

    assert result() == sorted(want)
    version = versions.current(spark, root)
    S.stream_recent_works(stream(), root, buckets=4).awaitTermination()  # started again, nothing new
    S.merge_batch(rows.where("person_id = 'P1'"), 0, root, buckets=4)  # a batch that was merged before
    assert versions.current(spark, root).tables == version.tables and result() == sorted(want)
    assert {(r.person_id, r.work_id) for r in S.read_recent_works(spark, root, ["P1", "P3", "nobody"], buckets=4).collect()} == {w for w in want if w[0] in ("P1", "P3")}
    versions.drop_old_versions(spark, root)
    assert result() == sorted(want)
    stored = sum(len(f) for *_, f in os.walk(f"{root}/data"))
    held = spark.read.format("statestore").option("path", f"{root}/checkpoint").option("stateVarName", "works").load()
    counts = [r["count"] for r in held.groupBy("key").count().collect()]
    assert len(counts) == 7 and max(counts) <= 5 and stored < 40


def test_late_works_count_for_thirty_days(spark, tmp_path):
    root, source, schema = str(tmp_path / "out"), str(tmp_path / "in"), "person_id string, work_id string, title string, year int, date date, ts timestamp"

    def work(person, name, day, ts):
        return person, name, "t", day.year, day, dt.datetime.combine(ts, dt.time(12))

    def run(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        S.stream_recent_works(spark.readStream.schema(schema).parquet(source), root, n=2).awaitTermination()
        return {(r.person_id, r.work_id) for r in S.read_recent_works(spark, root).collect()}

    first = {("A", "a1"), ("B", "b1")}
    assert run(work("A", "a1", d("2024-01-01"), d("2024-01-01")), work("B", "b1", d("2024-03-01"), d("2024-03-01"))) == first
    # 20 days behind the newest row: let in; 40 days behind: not.
    assert run(work("A", "a2", d("2024-02-09"), d("2024-02-10")), work("A", "late", d("2024-02-20"), d("2024-01-20"))) == first | {("A", "a2")}
    # The watermark has passed A's state; what was sent stays and meets what comes.
    assert run(work("B", "b2", d("2024-06-01"), d("2024-06-01"))) == first | {("A", "a2"), ("B", "b2")}
    run(work("B", "b2", d("2024-06-01"), d("2024-06-01")))  # a repeated work
    held = spark.read.format("statestore").option("path", f"{root}/checkpoint").option("stateVarName", "works").load()
    assert {r.key.person_id for r in held.collect()} == {"B"}
    assert run(work("A", "a3", d("2024-06-02"), d("2024-06-02"))) == {("A", "a2"), ("A", "a3"), ("B", "b1"), ("B", "b2")}


def test_the_newest_version_of_a_work_counts(table):
    schema = "person_id string, work_id string, title string, year int, date date, ts string"
    old, new = ("A", "W", "first", 2020, d("2020-01-01"), "2024-01-01"), ("A", "W", "second", 2021, d("2021-01-01"), "2024-02-01")
    late = ("A", "V", "late", 2019, d("2019-01-01"), "2010-01-01")
    got = S.newest_per_person(table(schema, old, new, late).withColumn("ts", F.to_timestamp("ts")))
    assert {(r.work_id, r.title) for r in got.collect()} == {("W", "second"), ("V", "late")}


# --- quality ---------------------------------------------------------------------------------------------

SIZES = "institution_id string, institution_name string, people long"


def ok(df):
    r = df.first()
    return r.ok, r.metric


def test_unique_and_empty(table):
    assert ok(Q.check_unique(table("person_id string", ("A",), ("B",)))) == (True, 0)
    assert ok(Q.check_unique(table("person_id string", ("A",), ("A",)))) == (False, 1)
    assert Q.check_unique(table("person_id string")).first().message == "no rows"


def test_shared_ids(table):
    schema = "institution_id string, institution_name string, extra_ids array<string>"
    assert ok(Q.check_shared_ids(table(schema, ("I1", "a", ["I9"]), ("I2", "b", None)))) == (True, 0)
    bad = Q.check_shared_ids(table(schema, ("I1", "a", ["I2"]), ("I2", "b", None))).first()
    assert not bad.ok and bad.message == "a and b share I2"


def test_counts_references_and_small(table):
    records = table("person_id string", ("A",), ("B",))
    sizes = table(SIZES, ("I1", "a", 2))
    assert ok(Q.check_counts(records, sizes)) == (True, 2)
    assert ok(Q.check_counts(records, sizes, stated=3))[0] is False
    assert ok(Q.check_counts(records.limit(0), table(SIZES)))[0] is False
    assert ok(Q.check_refs(table("person_id string", ("A",), ("Z",)), records)) == (False, 1)
    small = Q.warn_small(sizes, 10).first()
    assert (small.ok, small.severity) == (False, "warning")


def test_vectors(spark):
    people = spark.createDataFrame([("A",), ("B",)], "person_id string")
    good = spark.createDataFrame([("A", 0, bytearray(2)), ("B", 1, bytearray(2))], "person_id string, cluster int, bits binary")
    assert ok(Q.check_vectors(good, people, 16)) == (True, 0)
    bad = spark.createDataFrame([("A", 0, bytearray(2)), ("A", 1, bytearray(2)), ("Z", 1, bytearray(1))], "person_id string, cluster int, bits binary")
    assert ok(Q.check_vectors(bad, people, 16)) == (False, 4)  # B absent, Z unknown, A twice, Z short


def test_shrink(table):
    before = table(SIZES, ("I1", "a", 100), ("I2", "b", 49), ("I3", "c", 1000))
    assert ok(Q.check_shrink(before, table(SIZES, ("X1", "a", 80), ("I2", "b", 1), ("I3", "c", 1000)))) == (True, 0)
    lost = Q.check_shrink(before, table(SIZES, ("I1", "a", 79), ("I3", "c", 1000))).first()
    assert not lost.ok and lost.message == "a 100 to 79"
    total = Q.check_shrink(before, table(SIZES, ("I1", "a", 100), ("I3", "c", 700)), allow=True).first()
    assert (total.ok, total.severity, total.metric) == (False, "warning", 2)
    assert "total 1149 to 800" in total.message


def test_size_report_and_status(table):
    records = table("person_id string, bytes long", ("A", 60), ("B", 50))
    report = Q.report(Q.check_unique(records), Q.check_size(records, 100), Q.warn_small(table(SIZES, ("I1", "a", 1)), 10))
    earlier = table("generated_at timestamp, result string", (dt.datetime(2026, 1, 1), "ok"), (dt.datetime(2026, 2, 1), "failed"))
    got = Q.status(report, table(SIZES, ("I1", "a", 2)), "full", NOW, earlier).first()
    assert (got.result, got.errors, got.warnings, got.people, got.previous_success_at) == ("failed", 1, 1, 2, dt.datetime(2026, 1, 1))
    assert ok(Q.check_size(records, None))[0] is True


# --- a whole build ------------------------------------------------------------------------------------------

def small_build(spark, table, n=30):
    """Inputs of `n` people at two institutions, every third at I1."""
    ids = spark.range(n).withColumn("person_id", F.format_string("A%02d", "id"))
    authors = ids.select(
        "person_id", F.concat(F.lit("Person "), "id").alias("name"), F.lit(None).cast("string").alias("orcid"), F.lit(30).alias("works_count"),
        (F.col("id") * 100 + 600).alias("citation_count"), F.lit(20).alias("h_index"), F.when(F.col("id") % 3 == 0, "I1").otherwise("I2").alias("institution_id"),
    )
    works = ids.select(F.concat(F.lit("W"), "id").alias("work_id"), F.concat(F.lit("Peptide study "), "id").alias("title"), F.lit(2025).alias("year"), F.lit(d("2025-05-01")).alias("date"))
    return Inputs(
        authors, table("institution_id string, institution_name string, country_code string, rank int, homepage_url string", ("I1", "One", "US", 1, None), ("I2", "Two", "UK", 2, None)),
        ids.select("person_id", F.lit("Peptides").alias("topic"), F.lit("Biochemistry").alias("subfield"), F.lit("Biology").alias("field"), F.lit(3.0).alias("n")),
        ids.select("person_id", F.lit(2025).alias("year"), F.lit(4).alias("works")),
        works, ids.select(F.concat(F.lit("W"), "id").alias("work_id"), "person_id", F.lit("last").alias("position"), F.lit("S").alias("first_author")),
        works.select("work_id", F.lit(0).alias("pos"), F.lit("NIH").alias("funder")), works.select("work_id", F.lit("Insulin").alias("keyword"), F.lit(0.8).alias("score")),
        ids.select("person_id", F.lit("Professor").alias("title"), F.lit("a@b.edu").alias("email"), F.lit("https://b.edu").alias("profile_url"), F.lit("directory").alias("profile_source")),
    )


def test_build_publish_read_and_search(spark, table, tmp_path):
    inputs = small_build(spark, table)
    limits = Limits(per_institution=8, catalog_rows=5, record_chunk=3)
    root = str(tmp_path / "build")
    publish(build_records(inputs, NOW.date(), limits), inputs.institutions, root, NOW, limits)
    records = readers.read_records(spark, root, ["I1"])
    assert records.count() == 8 and records.agg(F.max("record_chunk")).first()[0] == 2
    top = readers.read_catalog(spark, root)
    assert top.count() == 5 and set(top.select("institution_name").toPandas().institution_name) <= {"One", "Two"}
    assert readers.read_catalog(spark, root, ["I2"]).count() == 8
    row = top.orderBy(F.desc("citation_count")).first()
    assert (row.tags, row.domains, row.has_email) == (["Peptides", "Insulin"], ["Biology", "Biochemistry"], True)
    run = spark.read.parquet(f"{root}/runs").first()
    assert (run.people, run.with_email, run.catalog_complete, run.last_ingestion) == (16, 16, False, NOW.date())
    assert [(r.tag_id, r.tag, r.people) for r in readers.read_stored(spark, root, "tags").orderBy("tag_id").collect()] == [(0, "Insulin", 16), (1, "Peptides", 16)]

    everyone = readers.read_records(spark, root)
    publish_vectors(everyone, root)
    vectors = readers.read_vectors(spark, root)
    assert ok(Q.check_vectors(vectors, everyone, 384)) == (True, 0)
    assert I.change_window(spark.read.parquet(f"{root}/runs"), d("2026-07-01"))[0] == d("2026-05-02")
    assert writers.write_catalog(everyone, root, 100) is True
    assert readers.read_catalog(spark, root, ["I2"]).count() == 8 and readers.read_catalog(spark, root).count() == 16
    before = str(tmp_path / "before")
    writers.snapshot(spark, root, before)
    new = table("work_id string, title string, year int, date date", ("N1", "New insulin study", 2026, d("2026-06-20")))
    who = table("work_id string, person_id string, position string, first_author string", ("N1", "A29", "last", "S2"))
    where = table("work_id string, institution_id string", ("N1", "I2"))
    stats = refresh_build(root, dt.datetime(2026, 7, 1), new, who, where, table("person_id string, citation_count long", ("A29", 99999)), limits=limits)
    assert tuple(stats.first()) == (1, 1, 1, 1)
    moved = str(tmp_path / "moved")
    refresh_build(root, dt.datetime(2026, 7, 2), new, who, where, table("person_id string, citation_count long", ("A29", 5)), limits=limits, target=moved)
    assert spark.read.parquet(f"{moved}/runs").count() == 3 and readers.read_records(spark, moved).where("citation_count = 5").count() == 1
    half = estimated_bytes(readers.read_records(spark, root)).agg(F.sum("bytes")).first()[0] // 2
    small, budget = str(tmp_path / "small"), Limits(per_institution=8, size_budget=half)
    refresh_build(root, dt.datetime(2026, 7, 3), new, who, where, table("person_id string, citation_count long", ("A29", 5)), limits=budget, target=small, since=d("2026-06-21"))
    left = readers.read_records(spark, small).count()
    run = spark.read.parquet(f"{small}/runs").where("window_from = '2026-06-21'").first()
    assert 0 < left < 16 and (run.works_scanned, run.pruned) == (0, 16 - left)
    again = {r.person_id: r for r in readers.read_records(spark, root).collect()}
    assert len(again) == 16
    a = again["A29"]
    assert (a.citation_count, [p.work_id for p in a.recent_publications], a.tags, a.recent_works) == (99999, ["N1", "W29"], ["Peptides", "Insulin"], 2)
    run = spark.read.parquet(f"{root}/runs").where("kind = 'update'").first()  # the moved build has its own history
    assert (run.window_from, run.window_to, run.works_scanned, run.last_cdc_run) == (d("2026-05-02"), d("2026-07-01"), 1, d("2026-07-01"))
    assert ok(Q.check_shrink(readers.read_stored(spark, before, "institutions"), readers.read_stored(spark, root, "institutions"))) == (True, 0)
    # A smaller build leaves no partition of an institution behind.
    everyone = readers.read_records(spark, root)
    writers.write_records(everyone.where("institution_id = 'I1'"), str(tmp_path / "again"))
    writers.write_records(everyone.where("institution_id = 'I2'"), str(tmp_path / "again"))
    assert readers.read_records(spark, str(tmp_path / "again")).select("institution_id").distinct().count() == 1


def files_of(spark, root, name):
    """Data files of a table, by part."""
    tables = versions.current(spark, root).tables[name]
    return {part: sorted(f for f in os.listdir(f"{root}/{folder}") if f.endswith(".parquet")) for part, folder in tables.items()}


def rows_of(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_a_build_that_dies_half_way_leaves_the_old_one(spark, table, tmp_path, monkeypatch):
    inputs, limits, root = small_build(spark, table), Limits(per_institution=8), str(tmp_path / "build")
    publish(build_records(inputs, NOW.date(), limits), inputs.institutions, root, NOW, limits)
    tables = ("records", "catalog", "institutions", "tags", "domains")
    before = {name: rows_of(readers.read_stored(spark, root, name)) for name in tables}

    def dies(*args, **kwargs):
        raise RuntimeError("lost between records and catalog")

    monkeypatch.setattr(writers, "put_catalog", dies)
    more = Limits(per_institution=3)
    with pytest.raises(RuntimeError, match="lost between"):
        publish(build_records(inputs, NOW.date(), more), inputs.institutions, root, NOW, more)
    assert {name: rows_of(readers.read_stored(spark, root, name)) for name in tables} == before
    assert spark.read.parquet(f"{root}/runs").count() == 1
    monkeypatch.undo()
    publish(build_records(inputs, NOW.date(), more), inputs.institutions, root, NOW, more)
    assert readers.read_records(spark, root).count() == 6 and readers.read_catalog(spark, root, ["I1"]).count() == 3
    assert versions.read_table(spark, root, "records", version=1).count() == 16  # the earlier version is there until it is dropped
    kept = len(os.listdir(f"{root}/data/records"))
    assert versions.drop_old_versions(spark, root) > 0 and len(os.listdir(f"{root}/data/records")) == 1 < kept
    assert readers.read_records(spark, root).count() == 6
    with pytest.raises(ValueError, match="no version"):
        versions.current(spark, root, 1)


def test_a_build_of_nobody_reads_back(spark, table, tmp_path):
    inputs, limits, root = small_build(spark, table), Limits(size_budget=1), str(tmp_path / "build")
    publish(build_records(inputs, NOW.date(), limits), inputs.institutions, root, NOW, limits)
    records, catalog = readers.read_records(spark, root), readers.read_catalog(spark, root)
    assert records.count() == catalog.count() == 0 and {"person_id", "seniority_score", "recent_publications"} <= set(records.columns)
    assert readers.read_records(spark, root, ["I1"]).count() == 0
    run = spark.read.parquet(f"{root}/runs").first()
    assert (run.people, run.pruned) == (0, 30)


def test_two_writers_do_not_publish_one_version(spark, table, tmp_path):
    root, rows = str(tmp_path / "build"), table("institution_id string", ("I1",))
    first, second = versions.Draft(spark, root), versions.Draft(spark, root)
    first.put("institutions", rows)
    second.put("institutions", rows.where("false"))
    first.commit()
    with pytest.raises(ValueError, match="published already"):
        second.commit()
    assert readers.read_stored(spark, root, "institutions").count() == 1


@pytest.mark.parametrize("catalog_rows", [None, 5])
def test_an_update_writes_only_the_institutions_it_touches(spark, table, tmp_path, catalog_rows):
    inputs, limits = small_build(spark, table), Limits(catalog_rows=catalog_rows, record_chunk=3)
    roots = [str(tmp_path / name) for name in ("scoped", "whole")]
    for root in roots:
        publish(build_records(inputs, NOW.date(), limits), inputs.institutions, root, NOW, limits)
    new = table("work_id string, title string, year int, date date", ("N1", "New insulin study", 2026, d("2026-06-20")), ("N2", "Another", 2026, d("2026-06-22")))
    who = table("work_id string, person_id string, position string, first_author string", ("N1", "A29", "last", "S2"), ("N2", "A28", "first", None))
    where = table("work_id string, institution_id string", ("N1", "I2"), ("N2", "I2"))
    fresh = table("person_id string, citation_count long", ("A29", 99999))
    tags = table("person_id string, pos int, tag string, kind string", ("A28", 0, "Fresh", "topic"))
    names = ["records", "catalog" if catalog_rows is None else "catalog_by_institution"]
    before = {n: files_of(spark, roots[0], n) for n in names}
    folders = {n: versions.current(spark, roots[0]).tables[n] for n in names}
    stats = refresh_build(roots[0], dt.datetime(2026, 7, 1), new, who, where, fresh, fresh_tags=tags, limits=limits)
    other = str(tmp_path / "target")  # another root is always written whole
    assert rows_of(stats) == rows_of(refresh_build(roots[1], dt.datetime(2026, 7, 1), new, who, where, fresh, fresh_tags=tags, limits=limits, target=other))
    for n in names:
        assert files_of(spark, roots[0], n)["iI1"] == before[n]["iI1"] and versions.current(spark, roots[0]).tables[n]["iI1"] == folders[n]["iI1"]
        assert not set(files_of(spark, roots[0], n)["iI2"]) & set(before[n]["iI2"])
    for n in ("records", "catalog", "tags", "domains", "institutions"):
        assert rows_of(readers.read_stored(spark, roots[0], n)) == rows_of(readers.read_stored(spark, other, n)), n
    assert readers.read_records(spark, roots[0], ["I2"]).where("person_id = 'A29' and citation_count = 99999").count() == 1
    folders = versions.current(spark, roots[0]).tables["records"]
    refresh_build(roots[0], dt.datetime(2026, 7, 2), new.where("false"), who, where, fresh.where("false"), limits=limits)  # touches nobody
    assert versions.current(spark, roots[0]).tables["records"] == folders and readers.read_records(spark, roots[0]).count() == 30


def test_the_stored_keyword_index_follows_the_build(spark, table, tmp_path, monkeypatch):
    inputs, root = small_build(spark, table), str(tmp_path / "build")
    publish(build_records(inputs, NOW.date(), Limits()), inputs.institutions, root, NOW, Limits())

    def same_as_records():
        records = readers.read_records(spark, root)
        whole = K.token_index(records.withColumn("publication_titles", F.col("recent_publications.title")))
        return rows_of(read_keyword_index(spark, root)) == rows_of(whole)

    def search(query, **at):
        return sorted(r.person_id for r in K.keyword_search(readers.read_catalog(spark, root), query, read_keyword_index(spark, root, **at)).where("tier = 0").collect())

    assert same_as_records() and search("zebrafish") == []
    monkeypatch.setattr(keyword_index, "MOST_DELTAS", 2)
    who = table("work_id string, person_id string, position string, first_author string", *[(f"N{i}", "A29", "last", "S2") for i in range(9)])
    where = table("work_id string, institution_id string", *[(f"N{i}", "I2") for i in range(9)])
    fresh = table("person_id string, citation_count long", ("A29", 5)).where("false")
    parts = []
    for i in range(4):  # every update brings a work of a person; the fifth newest falls out at last
        new = table("work_id string, title string, year int, date date", (f"N{i}", f"Zebrafish {'fin' * (i + 1)}", 2026, d(f"2026-06-2{i}")))
        refresh_build(root, dt.datetime(2026, 7, 1 + i), new, who, where, fresh, limits=Limits())
        assert same_as_records() and search("zebra " + "fin" * (i + 1)) == ["A29"]
        parts.append(len(versions.current(spark, root).tables["keyword_index"]))
    assert parts == [2, 3, 1, 2]  # deltas, then one table again
    assert search("zebra", version=1) == [] and search("zebra", version=2) == ["A29"]


def test_a_search_reads_few_row_groups_of_the_index(spark, tmp_path):
    root = str(tmp_path / "build")
    people = spark.range(4000).selectExpr("id AS person_id", "id % 7 AS institution_id", "concat(lpad(conv(id * 7919 % 4000, 10, 26), 3, 'a'), 'son common') AS name", "'x' AS title")
    draft = versions.Draft(spark, root)
    keyword_index.put_keyword_index(draft, people)
    draft.commit()
    draft = versions.Draft(spark, root)
    moved = people.where("institution_id <> 3").unionByName(people.where("institution_id = 3 AND person_id > 2000").withColumn("name", F.lit("zeta")))
    keyword_index.put_keyword_index(draft, moved, [3])
    draft.commit()
    index = read_keyword_index(spark, root)
    assert rows_of(index) == rows_of(K.token_index(moved))
    found = index.where(F.col("token").startswith("zet"))
    assert found.count() == moved.where("name = 'zeta'").count()
    found.collect()
    assert "StringStartsWith(token,zet)" in found._jdf.queryExecution().executedPlan().toString()

    def scanned(df):
        """Rows that the scans of the index hand on."""
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().executedPlan() if hasattr(df._jdf.queryExecution().executedPlan(), "executedPlan") else df._jdf.queryExecution().executedPlan()
        leaves = plan.collectLeaves()
        sizes = []
        for i in range(leaves.size()):
            leaf = leaves.apply(i)
            while "Stage" in leaf.getClass().getSimpleName():
                leaf = leaf.plan().collectLeaves().apply(0)
            if "generation" in leaf.toString() and "token" in leaf.toString():
                sizes.append(leaf.metrics().apply("numOutputRows").value())
        return sum(sizes)

    assert 0 < scanned(found) < scanned(index) / 2


def test_work_tables_open_the_window_without_an_exchange_of_authorships(spark, table, tmp_path):
    root = str(tmp_path / "works")
    days = [None, *[f"2026-0{1 + i % 6}-1{i % 10}" for i in range(60)]]
    works = table("work_id string, title string, year int, date date", *[(f"W{i}", f"Title {i}", 2026, x and d(x)) for i, x in enumerate(days)])
    who = table("work_id string, person_id string, position string, first_author string", *[(f"W{i}", f"A{i * j % 7}", "last", None) for i in range(70) for j in (1, 2)])
    where = table("work_id string, institution_id string", *[(f"W{i}", f"I{i % 3}") for i in range(70)])
    institutions, people = table("institution_id string, extra_ids array<string>", ("I0", ["I1"])), table("person_id string", *[(f"A{i}",) for i in range(5)])
    window = (d("2026-03-05"), d("2026-04-20"))
    W.write_work_tables(works.where("work_id <> 'W2'"), who.where("work_id <> 'W2'"), where.where("work_id <> 'W2'"), root, 4)
    W.add_works(works, who, where, root)
    W.add_works(works, who, where, root)  # again: nothing is there twice

    def pubs(*tables):
        inside = works_at(tables[0].where(F.col("date").between(*window)), tables[2], institutions)
        return works_of(people, inside, tables[1])

    opened = W.open_window(spark, root, window)
    assert rows_of(pubs(*opened)) == rows_of(pubs(works, who, where)) and pubs(*opened).count() > 10
    assert W.open_window(spark, root, (d("2026-03-01"), d("2026-03-31")))[1].count() == 20
    assert {f.split("month=")[1][:7] for f in opened[1].inputFiles()} <= {f"2026-0{m}" for m in range(1, 7)} | {"none/pa"}
    with pytest.raises(ValueError, match="buckets"):
        W.write_work_tables(works, who, where, root, 8)
    for name in (W.WORKS, W.AUTHORSHIPS, W.INSTITUTIONS):  # a session that does not know the tables
        spark.sql(f"DROP TABLE {W._registered(root, name)}")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = pubs(*W.open_window(spark, root, window))
        assert rows_of(found) == rows_of(pubs(works, who, where))
        lines = pubs(*W.open_window(spark, root, window))._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    scans = [i for i, line in enumerate(lines) if "FileScan parquet" in line and f"{W.AUTHORSHIPS}[" in line]
    assert len(scans) == 1 and "month" in lines[scans[0]] and "Bucketed: true" in lines[scans[0]]
    above = scans[0]
    depth = len(lines[above]) - len(lines[above].lstrip(" :+-*()0123456789"))
    while "Join" not in lines[above]:  # up to the join with the works
        above -= 1
        indent = len(lines[above]) - len(lines[above].lstrip(" :+-*()0123456789"))
        if indent < depth:
            depth = indent
            assert "Exchange" not in lines[above]
    assert "work_id" in lines[above]


def test_an_update_out_of_work_tables(spark, table, tmp_path):
    inputs, root, tables = small_build(spark, table), str(tmp_path / "build"), str(tmp_path / "works")
    publish(build_records(inputs, NOW.date(), Limits()), inputs.institutions, root, NOW, Limits())
    works = table("work_id string, title string, year int, date date", ("N1", "New insulin study", 2026, d("2026-06-20")), ("N2", "Long ago", 2020, d("2020-06-20")))
    who = table("work_id string, person_id string, position string, first_author string", ("N1", "A29", "last", "S2"), ("N2", "A28", "last", None))
    W.write_work_tables(works, who, table("work_id string, institution_id string", ("N1", "I2"), ("N2", "I2")), tables, 4)
    stats = refresh_from_tables(root, dt.datetime(2026, 7, 1), tables, table("person_id string, citation_count long", ("A29", 99999)), limits=Limits())
    assert tuple(stats.first()) == (1, 1, 1, 1)
    row = readers.read_records(spark, root).where("person_id = 'A29'").first()
    assert row.citation_count == 99999 and "N1" in [p.work_id for p in row.recent_publications]


def test_pruning_in_a_build_keeps_the_most_cited(spark):
    from peerlens.operators import people as P

    df = spark.range(100).select(F.col("id").alias("person_id"), F.lit(10).alias("seniority_score"), F.col("id").alias("citation_count"), F.lit("x").alias("name"))
    sized = P.estimated_bytes(df)
    budget = sized.agg(F.sum("bytes")).first()[0] // 2
    kept = P.prune_to_budget(sized, budget)
    assert kept.agg(F.sum("bytes")).first()[0] <= budget
    assert kept.agg(F.min("person_id")).first()[0] > 40
