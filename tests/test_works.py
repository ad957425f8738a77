import datetime as dt

import pytest
from pyspark.sql import functions as F

from peerlens.operators import topics as T
from peerlens.operators import works as W

PUB = "person_id string, work_id string, title string, year int, date date, position string, first_author string"


def d(text):
    return dt.date.fromisoformat(text)


def test_positions_and_first_author(table):
    lines = table("work_id int, person_id string, place int", (1, "A", 1), (1, "B", 2), (1, "C", 3), (2, "A", 1))
    got = {(r.work_id, r.person_id): (r.position, r.first_author) for r in W.author_positions(lines).collect()}
    assert got == {(1, "A"): ("first", None), (1, "B"): ("middle", None), (1, "C"): ("last", "A"), (2, "A"): ("first", None)}


def test_newest_five_of_six(table):
    pubs = table(PUB, *[("A", f"W{i}", "t", 2020, d(f"2020-01-0{i}"), None, None) for i in range(1, 7)])
    got = W.recent_works(pubs, d("2021-01-01")).orderBy("recency").collect()
    assert [r.work_id for r in got] == ["W6", "W5", "W4", "W3", "W2"]


def test_recent_works_skip_blank_titles_and_the_future(table):
    pubs = table(PUB, ("A", "W1", " ", 2020, d("2020-01-01"), None, None), ("A", "W2", "t", 2030, d("2030-01-01"), None, None))
    assert W.recent_works(pubs, d("2021-01-01")).count() == 0


def test_merge_keeps_the_stored_row_and_fills_gaps(table):
    old = table(PUB, ("A", "W1", "old title", 2024, d("2024-01-01"), None, None))
    new = table(PUB, ("A", "W2", "n", 2026, d("2026-01-01"), "last", "S"), ("A", "W1", "new title", 2024, d("2024-01-01"), "first", None))
    got = W.merge_publications(old, new).orderBy("recency").collect()
    assert [(r.work_id, r.title, r.position) for r in got] == [("W2", "n", "last"), ("W1", "old title", "first")]


def test_merge_by_title_and_missing_dates_last_in_their_year(table):
    schema = PUB
    old = table(schema, ("A", None, "Same", 2024, None, "first", None))
    new = table(schema, ("A", None, "SAME", 2024, d("2024-05-01"), None, None), ("A", "W9", "x", 2024, d("2024-03-01"), None, None), ("A", "W8", "", 2025, None, None, None))
    got = W.merge_publications(old, new).orderBy("recency").collect()
    assert [(r.title, r.position) for r in got] == [("x", None), ("Same", "first")]


def lab_rows(table):
    return table(
        "person_id string, work_id int, position string, first_author string",
        ("P", 1, "last", "S1"), ("P", 2, "last", "S2"), ("P", 3, "last", "S1"), ("P", 4, "first", None), ("Q", 5, "last", None), ("R", 6, "first", None),
    )


def test_lab_signals(table):
    funders = table("work_id int, pos int, funder string", (1, 0, "NIH"), (2, 0, "NIH"), (2, 1, "ERC"), (3, 0, "NSF"), (3, 1, "ERC"), (3, 2, "DFG"))
    got = {r.person_id: r for r in W.lab_signals(lab_rows(table), W.work_funder_labels(funders, n=2)).collect()}
    assert set(got) == {"P"}
    assert (got["P"].lab_first_authors, got["P"].lab_senior_papers) == (2, 3)
    assert got["P"].recent_funders == ["ERC", "NIH", "NSF"]
    every = W.lab_signals(lab_rows(table), W.work_funder_labels(funders)).first()
    assert every.recent_funders == ["ERC", "NIH", "DFG"]


def test_lab_merge_keeps_the_larger_lab(table):
    schema = "person_id string, lab_first_authors long, lab_senior_papers long, recent_funders array<string>"
    old, new = table(schema, ("P", 4, 5, ["NIH"])), table(schema, ("P", 1, 1, ["NSF"]))
    got = W.merge_lab_signals(old, new).first()
    assert (got.lab_first_authors, got.lab_senior_papers, got.recent_funders) == (4, 5, ["NSF", "NIH"])


def test_output_counts_and_last_year(table):
    years = table("person_id string, year int, works int", *[("A", 2020 + i, n) for i, n in enumerate([1, 2, 2, 5, 3, 4, 9])])
    got = W.output_counts(years, d("2026-06-01")).first()
    assert (got.works_recent_3y, got.works_prior_3y, got.last_publication_year) == (12, 5, 2026)


@pytest.mark.parametrize(
    "recent,prior,trend",
    [(12, 5, "rising"), (2, 10, "declining"), (5, 5, "steady"), (2, 1, "steady"), (None, 5, None), (5, None, None)],
)
def test_trend(table, recent, prior, trend):
    df = table("works_recent_3y int, works_prior_3y int", (recent, prior))
    assert W.with_trend(df).first().output_trend == trend


def test_seniority_of_a_lead_and_a_student(table):
    people = table(
        "person_id string, h_index int, works_count int, citation_count long, last_author_recent int, recent_works int",
        ("lead", 70, 400, 90_000, 4, 5), ("student", 3, 5, 40, 0, 5), ("blank", None, None, None, None, None),
    )
    got = {r.person_id: r.seniority_score for r in W.with_seniority(people).collect()}
    assert got["lead"] - got["student"] > 40
    assert got["blank"] == 0


def test_domain_weights_and_primary(table):
    topics = table(
        "person_id string, topic string, subfield string, field string, n double",
        ("A", "a", "Materials Chemistry", "Materials Science", 40.0), ("A", "b", "Artificial Intelligence", "Computer Science", 30.0),
        ("A", "c", "Materials Chemistry", "Materials Science", 30.0), ("B", "x", None, "Medicine", 5.0),
    )
    got = T.domain_weights(topics).orderBy("domain_rank").collect()
    assert [(r.domain, r.weight) for r in got] == [("Materials Chemistry", 0.7), ("Artificial Intelligence", 0.3)]
    primary = {r.person_id: r.primary_domain for r in T.primary_domain(topics).collect()}
    assert primary == {"A": "Materials Science"}


def test_ties_smallest_subfield_but_largest_field(table):
    topics = table("person_id string, topic string, subfield string, field string, n double", ("A", "a", "X", "F1", 1.0), ("A", "b", "Y", "F2", 1.0))
    assert [r.domain for r in T.domain_weights(topics).orderBy("domain_rank").collect()] == ["X", "Y"]
    assert T.primary_domain(topics).first().primary_domain == "F2"


def test_tags(table):
    topics = table(
        "person_id string, topic string, subfield string, field string, n double",
        *[("A", f"Topic {i}", "s", "f", float(i)) for i in range(8)],
    )
    top = T.topic_tags(topics)
    assert [r.tag for r in top.orderBy("tag_rank").collect()] == [f"Topic {i}" for i in (7, 6, 5, 4, 3, 2)]
    recent = table("person_id string, work_id int, recency int", ("A", 1, 1), ("A", 2, 2))
    words = table(
        "work_id int, keyword string, score double",
        (1, "Peptide", 0.6), (1, "topic 7", 0.9), (2, "peptide", 0.5), (2, "Colitis", 0.7), (2, "Weak", 0.2),
    )
    keywords = T.keyword_tags(recent, T.work_keywords(words), top)
    assert [r.tag for r in keywords.orderBy("tag_rank").collect()] == ["Peptide", "Colitis"]
    tags = T.person_tags(top, keywords).orderBy("pos").collect()
    assert [r.tag for r in tags] == [f"Topic {i}" for i in (7, 6, 5, 4, 3, 2)] + ["Peptide", "Colitis"]


def test_vocabulary(table):
    tags = table("person_id string, pos int, tag string, kind string", ("A", 0, "IBD", "t"), ("A", 1, "Peptide", "k"), ("B", 0, "IBD", "t"))
    vocabulary = T.tag_vocabulary(tags)
    got = vocabulary.orderBy("tag_id").collect()
    assert [(r.tag_id, r.tag, r.people, r.kind) for r in got] == [(0, "IBD", 2, "t"), (1, "Peptide", 1, "k")]
    info = table("topic string, subfield string, keywords array<string>", ("IBD", "Gastroenterology", ["Colitis"]), ("Other", "s", []))
    assert [(r.tag, r.subfield) for r in T.tag_synonyms(vocabulary, info).collect()] == [("IBD", "Gastroenterology")]


def test_domain_names_put_a_missing_primary_first(table):
    df = table("primary_domain string, domain_weights array<struct<name:string,weight:double>>", ("F", [("a", 0.2), ("b", 0.7)]), ("a", [("a", 0.2), ("b", 0.7)]), (None, None))
    assert [r.domains for r in T.with_domain_names(df).collect()] == [["F", "b", "a"], ["b", "a"], []]


def test_facets_with_published_totals(table):
    rows = table("person_id int, institution_name string, country_code string, rank int, domains array<string>", (1, "U1", "US", 1, ["a"]), (2, "U2", "US", 2, ["a", "b"]), (3, "U3", "UK", 3, []))
    published = table("institution_name string, country_code string, rank int, people long", ("U1", "US", 1, 100))
    zero = table("domain string", ("z",))
    got = {(r.kind, r.value): r.people for r in T.facets(rows, zero, published).collect()}
    assert got == {
        ("country", "US"): 101, ("country", "UK"): 1, ("institution", "U1"): 100, ("institution", "U2"): 1, ("institution", "U3"): 1,
        ("domain", "a"): 2, ("domain", "b"): 1, ("domain", "z"): 0,
    }
    narrowed = T.facets(rows, zero, published, "UK").where(F.col("kind") == "institution").collect()
    assert [r.value for r in narrowed] == ["U3"]
