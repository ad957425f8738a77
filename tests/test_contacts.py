import html
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from peerlens.functions.text import unescape_entities
from peerlens.operators import contacts as C
from peerlens.operators import pages as G
from peerlens.operators import profiles as R


def emails(table, text):
    return [r.email for r in C.extract_emails(table("id int, text string", (1, text)), "text", ["id"]).orderBy("pos").collect()]


@pytest.mark.parametrize(
    "text,found",
    [
        ("jane.doe [at] mit [dot] edu", ["jane.doe@mit.edu"]),
        ("jane.doe(at)mit.edu", ["jane.doe@mit.edu"]),
        ("Write to jane at cs dot mit dot edu today", ["jane@cs.mit.edu"]),
        ("jane {AT} mit dot edu", ["jane@mit.edu"]),
        ("jane&#64;mit&#46;edu", ["jane@mit.edu"]),
        ("jane <at> ox.ac.uk", ["jane@ox.ac.uk"]),
        ("jane@ mit.edu", ["jane@mit.edu"]),
        ("JANE@MIT.EDU, jane@mit.edu; bob@x.org", ["jane@mit.edu", "bob@x.org"]),
        ("She is a professor at MIT and works at home.", []),
        ("info@mit.edu webmaster@x.org name@x.org logo@2x.png", []),
        ("no address here", []),
        ("ünjane@mit.edu", []),
        ("j@a.b dot c dot d dot e dot f dot edu", ["j@a.b.c.d.e.f.edu"]),
    ],
)
def test_addresses(table, text, found):
    assert emails(table, text) == found


@pytest.mark.parametrize(
    "value,domain",
    [
        ("www.cs.ox.ac.uk", "ox.ac.uk"), ("eecs.mit.edu", "mit.edu"), ("mit.edu:8080", "mit.edu"), ("x@a.b.com.au", "b.com.au"),
        ("https://www.uni.edu/a?b", "uni.edu"), ("", ""), ("localhost", "localhost"),
    ],
)
def test_registered_domain(table, value, domain):
    assert C.with_registered_domain(table("h string", (value,)), "h").first().registered_domain == domain


@pytest.mark.parametrize(
    "name,key", [("Prof. Dr. José García-López", "j|lopez"), ("Ada Lovelace, PhD", "a|lovelace"), ("Dr.", None), (None, None), ("Łukasz X", "u|x")]
)
def test_name_key(table, name, key):
    assert C.with_name_key(table("n string", (name,)), "n").first().name_key == key


@pytest.mark.parametrize(
    "email,name,fits",
    [
        ("alovelace@x.edu", "Ada Lovelace", True), ("ada@x.edu", "Ada Lovelace", True), ("al@x.edu", "Ada Lovelace", True),
        ("bob@x.edu", "Ada Lovelace", False), ("xu@x.edu", "Bo Xu", False), ("bx@x.edu", "Bo Xu", True), ("a@x.edu", "", False),
    ],
)
def test_address_fits_name(table, email, name, fits):
    people = table("person_id int, name string", (1, name))
    assert (C.vet_emails(table("person_id int, email string", (1, email)), people).count() == 1) is fits


@pytest.mark.parametrize(
    "text,title",
    [
        ("Jane is Associate Professor of Materials Science and Engineering\nRoom 5", "Associate Professor of Materials Science and Engineering"),
        ("Lecturer, then Professor; Emeritus Professor of Law.", "Emeritus Professor of Law"),
        ("Reader. Senior Lecturer.", "Reader"),
        ("Associate Professor\u00a0of\u00a0Law.", "Associate Professor of Law"),
        ("nothing", None),
        (None, None),
    ],
)
def test_title(table, text, title):
    assert C.extract_titles(table("t string", (text,)), "t").first().title == title


@pytest.mark.parametrize(
    "title,role",
    [
        ("PhD Student", "student"), ("Postdoctoral Fellow", "postdoc"), ("Professor Emeritus", "emeritus"), ("Associate Professor", "faculty"),
        ("Department Chair", "faculty"), ("Research Scientist", "researcher"), ("Baker", None), (None, None),
    ],
)
def test_role(table, title, role):
    assert C.with_role(table("title string", (title,))).first().role == role


def test_organisations(table):
    orgs = table(
        "org_id int, org string, ror string",
        (1, "University of Oxford", None), (2, "Oxford Brookes University", "https://ror.org/2"), (3, "Universität Zürich", None),
        (4, "Massachusetts Institute of Technology", None), (5, "Cambridge", "https://ror.org/9"), (6, "The University", None),
    )
    inst = table(
        "institution_id string, institution_name string, ror string",
        ("ox", "University of Oxford", "https://ror.org/1/"), ("zh", "University of Zurich", None), ("mit", "Massachusetts Institute of Technology (MIT)", None), ("cam", "x", "9"),
    )
    assert {tuple(r) for r in C.match_orgs(orgs, inst).collect()} == {(1, "ox"), (3, "zh"), (4, "mit"), (5, "cam")}


def test_entity_resolution_prefers_education(table):
    c = table(
        "query_id int, query string, position int, candidate_id string, candidate string, type string",
        (1, "Testing University", 0, "hospital", "Testing University Hospital", "healthcare"), (1, "Testing University", 1, "uni", "Testing University", "education"),
        (2, "A B", 0, "first", "A B", "other"), (2, "A B", 0, "same", "zzz", "other"),
    )
    assert {r.query_id: r.candidate_id for r in C.resolve_entities(c).collect()} == {1: "uni", 2: "first"}


def test_candidates_equal_all_pairs(table):
    rng = random.Random(5)
    words = ["university", "institute", "of", "technology", "north", "east", "harbour", "lake", "stone", "field", "zürich"]
    name = lambda: " ".join(rng.choices(words, [9, 5, 5, 4, 2, 2, 1, 1, 1, 1, 1], k=rng.randint(0, 6)))
    asked = [(i, name()) for i in range(60)] + [(60, None), (61, ""), (62, "42"), (63, asked_twice := "Lake Stone University"), (64, asked_twice.upper())]
    known = [(f"c{i}", name(), rng.choice(["education", "company", None])) for i in range(80)] + [("none", None, "education"), ("c0", "lake stone university", "company")]
    queries = table("query_id int, query string", *asked)
    institutions = table("institution_id string, institution_name string, type string, query string", *[(*k, "clashes") for k in known])

    def bag(text):
        return set((text or "").lower().replace("ü", "u").split()) - {"42"}

    for share in (0.3, 0.5, 0.7, 1.0):
        got = sorted((r.query_id, r.candidate_id, r.candidate) for r in C.name_candidates(queries, institutions, share).collect())
        near = {(q, c, n): len(bag(a) & bag(n)) / len(bag(a) | bag(n)) for q, a in asked for c, n, _ in known if bag(a) and bag(n)}
        assert got == sorted(k for k, v in near.items() if v >= share - 1e-9)
    best = {r.query_id: r.candidate_id for r in C.resolve_names(queries, institutions).collect()}
    assert len(best) == 65 and best[60] is best[61] is best[62] is None and best[63] == best[64] is not None
    placed = C.name_candidates(queries.where("query_id = 63"), institutions).orderBy("position").collect()
    assert [r.position for r in placed] == list(range(len(placed))) and bag(placed[0].candidate) == bag(asked_twice)
    assert C.name_candidates(queries.where("false"), institutions).count() == C.name_candidates(queries, institutions.where("false")).count() == 0


JOB = "person_id string, org string, ror string, role string, department string, start int, current boolean"


def test_employment_titles(table):
    jobs = table(
        JOB,
        ("A", "University of Testing", None, "assistant", "Lab", 2020, True), ("A", "University of Testing", None, "prof.", "Psychiatry", 2021, True),
        ("A", "University of Testing", None, "professor", "Old", 2009, False), ("B", "Elsewhere College", None, "Reader", None, 2001, True),
        ("C", "University of Testing", None, "Professor of Law", "law", None, True), ("D", "Gone", None, "x", None, None, False),
    )
    people = table("person_id string, institution_id string", *[(p, "I1") for p in "ABCD"])
    inst = table("institution_id string, names array<string>, rors array<string>", ("I1", ["Testing University"], [None]))
    got = {r.person_id: (r.title, r.affiliation) for r in C.employment_titles(jobs, people, inst).collect()}
    assert got == {"A": ("Professor, Psychiatry", "match"), "B": (None, "elsewhere"), "C": ("Professor of Law", "match")}


def test_registry_id_decides(table):
    jobs = table(JOB, ("A", "University of Testing", "https://ror.org/xx", "Reader", None, 1, True), ("B", "Other name", "https://ror.org/yy", "Reader", None, 1, True))
    people = table("person_id string, institution_id string", ("A", "I1"), ("B", "I1"))
    inst = table("institution_id string, names array<string>, rors array<string>", ("I1", ["University of Testing"], ["yy"]))
    assert {r.person_id: r.affiliation for r in C.employment_titles(jobs, people, inst).collect()} == {"A": "elsewhere", "B": "match"}


def test_contact_sources(table):
    people = table("person_id string, name string, institution_id string", ("A", "Ada Lovelace", "I1"), ("B", "Bob Stone", "I2"))
    domains = table("institution_id string, domain string", ("I1", "uni.ac.uk"))
    c = table(
        "person_id string, field string, value string, source string, pos int",
        ("A", "email", "ada@gmail.com", "profile_page", 0), ("A", "email", "ada@cs.uni.ac.uk", "europepmc", 0), ("A", "email", "lovelace@uni.ac.uk", "paper_affiliation", 0),
        ("A", "profile_url", "https://blog.com", "orcid_researcher_url", 0), ("A", "profile_url", "https://www.uni.ac.uk/ada", "orcid_researcher_url", 1),
        ("A", "profile_url", "https://orcid.org/1", "orcid", 0), ("A", "title", "Reader", "orcid_employment", 0), ("A", "title", "Professor", "profile_page", 0),
        ("B", "email", "stone@x.org", "paper_affiliation", 0), ("B", "email", "b@x.org", "orcid", 0), ("B", "profile_url", "https://openalex.org/B", "openalex", 0),
    )
    got = {r.person_id: r for r in C.resolve_contacts(people, c, domains).collect()}
    a, b = got["A"], got["B"]
    assert (a.email, a.email_source, a.profile_url, a.profile_source, a.title, a.title_source) == (
        "lovelace@uni.ac.uk", "paper_affiliation", "https://www.uni.ac.uk/ada", "orcid_researcher_url", "Professor", "profile_page",
    )
    assert (b.email, b.profile_source) == (None, "openalex")


def test_contact_link(table):
    df = table("name string, homepage_url string, institution_name string", ("Ada Lovelace", "https://www.uni.ac.uk/x", "U"), ("Ada Lovelace", None, "My Uni"))
    assert [r.contact_link for r in C.with_contact_link(df).collect()] == [
        "https://www.google.com/search?q=%22Ada%20Lovelace%22%20site%3Auni.ac.uk", "https://www.google.com/search?q=%22Ada%20Lovelace%22%20My%20Uni",
    ]


def test_page_text_and_links(table):
    html = """<html><head><title>T</title><style>x{}</style></head><body><p>Hi<script>var a = '<b>no</b>'</script> there</p>
    <a href="/p">Rel</a><a href="http://[bad">Bad</a><a href="https://e.org/q">Abs <b>x</b></a><a href="mailto:a@b.org?subject=s">m</a><a href="#top">t</a></body></html>"""
    got = G.extract_pages(table("page_id int, url string, html string", (1, "https://u.edu/dir/", html))).first()
    assert got.text == "T\nHi\nthere\nRel\nBad\nAbs\nx\nm\nt"
    assert got.mailtos == ["a@b.org"]
    assert [(a.url, a.text) for a in got.links] == [("https://u.edu/p", "Rel"), ("https://e.org/q", "Abs x")]


DIRECTORY = """<div id="all"><div class="person"><h3>Jane Doe</h3><p>Associate Professor of Chemistry</p><a href="mailto:jane.doe@u.edu">mail</a>
<a href="/people/jane">Jane Doe</a></div><div class="person"><div><strong>Bob Stone</strong> bob [at] u [dot] edu <a href="/x">site</a></div></div></div>"""


@pytest.mark.parametrize("selector", [None, "div.person", "#all .person"])
def test_directory_cards(table, selector):
    pages = table("page_id int, url string, html string", (1, "https://www.u.edu/faculty", DIRECTORY))
    got = {r.name: (r.email, r.profile_url, r.title) for r in G.directory_entries(pages, selector).collect()}
    assert got == {
        "Jane Doe": ("jane.doe@u.edu", "https://www.u.edu/people/jane", "Associate Professor of Chemistry"),
        "Bob Stone": ("bob@u.edu", "https://www.u.edu/x", None),
    }


def test_profile_page(table):
    html = "<body><h1>Ada Lovelace</h1><p>Professor of Computing</p>office@u.edu other@u.edu lovelace@gmail.com a.lovelace@u.edu</body>"
    pages = table("page_id int, url string, html string", (1, "https://u.edu/ada", html), (2, "https://v.edu/ada", html))
    people = table("person_id string, name string, institution_id string, page_id int", ("A", "Ada Lovelace", "I1", 1), ("B", "Ada Lovelace", "I2", 2))
    inst = table("institution_id string, homepage_url string", ("I1", "https://www.u.edu"), ("I2", None))
    got = {r.person_id: (r.email, r.title) for r in G.page_contacts(pages, people, inst).collect()}
    assert got == {"A": ("a.lovelace@u.edu", "Professor of Computing"), "B": ("lovelace@gmail.com", "Professor of Computing")}


# --- profiles --------------------------------------------------------------------------------------

def profile(table, text, **limits):
    return R.document_profiles(table("doc_id int, text string", (1, text)), **limits).first()



def test_listed_interests(table):
    got = profile(table, "Jane Doe\njane@x.org\nResearch Interests:\n• graph neural networks\n• battery materials, catalysis\n+1 617 555 0100\nEducation\nPhD, MIT")
    assert got.interests == ["graph neural networks", "battery materials", "catalysis"]
    assert got.text == "graph neural networks battery materials, catalysis"


def test_prose_when_there_is_no_section(table):
    got = profile(table, "Jane Doe\nEducation\n- I study the chemistry of solid batteries\nhttps://x.org is my web page here\nshort line")
    assert got.interests == []
    assert got.text == "I study the chemistry of solid batteries"


def test_summary_section_gives_text_only(table):
    got = profile(table, "Summary\nI build large models for climate science and energy systems.\nSkills\npython and other things that matter")
    assert got.interests == [] and got.text == "I build large models for climate science and energy systems."


def test_long_text_is_whole_unless_cut(table):
    lines = ["many words make up this long line of text number %d" % i for i in range(100)]
    assert profile(table, "\n".join(lines)).text == " ".join(lines)
    got = profile(table, "\n".join(lines), chars=1000)
    assert len(got.text) <= 1000 and got.text.startswith("many words")
    assert profile(table, "\n".join(lines[:2]), line_chars=10).text == "many words many words"


def test_long_section(table):
    lines = [f"point {i} about graphs" for i in range(40)]
    text = "\n".join(["Research interests", *lines])
    assert profile(table, text).interests == lines
    assert profile(table, text, section_lines=12).interests == lines[:12]


def test_very_many_topics(table):
    from peerlens.functions.text import dedupe_interests

    names = [f"Topic {i}" for i in range(50_000)]
    df = table("t array<string>", (["b", "A", " a", "B", *names, "x" * 200, *names],))
    out = df.select(dedupe_interests(F.col("t")).alias("all"), dedupe_interests(F.col("t"), most=3, size=80).alias("few")).first()
    assert out["all"] == ["b", "A", *names, "x" * 200]
    assert out["few"] == ["b", "A", "Topic 0"]


def test_free_text_topics(table):
    df = table("id int, text string", (1, "I am interested in graph neural networks, battery materials and LLMs; Graph Neural Networks\n1) 'solid state' - a line with far too many words to be one topic"))
    assert [r.topic for r in R.text_topics(df, "text", "id").orderBy("pos").collect()] == ["graph neural networks", "battery materials", "LLMs", "solid state"]


def test_replies(table):
    df = table(
        "id int, text string",
        (1, 'Here: ```json\n{"interests": ["A", "a", "B {x}"], "summary": " s ", "reply": "ok } \\" {"}\n``` {"interests": ["no"]}'),
        (2, '{"interests": "x, y", "summary": 3}'), (3, "solar cells and wind"), (4, '{"interests": ["broken"'), (5, None),
    )
    got = {r.id: (r.interests, r.summary, r.reply) for r in R.parse_replies(df, "text", ["id"]).collect()}
    assert got[1] == (["A", "B {x}"], "s", 'ok } " {')
    assert got[2] == (["x", "y"], "", "")
    assert got[3] == (["solar cells", "wind"], "", "")
    assert got[4][0] == ["{interests: [broken"]


def test_publication_profile(table):
    topics = table("person_id string, topic string, n double", *[("A", f"T{i}", float(i)) for i in range(10)])
    pubs = table("person_id string, work_id int, title string, date string", *[("A", i, f"Title {i} " + "x" * 90, f"2020-01-{i + 10}") for i in range(20)], ("B", 1, "Only", "2020-01-01"))
    got = {r.person_id: r for r in R.publication_profiles(topics, pubs).collect()}
    assert got["A"].interests == [f"T{i}" for i in range(9, 1, -1)]
    assert got["A"].text.startswith("Research areas: T9, T8") and all(f"Title {i} " in got["A"].text for i in range(20))
    assert (got["B"].interests, got["B"].text) == ([], "Only")
    got = {r.person_id: r.text for r in R.publication_profiles(topics, pubs, chars=1000).collect()}
    assert got["A"].startswith("Research areas: T9, T8") and len(got["A"]) <= 1000 and "Title 19" in got["A"]
    assert got["B"] == "Only"


@pytest.mark.parametrize(
    "ref,kind,id_",
    [
        ("https://orcid.org/0000-0002-1825-009x", "orcid", "0000-0002-1825-009X"), ("openalex.org/A5023888391", "openalex", "A5023888391"),
        (" a5023888391 ", "openalex", "A5023888391"), ("hello", None, None), ("", None, None),
    ],
)
def test_references(table, ref, kind, id_):
    got = R.parse_refs(table("ref string", (ref,)), "ref").first()
    assert (got.ref_kind, got.ref_id) == (kind, id_)


def test_merged_profiles(table):
    sources = table(
        "profile_id int, pos int, interests array<string>, summary string, text string",
        (1, 0, ["A", "- b"], "first", "t1"), (1, 1, ["B", "c"], None, "t1"), (1, 2, [], "last", "t2"),
    )
    got = R.merge_profiles(sources).first()
    assert (got.interests, got.summary, got.text) == (["A", "b", "c"], "last", "t1 t2")


def test_texts(table):
    person = table("title string, domains array<string>, recent_publications array<struct<title:string>>", ("Reader", ["x", "y"], [("p",), ("",), ("q",)]), (None, [], []))
    assert [r.embedding_text for r in R.with_person_text(person).collect()] == ["Reader. Research areas: x, y. Recent work: p; q.", ""]
    prof = table("interests array<string>, summary string, text string", (["a"], "s", "t" * 2000), ([], None, "u"))
    assert [r.embedding_text for r in R.with_profile_text(prof).collect()] == ["Research areas: a. s " + "t" * 2000, "u"]
    got = [r.embedding_text for r in R.with_profile_text(prof, limit=1200).collect()]
    assert got[0].startswith("Research areas: a. s ttt") and len(got[0]) == 1201 and got[1] == "u"


def test_identities(table):
    people = table("ref_id int, name string, institution_pattern string", (1, "Henri B. Kagan", "Paris"), (2, "Nobody Known", "Paris"), (3, "Émile Zola", "universite"))
    authors = table(
        "person_id string, name string, institutions string, works_count int",
        ("A1", "H. Kagan", "Université Paris-Saclay", 10), ("A2", "Henri Kagan", "University of Paris", 300), ("A3", "Henri Kagan", "Lyon", 900), ("A4", "E. Zola", "Université X", 2),
    )
    got = {r.ref_id: (r.person_id, r.candidates, r.resolved_by) for r in R.resolve_people(people, authors).collect()}
    assert got == {1: ("A2", 2, "search"), 2: (None, 0, None), 3: ("A4", 1, "search")}
    pins = table("ref_id int, name string, pinned_id string", (1, "Henri Kagan", "A2"), (2, "Ada Lovelace", "A2"), (3, "X Y", "A99"))
    checked = {r.ref_id: (r.person_id, r.note is None) for r in R.verify_pins(pins, authors).collect()}
    assert checked == {1: ("A2", True), 2: (None, False), 3: (None, False)}


def test_identities_of_a_common_name(table):
    places = ["Paris", "Lyon", "Univ. of Paris", None]
    authors = table(
        "person_id string, name string, institutions string, works_count int",
        *[(f"A{i:03}", ["Wei Wang", "W. Wang", "Wen Wang"][i % 3], places[i % 4], None if i % 7 == 0 else i * 37 % 50) for i in range(200)], ("B", None, "Paris", 999),
    )
    rows = [r for r in authors.collect() if r.name and r.institutions]
    asked = [(i, "W. Wang", p) for i, p in enumerate(["paris", "paris", "^lyon$", "rome", None, "paris|lyon"])] + [(9, None, "paris")]
    got = {r.ref_id: (r.person_id, r.candidates) for r in R.resolve_people(table("ref_id int, name string, institution_pattern string", *asked), authors).collect()}
    for i, name, pattern in asked:
        fit = [r for r in rows if name and pattern and re.search(pattern, r.institutions, re.I)]
        best = min(fit, key=lambda r: (-(r.works_count or 0), r.person_id)).person_id if fit else None
        assert got[i] == (best, len(fit)), i


def test_name_classes_hold_every_bearer(table):
    left = table("i int, name string, name_key string", *[(i, "Wei Wang", "clash") for i in range(30)], (90, "Ada Lovelace", None), (91, None, None), (92, "Solo Left", None))
    right = table("j string, name string", *[(f"r{i}", "W. Wang") for i in range(20)], ("s", "A. Lovelace"), ("t", ""), ("u", "Solo Right"))
    rows = [tuple(r) for r in C.name_classes(left.drop("name_key"), right, "i", "j").collect()]
    assert len(rows) == 52 and {r[3:] for r in rows if r[0] == "w|wang"} == {(30, 20)}
    assert sorted(r[1:] for r in rows if r[0] == "a|lovelace") == [("left", "90", 1, 1), ("right", "s", 1, 1)]
    assert C.match_names(left, right).count() == 601
    assert [(r.i, r.other_j) for r in C.match_names(left, right, most_pairs=599).collect()] == [(90, "s")]
    assert C.match_names(left, right, most_pairs=600).count() == 601
    assert C.name_classes(left.where("false"), right, "i", "j").count() == 0


def test_vetted_text_address(table):
    people = table("person_id string, name string, institution_id string", ("A", "Ada Lovelace", "I1"))
    domains = table("institution_id string, domain string", ("I1", "u.edu"))
    texts = table("person_id string, text_pos int, text string", ("A", 1, "Correspondence: ada@u.edu"), ("A", 0, "x@u.edu lovelace@v.edu; LOVELACE [at] cs [dot] u [dot] edu"))
    assert C.vetted_emails(texts, people, domains).first().email == "lovelace@cs.u.edu"


def test_directory_join_first_entry_wins(table):
    people = table("person_id string, name string, institution_id string", ("A", "Jane M. Doe", "I1"), ("B", "Jane Doe", "I2"))
    entries = table("institution_id string, entry_pos int, name string, email string", ("I1", 1, "J. Doe", "second@u.edu"), ("I1", 0, "Dr Jane Doe", "first@u.edu"))
    got = {r.person_id: r.directory_email for r in C.join_directory(people, entries).collect()}
    assert got == {"A": "first@u.edu", "B": None}


def test_addresses_do_not_depend_on_partitioning(spark):
    df = spark.range(40).select("id", F.format_string("p%d [at] u dot edu", "id").alias("text"))
    one = {tuple(r) for r in C.extract_emails(df.repartition(1), "text", ["id"]).collect()}
    assert one == {tuple(r) for r in C.extract_emails(df.repartition(7), "text", ["id"]).collect()} and len(one) == 40


def test_long_runs_of_title_words_and_lead_ins_end_quickly(table):
    from peerlens.functions.text import topics_from_text
    from peerlens.operators.contacts import addresses, title_of

    rows = table("t string", ("Senior " * 100_000 + "Professor of Physics.",), ("Senior " * 100_000,))
    assert [r[0] is not None for r in rows.select(title_of(F.col("t"))).collect()] == [True, False]
    led = table("t string", ("i am " * 20_000 + "graph theory",))
    assert led.select(topics_from_text(F.col("t"))).first()[0] == ["graph theory"]
    dotted = table("t string", ("a@" + "b." * 3000 + "edu",), ("see jane@uni.edu",))
    assert [len(r[0]) <= 1 for r in dotted.select(addresses(F.col("t"))).collect()] == [True, True]


def test_selectors_with_children_and_parts_of_attributes(table):
    from peerlens.operators.pages import parse_selector

    html = '<ul><li class="x">a</li><span><li data-k="my-card-1">b</li></span></ul><div class="card big"><p>c</p></div>'
    pages = table("page_id int, url string, html string", (1, "http://u.edu", html))
    found = lambda s: [r.tag for r in G.select_elements(pages, s).orderBy("number").collect()]
    assert found("ul > li") == ["li"] and found("ul li") == ["li", "li"] and found("ul > span > li") == ["li"]
    assert found('[data-k*="card"]') == ["li"] and found("[data-k^=my]") == ["li"] and found("[data-k$='-1'], div > p") == ["li", "p"]
    assert found('[class~="big"]') == ["div"] and found("[data-k|=my]") == ["li"] and found("li[data-k=other]") == []
    for bad in ("li:first-child", "a + b", "a ~ b", "> li", "a >", ""):
        with pytest.raises(ValueError):
            parse_selector(bad)


def test_selectors_equal_a_walk_over_the_tree(table):
    rng = random.Random(11)
    pages, trees = [], []
    for p in range(12):
        html, tree, open_ = "", [], []
        for _ in range(40):  # elements in page order: (tag, class, chain of elements above)
            while open_ and rng.random() < 0.35:
                html += f"</{tree[open_.pop()][0]}>"
            tag, name = rng.choice(["div", "ul", "li"]), rng.choice(["a", "b", "a b", ""])
            html += f'<{tag} class="{name}">' + rng.choice(["", " ", "text"])
            tree.append((tag, name.split(), list(open_)))
            open_.append(len(tree) - 1)
        pages.append((p, None, html + "".join(f"</{tree[i][0]}>" for i in reversed(open_))))
        trees.append(tree)

    def fits(tree, i, steps):
        """steps: [(link, tag or None, class or None), ...], the last one for the element itself."""
        *outer, (link, tag, name) = steps
        if (tag and tree[i][0] != tag) or (name and name not in tree[i][1]):
            return False
        above = tree[i][2][-1:] if link == ">" else tree[i][2]
        return not outer or any(fits(tree, j, outer) for j in above)

    table_ = table("page_id int, url string, html string", *pages, pages[0])  # one page twice
    chains = {
        "div li": [[(" ", "div", None), (" ", "li", None)]], "div > li.a": [[(" ", "div", None), (">", "li", "a")]],
        ".a > div .b > ul": [[(" ", None, "a"), (">", "div", None), (" ", None, "b"), (">", "ul", None)]],
        "ul ul ul, li.a.b": [[(" ", "ul", None)] * 3, [(" ", "li", "a"), ]],
        "* > * > .b": [[(" ", None, None), (">", None, None), (">", None, "b")]],
    }
    for selector, paths in chains.items():
        want = sorted((p, t[0]) for p, tree in enumerate(trees) for i, t in enumerate(tree)
                      if any(fits(tree, i, steps) and ("li.a.b" not in selector or t[0] == "ul" or {"a", "b"} <= set(t[1])) for steps in paths))
        got = sorted((r.page_id, r.tag) for r in G.select_elements(table_, selector).collect())
        assert got == want and len(want) > 3, selector


def test_the_outermost_block_of_one_address_is_the_card(table):
    card = lambda i: f'<div><section><h3>Ann B{i}</h3><p>Lecturer in Law</p><a href="/p/{i}">more</a> ann.b{i}@u.edu</section></div>'
    deep = "<div>" * 300 + "<b>Zoe Deep</b> zoe@u.edu" + "</div>" * 300
    pages = table("page_id int, url string, html string", (1, "http://u.edu/x", "<div>" + "".join(card(i) for i in range(120)) + "</div>"), (2, None, deep), (3, "http://u.edu", None), (4, None, ""))
    rows = G.directory_entries(pages.unionAll(pages)).collect()
    assert sorted(r.name for r in rows if r.page_id == 1) == sorted(f"Ann B{i}" for i in range(120))
    assert all(r.profile_url == f"http://u.edu/p/{r.name[5:]}" for r in rows if r.page_id == 1)
    assert [(r.entry_pos, r.name, r.email) for r in rows if r.page_id == 2] == [(1, "Zoe Deep", "zoe@u.edu")]
    assert len(rows) == 121 and G.directory_entries(pages.where("false"), "div").count() == 0



def test_only_entities_reach_python(spark, table):
    rng = random.Random(3)
    pieces = ["&amp;", "&#64;", "&#x2E", "&notit;", "&", "&;", "&#", "&#0;", "&#10;", "&#32;", "&#1;", "&nbsp", "&ampé", "&#12;&#32;", "&" + "x" * 40, "a", " ", "\n", "\x01", " \x01", "<", ";", "#", "é", "😀"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(400)] + ["", None]
    df = table("id int, text string", *enumerate(texts)).select("id", unescape_entities(F.col("text")).alias("t"))
    assert {r.id: r.t for r in df.collect()} == {i: None if t is None else html.unescape(t) for i, t in enumerate(texts)}
    sent = [x for x in plan_lines(df) if "ArrowEvalPython" in x]
    assert sent and all("regexp_extract_all(text" in x for x in sent)


def plan_lines(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_plain_name_keys(table):
    rng = random.Random(5)
    pieces = ["Jane", "doe", " ", ".", ". ", "é", "É", " ", "…", "\n", "1", "-", "中", "ﬁ", "K", "ó", "İ", "Σ", "x", "😀"]
    names = ["".join(rng.choices(pieces, k=rng.randint(0, 9))) for _ in range(600)] + ["", None, "Dr. Jane van Doe (PhD)"]

    def key(name):
        if name is None:
            return None
        folded = "".join(c for c in unicodedata.normalize("NFKD", name.lower()) if not unicodedata.combining(c))
        words = re.sub("[^a-z ]", "", folded.replace(".", " ")).split()
        return f"{words[0][0]}|{words[-1]}" if words else None

    df = R.with_plain_name_key(table("id int, name string", *enumerate(names)), "name", "key")
    assert {r.id: r.key for r in df.collect()} == {i: key(n) for i, n in enumerate(names)}


def test_names_are_read_before_pins_meet(table):
    pins = table("ref_id int, name string, pinned_id string", (1, "Ann Lee", "A"), (2, "Zoë Lee", "A"), (3, "Ann Lee", None), (4, "Bo", "C"))
    authors = table("person_id string, name string", ("A", "A. Leé"), ("B", "Bo"))
    df = R.verify_pins(pins, authors)
    assert {r.ref_id: (r.person_id, r.note) for r in df.collect()} == {
        1: ("A", None), 2: (None, "pinned id belongs to A. Leé"), 4: (None, "pinned id not found")}
    lines = plan_lines(df)
    join = next(i for i, x in enumerate(lines) if "Join" in x)
    assert all(i > join for i, x in enumerate(lines) if "EvalPython" in x)
