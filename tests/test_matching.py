import numpy as np
import pytest
from pyspark.sql import functions as F

from peerlens.functions.text import fold
from peerlens.operators import concepts as K
from peerlens.operators import evaluate as V
from peerlens.operators import vectors as X
from peerlens.plans.match import hybrid_matches, match_people

GROUPS = [
    (0, 0, "gastrointestinal", False), (0, 1, "gi", False), (0, 2, "bowel", False), (0, 3, "inflammatory bowel disease", True),
    (1, 0, "peptide", False), (1, 1, "polypeptide", False), (1, 2, "insulin", True),
]
VOCABULARY = [("Inflammatory Bowel Disease Research", 3), ("Peptide", 2), ("Insulin Signalling", 1), ("Climate Models", 10)]


@pytest.fixture
def groups(table):
    return table("group_id int, term_pos int, term string, narrower boolean", *GROUPS)


@pytest.fixture
def vocabulary(table):
    return table("tag string, people long", *VOCABULARY)


@pytest.mark.parametrize(
    "text,tokens",
    [
        ("Peptides", ["peptide"]), ("studies", ["study"]), ("Crohn's disease", ["crohn", "disease"]), ("classes boxes branches", ["class", "box", "branch"]),
        ("virus analysis glass porous", ["virus", "analysis", "glass", "porous"]), ("The use of Éclairs", ["eclair"]), ("gas", ["gas"]), ("ties", ["tie"]), ("", []),
    ],
)
def test_tokens(table, text, tokens):
    assert K.with_concept_tokens(table("t string", (text,)), "t").first().tokens == tokens


def test_query_split_and_refusals(table):
    got = K.parse_concepts(table("query_id int, text string", (1, "GI and  peptides, the analysis; x + of & cancer"))).orderBy("concept_pos").collect()
    assert [(r.concept, r.reason) for r in got] == [
        ("GI", None), ("peptides", None), ("the analysis", "too general"), ("x", "too short"), ("of", "no words to match"), ("cancer", None),
    ]


def concepts(table, *texts):
    return table("query_id int, concept_pos int, concept string", *[(1, i, t) for i, t in enumerate(texts)])


def test_alternatives(table, groups):
    got = {r.label: r.weight for r in K.expand_concepts(concepts(table, "GI disorders / peptide"), groups).collect()}
    assert got["GI disorders"] == 1.0 and got["peptide"] == 1.0
    assert got["gastrointestinal disorder"] == pytest.approx(0.9 * 0.95)
    assert got["inflammatory bowel disease disorder"] == pytest.approx(0.75 * 0.95)
    assert got["insulin"] == 0.75 and got["polypeptide"] == 0.9


def test_narrower_terms_never_expand_upwards(table, groups):
    assert [r.label for r in K.expand_concepts(concepts(table, "insulin"), groups).collect()] == ["insulin"]


def test_synonyms_keywords_and_prefixes_reach_tags(table, groups, vocabulary):
    info = table("tag string, subfield string, keywords array<string>", ("Climate Models", "Atmospheric Science", ["Warming", "Gastric oddity"]))
    alts = K.expand_concepts(concepts(table, "gi", "peptide", "warming", "clima", "atmospheric"), groups)
    got = {(r.concept_pos, r.tag): (r.weight, r.via) for r in K.concept_tags(alts, vocabulary, info, total=20).collect()}
    assert got[(0, "Inflammatory Bowel Disease Research")] == (pytest.approx(0.9 * (1 - 3 / 20)), "bowel")
    assert got[(1, "Peptide")] == (pytest.approx(1 - 2 / 20), None)
    assert got[(1, "Insulin Signalling")][1] == "insulin"
    assert got[(2, "Climate Models")] == (pytest.approx(0.8 * 0.5), "Warming")
    assert got[(3, "Climate Models")][0] == pytest.approx(0.85 * 0.5)
    assert got[(4, "Climate Models")] == (pytest.approx(0.6 * 0.5), "Atmospheric Science")
    assert len(got) == 6


def test_people_with_both_concepts_come_first(table, groups, vocabulary):
    tags = table(
        "person_id string, pos int, tag string",
        ("both", 0, "Peptide"), ("both", 1, "Inflammatory Bowel Disease Research"), ("one", 0, "Peptide"), ("none", 0, "Climate Models"),
    )
    catalog = table(
        "person_id string, domains array<string>, title string",
        ("tagless", ["Chemistry", "Peptide Chemistry"], "Professor"), ("titled", [], "Reader in Peptides"), ("one", ["Bowel"], None),
    )
    wanted = concepts(table, "gi", "peptide")
    alts = K.expand_concepts(wanted, groups)
    scores, hits = K.score_concepts(tags, K.concept_tags(alts, vocabulary, total=20), wanted, catalog, alts)
    got = {r.person_id: r for r in scores.collect()}
    assert set(got) == {"both", "one", "tagless", "titled"}
    assert got["both"].matched == 2 and got["both"].score > got["one"].score > got["tagless"].score
    assert got["tagless"].score == pytest.approx(0.6 / 1.15 / 2, abs=1e-6) and got["titled"].score == pytest.approx(0.2)
    assert {r.person_id for r in K.combine_concepts(scores).collect()} == {"both"}
    assert hits.where("person_id = 'titled'").first().via == "title"
    assert K.score_concepts(tags, K.concept_tags(K.expand_concepts(concepts(table, "strategy"), groups), vocabulary), concepts(table, "strategy"))[0].count() == 0


def test_every_tag_of_a_profile_on_request(table):
    names = [f"alpha{chr(97 + i)}" for i in range(15)]
    vocabulary = table("tag string, people long", *[(n, 90 if i == 0 else 2) for i, n in enumerate(names)])
    profiles = table("profile_id int, interests array<string>, summary string, text string", (1, names, None, None), (2, [], names[0], None))
    assert K.profile_tags(profiles, vocabulary, total=100).count() == 12
    got = K.profile_tags(profiles, vocabulary, total=100, limit=None, share=None).orderBy("profile_id", "tag_rank").collect()
    assert [(r.profile_id, r.tag, r.tag_rank) for r in got] == [(1, n, i + 1) for i, n in enumerate(names[1:] + names[:1])] + [(2, names[0], 1)]


def test_words_meet_tokens_they_begin(table):
    rng = np.random.default_rng(3)
    base = ["inter", "inte", "multi", "x" * 31, "x" * 32, "x" * 33, "ab", "über", "交叉学科研究"]
    words = sorted({b + "".join(rng.choice(list("ab"), rng.integers(0, 3))) for b in base for _ in range(4)} | set(base))
    tokens = sorted({w + "".join(rng.choice(list("ab"), rng.integers(0, 4))) for w in words for _ in range(3)} | {"x" * 5000, "y"})
    got = K.word_links(table("_w string", *[(w,) for w in words + words[:3]]), table("_tok string", *[(t,) for t in tokens + tokens[:3]]))
    want = {(w, t, w == t) for w in words for t in tokens if w == t or (len(w) >= 5 and t.startswith(w))}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 100


def test_folding(table):
    rows = table("i int, t string", (1, "ÀÉ ﬁx Ⅳ"), (2, "PLAIN Text"), (3, None), (4, ""), (5, "İzmir ß"))
    got = {r.i: r.f for r in rows.select("i", fold(F.col("t")).alias("f")).collect()}
    assert got == {1: "ae fix iv", 2: "plain text", 3: None, 4: "", 5: "izmir ß"}


def test_profile_tags_and_overlap(table, vocabulary):
    profiles = table(
        "profile_id int, interests array<string>, summary string, text string",
        (1, ["inflammatory bowel disease"], "peptides", "in climate models of insulin"), (2, [], None, None),
    )
    got = K.profile_tags(profiles, vocabulary, total=50).orderBy("tag_rank").collect()
    assert [(r.profile_id, r.tag) for r in got] == [(1, "Inflammatory Bowel Disease Research"), (1, "Peptide"), (1, "Climate Models")]
    assert got[0].weight == pytest.approx(2 * (1 - 3 / 50)) and got[1].weight == pytest.approx(0.75 * (1 - 2 / 50))
    assert "Climate Models" not in [r.tag for r in K.profile_tags(profiles, vocabulary, total=20).collect()]
    tags = table("person_id string, pos int, tag string", ("A", 0, "inflammatory bowel disease research"), ("A", 1, "Peptide"), ("B", 3, "Peptide"))
    wanted = K.profile_tags(profiles, vocabulary, total=50)
    overlap = {r.person_id: r.overlap for r in K.profile_overlap(wanted, tags).collect()}
    assert 0.5 < overlap["A"] <= 1 and overlap["A"] > overlap["B"] > 0
    pairs = table("profile_id int, person_id string", (1, "B"))
    assert [(r.person_id, r.overlap) for r in K.profile_overlap(wanted, tags, pairs).collect()] == [("B", overlap["B"])]
    used = table("profile_id int, concept string", (1, "PEPTIDE"))
    assert [r.tag for r in K.suggest_tags(wanted, used).orderBy("place").collect()] == ["Inflammatory Bowel Disease Research", "Climate Models"]


def test_keyword_search(table):
    rows = table(
        "person_id int, name string, title string, institution_name string, domains array<string>, publication_titles array<string>",
        (1, "Ada Lovelace", "Reader", "Oxford", ["Computing"], ["Engines of note"]), (2, "Bob", None, "Lovelace College", [], []), (3, "Eve", None, "Yale", ["Love studies"], None), (4, "Max", None, None, None, None),
    )
    index = K.token_index(rows)
    found = lambda q, i=index: {r.person_id: r.tier for r in K.keyword_search(rows, q, i).collect()}
    assert found("love") == {1: 0, 2: 1, 3: 1}
    assert found("engi ada") == {1: 0}
    assert found("elac", None) == {1: 0, 2: 1}


# --- vectors ---------------------------------------------------------------------------------------

def unit_rows(n, dim, seed=0):
    m = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def vector_table(spark, m):
    return spark.createDataFrame([(i, i % 3, [float(x) for x in v]) for i, v in enumerate(m)], "person_id long, institution_id int, vector array<float>")


def profile_table(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "profile_id int, vector array<float>")


def brute(profiles, people, k):
    s = np.round(profiles.astype(np.float64) @ people.astype(np.float64).T, 6)
    return {i: [int(j) for j in np.lexsort((np.arange(people.shape[0]), -row))[:k]] for i, row in enumerate(s)}


def ranked(df):
    out = {}
    for r in df.orderBy("profile_id", "rank").collect():
        out.setdefault(r.profile_id, []).append(r.person_id)
    return out


def test_exact_ranking_equals_brute_force_in_any_partitioning(spark, monkeypatch):
    people, profiles = unit_rows(600, 32), unit_rows(9, 32, 1)
    want = brute(profiles, people, 25)
    v = vector_table(spark, people)
    for parts in (1, 7):
        assert ranked(X.rank_cosine(profile_table(spark, profiles), v.repartition(parts), 25)) == want
    monkeypatch.setattr(X, "BLOCK_RESULTS", 60)  # several passes over the vectors
    assert ranked(X.rank_cosine(profile_table(spark, profiles), v, 25)) == want
    monkeypatch.setattr(X, "MAX_ROUNDS", 0)  # a grid of blocks
    monkeypatch.setattr(X, "GRID_PROFILES", 4)
    monkeypatch.setattr(X, "GRID_VECTORS", 150)
    assert ranked(X.rank_cosine(profile_table(spark, profiles), v, 25)) == want


def test_grid_ranking_of_bits_and_clusters(spark, monkeypatch):
    people = unit_rows(400, 16, 8)
    v = vector_table(spark, people)
    profiles = profile_table(spark, people[:6])
    bits = X.pack_bits(X.quantize(v)).drop("vector", "q")
    centroids = X.train_centroids(v)
    assigned = X.assign_clusters(v, centroids)
    few = spark.createDataFrame([(399,), (3,)], "person_id long")
    run = lambda: (
        ranked(X.rank_bits(profiles, bits, 16, 9)), ranked(X.search_ivf(profiles, assigned, centroids, 7, probe_start=2, probe_max=4)),
        ranked(X.rank_cosine(profiles, v, 5, few)),
    )
    broadcast = run()
    monkeypatch.setattr(X, "MAX_ROUNDS", 0)
    monkeypatch.setattr(X, "GRID_PROFILES", 2)
    monkeypatch.setattr(X, "GRID_VECTORS", 30)
    assert run() == broadcast


def test_copies_tie_by_id_and_allowed_limits(spark):
    people = np.repeat(unit_rows(1, 16), 300, axis=0)
    got = X.rank_cosine(profile_table(spark, people[:1]), vector_table(spark, people).repartition(5), 10)
    assert ranked(got) == {0: list(range(10))}
    allowed = spark.createDataFrame([(5,), (250,)], "person_id long")
    rows = X.rank_cosine(profile_table(spark, people[:1]), vector_table(spark, people), 10, allowed).orderBy("rank").collect()
    assert [(r.person_id, r.institution_id, r.score) for r in rows] == [(5, 2, 1.0), (250, 1, 1.0)]


def test_int8_ranking_is_close_to_float(spark):
    people, profiles = unit_rows(300, 64), unit_rows(3, 64, 2)
    v = X.quantize(vector_table(spark, people))
    a = ranked(X.rank_cosine(profile_table(spark, profiles), v, 10))
    b = ranked(X.rank_cosine(profile_table(spark, profiles), v, 10, value="q"))
    assert all(a[i][0] == b[i][0] and len(set(a[i]) & set(b[i])) >= 8 for i in a)


def test_bit_order(spark):
    q = [5, -3, 0, 7, -1, 2, 2, -8] + [1] * 8
    df = spark.createDataFrame([(1, q)], "person_id int, q array<tinyint>")
    assert bytes(X.pack_bits(df).first().bits) == bytes([0b10010110, 0b11111111])


def test_bits_self_score_and_recall(spark):
    people = unit_rows(2000, 384, 3)
    profiles = profile_table(spark, people[:5])
    v = vector_table(spark, people)
    bits = X.pack_bits(X.quantize(v)).drop("vector", "q")
    near = X.rank_bits(profiles, bits, 384, 50)
    scores = {(r.profile_id, r.person_id): r.score for r in near.collect()}
    assert all(scores[(i, i)] > 0.9 for i in range(5))
    assert all(s < 0.3 for (i, j), s in scores.items() if i != j)
    found = X.recall_at(X.rank_cosine(profiles, v, 10), near).collect()
    assert all(r.found >= 5 for r in found)


def test_clusters_cover_everyone_once(spark, monkeypatch):
    v = vector_table(spark, unit_rows(300, 16, 4))
    centroids = X.train_centroids(v)
    rows = centroids.collect()
    assert len(rows) == X.cluster_count(300) == 17
    assert all(abs(np.linalg.norm(r.vector) - 1) < 1e-6 for r in rows)
    assigned = X.assign_clusters(v, centroids)
    got = {r.person_id: r.cluster for r in assigned.collect()}
    assert len(got) == 300 == assigned.count()
    monkeypatch.setattr(X, "CENTROID_BLOCK_BYTES", 16 * 8 * 4)  # several blocks
    assert {r.person_id: r.cluster for r in X.assign_clusters(v.repartition(3), centroids).collect()} == got


def test_tree_covers_everyone_and_finds_the_nearest(spark, monkeypatch):
    rng = np.random.default_rng(8)
    middles = unit_rows(40, 16, 9)
    people = np.array([middles[i % 40] + 0.15 * rng.normal(size=16) for i in range(1200)])
    people = people / np.linalg.norm(people, axis=1, keepdims=True)
    v = vector_table(spark, people)
    tree = X.train_centroid_tree(v, 36).cache()
    rows = tree.collect()
    leaves = [r for r in rows if r.cluster is not None]
    assert sorted(r.cluster for r in leaves) == list(range(len(leaves))) and 30 <= len(leaves) <= 42
    assert all(abs(np.linalg.norm(r.vector) - 1) < 1e-6 for r in rows)
    fans = {}
    for r in rows:
        fans[r.parent] = fans.get(r.parent, 0) + 1
    assert fans[None] == 6 and max(fans.values()) <= 24
    got = {r.person_id: r.cluster for r in X.assign_in_tree(v, tree).collect()}
    assert len(got) == 1200 and None not in got.values()
    exact = {r.person_id: r.cluster for r in X.assign_clusters(v, X.leaf_centroids(tree)).collect()}
    assert sum(got[i] == exact[i] for i in got) >= 0.9 * 1200  # two nodes a level lead to the nearest leaf
    assert {r.person_id: r.cluster for r in X.assign_in_tree(v, tree, beam=36).collect()} == exact  # all of them always
    monkeypatch.setattr(X, "CENTROID_BLOCK_BYTES", 16 * 4 * 12)  # several blocks
    assert {r.person_id: r.cluster for r in X.assign_in_tree(v.repartition(3), tree).collect()} == got
    monkeypatch.undo()
    again = X.train_centroid_tree(v.repartition(5), 36)
    assert {(r.node, r.cluster, tuple(np.round(r.vector, 6))) for r in again.collect()} == {(r.node, r.cluster, tuple(np.round(r.vector, 6))) for r in rows}
    profiles = profile_table(spark, people[:5])
    near = X.search_ivf(profiles, X.assign_in_tree(v, tree), X.leaf_centroids(tree), 10)
    assert all(r.found >= 9 for r in X.recall_at(X.rank_cosine(profiles, v, 10), near, 10).collect())


def test_a_tree_splits_a_cell_that_holds_most_rows(spark):
    rng = np.random.default_rng(3)
    near = np.ones(8) + 0.05 * rng.normal(size=(900, 8))
    people = np.concatenate([near, rng.normal(size=(100, 8))])
    tree = X.train_centroid_tree(vector_table(spark, people / np.linalg.norm(people, axis=1, keepdims=True)), 400, per_centroid=4)
    fans = {r.parent: r.n for r in tree.groupBy("parent").agg(F.count("*").alias("n")).collect()}
    assert max(fans.values()) <= 80 and len(fans) > 10


def test_a_tree_of_few_equal_or_empty_rows(spark):
    same = vector_table(spark, np.tile([1.0, 0.0, 0.0], (50, 1)))
    tree = X.train_centroid_tree(same)
    assert X.assign_in_tree(same, tree).select("cluster").distinct().count() == 1
    zero = spark.createDataFrame([(1, 1, [0.0, 0.0, 0.0]), (2, 1, [0.0, 2.0, 0.0])], "person_id long, institution_id int, vector array<double>")
    assert X.assign_in_tree(zero, X.train_centroid_tree(zero)).where("cluster is null").count() == 0
    assert X.train_centroid_tree(same.where("false")).count() == 0


def test_clustered_search_finds_the_nearest(spark):
    people = unit_rows(400, 16, 5)
    v = vector_table(spark, people)
    profiles = profile_table(spark, people[:4])
    centroids = X.train_centroids(v)
    assigned = X.assign_clusters(v, centroids)
    everywhere = ranked(X.search_ivf(profiles, assigned, centroids, 10))
    assert everywhere == brute(people[:4], people, 10)  # 20 clusters, all probed
    narrow = ranked(X.search_ivf(profiles, assigned, centroids, 5, probe_start=2, probe_max=4))
    assert all(narrow[i][0] == i and len(narrow[i]) == 5 for i in range(4))
    few = spark.createDataFrame([(399,)], "person_id long")
    assert ranked(X.search_ivf(profiles, assigned, centroids, 10, few)) == {i: [399] for i in range(4)}


def test_picking_the_search(spark):
    people = unit_rows(60, 16, 6)
    v = vector_table(spark, people)
    profiles = profile_table(spark, people[:1])
    assert {r.institution_id for r in match_people(profiles, v, institutions=[1], k=5).collect()} == {1}
    sizes = spark.createDataFrame([(0, 1, 20), (1, 2, 20), (2, 3, 20)], "institution_id int, rank int, people int")
    assert {r.institution_id for r in match_people(profiles, v, sizes=sizes, k=60, cap=40).collect()} == {0, 1}
    assert match_people(profiles, v, k=60).count() == 60
    assert match_people(profiles, v, sizes=sizes, k=60).count() == 60  # no cap unless asked for
    with pytest.raises(ValueError):
        match_people(profiles, v, k=5, approximate=True)


def test_vectors_of_different_lengths_raise(spark):
    ragged = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [1.0])], "person_id long, vector array<double>").coalesce(1)
    profiles = spark.createDataFrame([(0, [1.0, 0.0])], "profile_id long, vector array<double>")
    with pytest.raises(Exception, match="differ in length"):
        X.rank_cosine(profiles, ragged, 2).collect()


def test_hybrid_is_clamped_and_needs_the_catalog(table, vocabulary):
    matches = table("profile_id int, person_id string, institution_id int, score double, rank int", (1, "A", 1, 0.95, 1), (1, "B", 1, -0.5, 2), (1, "C", 1, 0.5, 3))
    tags = table("person_id string, pos int, tag string", ("A", 0, "Peptide"))
    profiles = table("profile_id int, interests array<string>, summary string, text string", (1, ["peptide"], None, None))
    got = {r.person_id: r.match_score for r in hybrid_matches(profiles, matches, vocabulary, None, tags, table("person_id string", ("A",), ("B",))).collect()}
    assert got == {"A": 1.0, "B": 0.0}


def test_shape_problems(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [1.0, float("nan")])], "person_id int, vector array<double>")
    assert {r.person_id: r.problem for r in X.check_vectors_shape(df, 2).collect()} == {2: "wrong length", 3: "missing", 4: "not a number"}


def test_embedding_is_stable_and_pluggable(table):
    df = table("id int, t string", (1, "alpha beta"), (2, "beta alpha"), (3, None))
    got = {r.id: r.vector for r in X.embed_texts(df, "t", X.hashed_words(8)).collect()}
    assert got[1] == got[2] and sum(x * x for x in got[1]) == pytest.approx(1, abs=1e-5) and got[3] == [0.0] * 8
    lengths = X.embed_texts(df, "t", lambda texts: np.array([[len(t)] for t in texts])).collect()
    assert {r.id: r.vector for r in lengths} == {1: [10.0], 2: [10.0], 3: [0.0]}


def test_evidence_and_shared_interests(table):
    matches = table("profile_id int, person_id string, rank int", (1, "A", 1), (1, "B", 6))
    profiles = table("profile_id int, vector array<double>", (1, [1.0, 0.0]))
    pieces = table(
        "person_id string, kind string, pos int, text string, vector array<double>",
        *[("A", "area", i, f"area {i}", [1.0, float(i)]) for i in range(5)], ("A", "paper", 0, "Graph-based peptides", [0.0, 0.0]), ("B", "area", 0, "b", [1.0, 0.0]),
    )
    got = X.match_evidence(matches, profiles, pieces, max_rank=5).orderBy("kind", "place").collect()
    assert [(r.text, r.closeness) for r in got] == [("area 0", 1.0), ("area 1", 0.707107), ("area 2", 0.447214), ("Graph-based peptides", 0.0)]
    interests = table("profile_id int, pos int, interest string", (1, 0, "Peptides of the area"), (1, 1, "peptides and proteins"), (1, 2, "the"))
    assert [r.interest for r in X.shared_interests(interests, matches, pieces).collect()] == ["Peptides of the area"]


def test_evaluation(spark, table):
    people = unit_rows(50, 16, 7)
    runs = spark.createDataFrame(
        [(0, "resume", "cv", 900, [float(x) for x in people[0]]), (1, "resume", "cv", 100, [float(x) for x in people[1]]), (2, "openalex", None, None, None), (3, "openalex", "A3", None, None)],
        "profile_id int, path string, reference string, document_chars int, vector array<float>",
    )
    own = spark.createDataFrame([(0, 0), (1, 1)], "profile_id int, person_id long")
    judged = V.evaluate(runs, vector_table(spark, people), own)
    got = {r.profile_id: (r.status, r.reason, r.top_score, r.self_rank) for r in judged.collect()}
    assert got[0] == ("passed", None, 1.0, 1)
    assert got[1][:3] == ("failed", "too little text", None)
    assert got[2][:2] == ("skipped", "no reference")
    assert got[3][0] == "failed"
    far = V.evaluate(runs, vector_table(spark, people), spark.createDataFrame([(0, 9), (0, 60), (1, 4)], "profile_id int, person_id long"))
    unit = people / np.linalg.norm(people, axis=1, keepdims=True)
    want = {p: [int(i) for i in np.lexsort((np.arange(50), -np.round(unit @ unit[p], 6)))].index(who) + 1 for p, who in ((0, 9), (1, 4))}
    assert {r.profile_id: r.self_rank for r in far.collect()} == {**want, 2: None, 3: None}
    s = V.summarize_runs(judged).first()
    assert (s.runs_attempted, s.runs_passed, s.runs_skipped, s.pass_ratio, s.status) == (3, 1, 1, 0.333, "failing")
    assert V.summarize_runs(judged.where("status = 'skipped'")).first().status == "not_run"
    shown = table("ref_id int, status string, top_score double, interests array<string>, text string", (1, "passed", 0.5, ["x"], None), (2, "passed", 0.35, ["x"], None), (3, "failed", 0.9, ["x"], None), (4, "passed", 0.5, [], " "))
    assert [r.ref_id for r in V.showcase(shown).collect()] == [1]
