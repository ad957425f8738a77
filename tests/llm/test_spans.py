import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from peerlens.llm import queries, spans

ROOT = "/root/testdata/sf0.001"
A, B = f"{spans.TOKENIZERS}/{spans.A_FILE}", f"{spans.TOKENIZERS}/{spans.B_FILE}"
ODD = [
    "", " ", "\n", "a  b", " lead", "trail ", "\tab\t", "x \r\ny", "don't  stop\n\n  now", "ﬁ ①", "日本 𝒳é🙂", "é é", "▁x", "a▁ b", "<s> </s><|endoftext|>", "<0x0A>", "\x00 \x1c,\x1c x",
    "a  b　 c  d\x85 e", "​", "x" * 30_000, "\n" * 3000, "🙂" * 500,
]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    alphabet = spans.byte_alphabet()
    a_bytes = {i: bytes(alphabet[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if all(c in alphabet for c in t)}

    def of_b(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def groups(text):
        """[(A ids, B ids)] of a whole text, by running sums of decoded bytes; none where bytes differ."""
        if not text:
            return []
        a_ids, b_ids, whole = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
        if b"".join(a_bytes[i] for i in a_ids) != whole or b"".join(map(of_b, b_ids)) != whole:
            return []
        out, at, a_here, b_here = [], [0, 0], [], []
        a_left, b_left = a_ids[::-1], b_ids[::-1]
        while a_left or b_left:
            if at[0] <= at[1]:
                a_here.append(a_left.pop())
                at[0] += len(a_bytes[a_here[-1]])
            else:
                b_here.append(b_left.pop())
                at[1] += len(of_b(b_here[-1]))
            if at[0] == at[1]:
                out.append((a_here, b_here))
                a_here, b_here = [], []
        return out

    return groups


def _said(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def _brute(rows, both):
    """Rows of the query by whole texts and all links."""
    grouped = [(i, both(t)) for i, t in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in grouped]
    count = Counter(pair for own in links for pair in own)
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (i, g), own in zip(grouped, links, strict=True):
        best = sum(n for (x, y), n in own.items() if count[x, y] == most[x])
        said = hashlib.sha256(_said(g).encode()).hexdigest() if g else ""
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), best, sum(n * count[p] for p, n in own.items()), said))
    return sorted(out, key=repr)


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


@pytest.mark.parametrize("frequent", [spans.FREQUENT, 20])
def test_query_against_whole_texts(spark, both, monkeypatch, frequent):
    monkeypatch.setattr(spans, "FREQUENT", frequent)  # with 20, nearly all pairs are joined
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()]
    got = queries.op12_token_spans(spark, ROOT).select("doc_id", *COLUMNS, "groups_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == _brute(rows, both)


def test_odd_texts(table, both):
    rows = [(None, None), (None, "a b"), (1, None), (2, "a b"), (2, "a b"), *((10 + i, t) for i, t in enumerate(ODD))]
    df = table("doc_id long, text string, row long, pairs string, n_a long", *[(*r, 1, "p", 9) for r in rows])
    got = spans.align_tokenizers(df, digest=True).select("id", *COLUMNS, "groups").collect()
    assert sorted(map(tuple, got), key=repr) == _brute(rows, both)


def test_chunks_end_where_tokens_end(both):
    aligner = spans.Aligner(*spans.read_vocabularies(A, B))
    rng = random.Random(3)
    parts = [*"ab ,.  \n\t\r1'sS", "é", "日", "🙂", " ", "　", "\x1c", " ", " the", "▁", "ﬁ", "\x00", "</s>", "don't", "́"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(5000)]
    said = aligner.documents(texts)[0]
    assert said == [_said(both(t)) for t in texts]
    for t in texts[:1000]:
        found = aligner.tokens(t) if t else None
        if found is not None:  # cuts from offsets and spans are the sums of decoded bytes
            a_ids, a_ends, b_ids, b_ends = found
            assert a_ends.tolist() == aligner.a_lengths[a_ids].cumsum().tolist() and b_ends.tolist() == aligner.b_lengths[b_ids].cumsum().tolist()


@pytest.mark.parametrize("kept", [1000, 5000, 12_000])
def test_a_full_store_keeps_what_was_met_again(both, monkeypatch, kept):
    monkeypatch.setattr(spans, "KEPT", kept)
    aligner = spans.Aligner(*spans.read_vocabularies(A, B))
    rng = random.Random(kept)
    every = ["one two", "three, four", "five a▁b", "Grüße 日本", "a▁b", *(f"word{i} again one" for i in range(60))]
    sizes = []
    for _ in range(40):
        texts = rng.sample(every, 3) + [None]
        assert aligner.documents(texts)[0] == [_said(both(t)) if t else "" for t in texts]
        sizes.append(len(aligner.index))
    assert any(later < earlier for earlier, later in zip(sizes, sizes[1:], strict=False)) and len(aligner.said) == len(aligner.index) == len(aligner.met)


def test_groups_are_listed_and_string_ids_pass(table, both):
    df = table("doc_id string, text string", ("x", "Grüße, world"))
    row = spans.align_tokenizers(df).first()
    assert row["id"] == "x" and row["groups"] == _said(both("Grüße, world"))


def test_empty_table(table):
    assert spans.align_tokenizers(table("doc_id long, text string")).count() == 0
