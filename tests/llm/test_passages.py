import random

import pytest

from curatrix.llm import neardup, paragraphs
from curatrix.llm.paragraphs import repeated_paragraphs

from .brute import WORD, pieces, repeated_pieces


@pytest.fixture(autouse=True)
def small_bitmaps(monkeypatch):
    monkeypatch.setattr(paragraphs, "BITS", 1 << 14)
    monkeypatch.setattr(neardup, "BITS", 1 << 14)


def test_passages_inside_lines_same_as_brute_force(spark):
    """All words of every window of 50 words that stands earlier go, in the middle of lines and across them; nothing else but whole lines."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(9000)}é"
    run = lambda n: " ".join(word() for _ in range(n))
    passages = [run(n) for n in (49, 50, 51, 60, 60, 75, 99, 130)]
    docs = []
    for i in range(60):
        inner = [f"{run(rng.randrange(30, 160))}  {p}{rng.choice((' ', chr(10)))}{run(rng.randrange(30, 90))}" for p in rng.sample(passages, rng.randrange(3))]
        docs.append((rng.randrange(10 ** 6) * 100 + i, "\n".join([run(8), *inner])))
    docs += [(7, passages[3].replace(" ", "\n", 20) + " " + passages[4]), (8, run(40) + " x y" * 60), (9, docs[0][1]), (9, docs[0][1])]
    where, want = {}, {}
    for i, t in sorted(set(docs)):
        w = WORD.findall(t)
        for p in range(len(w) - 50 + 1):
            if where.setdefault(tuple(w[p:p + 50]), (i, p)) != (i, p):
                want.setdefault(i, set()).update(range(p, p + 50))
    got = {r.doc_id: r for r in repeated_paragraphs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    again = repeated_pieces(sorted(set(docs)))
    assert len(want) > 20
    for i, t in docs:
        spans, inside = [m.span() for m in WORD.finditer(t)], set()
        byte = [(len(t[:a].encode()), len(t[:b].encode())) for a, b in spans]
        whole = {k for n, a, b in pieces(t) if (i, n) in again for k, (c, d) in enumerate(byte) if a <= c and d <= b}
        for x in got[i].removed:
            assert "\n" not in t.encode()[x.begin:x.end].decode()
            held = {k for k, (a, b) in enumerate(byte) if x.begin <= a and b <= x.end}
            inside |= held
        assert inside == want.get(i, set()) | whole, i


def test_short_paragraphs_count(spark):
    texts = ["one\na b\nA  b\nsix words are in this line", "six words are in this line\na b c\none\nb a", "a a a a a a a\na b c d e f g", "a b c d e f g h\na a a a a a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(x.number, x.keeper_id, x.keeper_number) for x in r.removed] for r in repeated_paragraphs(df).collect()}
    assert got == {0: [(2, 0, 1)], 1: [(0, 0, 3), (2, 0, 0)], 2: [], 3: [(0, 2, 1), (1, 2, 0)]}
