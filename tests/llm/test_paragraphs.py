import random

import pytest

from curatrix.llm import neardup, paragraphs
from curatrix.llm.paragraphs import repeated_paragraphs, tune_bands

from .brute import pieces, repeated_pieces


@pytest.fixture(autouse=True)
def small_bitmaps(monkeypatch):
    """Bitmaps that let some strangers through, and are fast to send."""
    monkeypatch.setattr(paragraphs, "BITS", 1 << 14)
    monkeypatch.setattr(neardup, "BITS", 1 << 14)


def fixture(seed=4):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(900)}"
    passages = [" ".join(word() for _ in range(rng.randrange(52, 80))) for _ in range(6)]
    docs = []
    for i in range(120):
        lines = [" ".join(word() for _ in range(rng.randrange(3, 40))) for _ in range(rng.randrange(1, 5))]
        for p in rng.sample(passages, rng.randrange(3)):
            w = p.split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "changed"
            lines.insert(rng.randrange(len(lines) + 1), " ".join(w))
        docs.append((i, "\n".join(lines)))
    return docs + [(200, None), (201, ""), (202, " \n "), (203, docs[0][1]), (204, passages[0] + "\n" + passages[0])]


def test_same_as_brute_force(spark):
    docs = fixture()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, number int, removed string")
    got = {r.doc_id: r for r in repeated_paragraphs(df).collect()}
    want = repeated_pieces(docs)
    whole = {(i, x.number) for i, r in got.items() for x in r.removed if (x.number, x.begin, x.end) in pieces(dict(docs)[i])}
    assert want <= whole and len(want) > 100
    for i, t in docs:
        for x in got[i].removed:
            line = (t or "").encode()[x.begin:x.end].decode()
            assert "\n" not in line and line.split()
    assert got[200].n_paragraphs == got[202].n_paragraphs == 0 and got[204].n_removed >= 1


def test_repeats_nulls_and_empty_table(spark):
    line = "a b c d e f g h i j k l"
    df = spark.createDataFrame([(1, line), (1, line), (None, line), (2, "é " + line + "\nshort one")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_paragraphs, r.n_removed) for r in repeated_paragraphs(df).collect())
    assert got == [(0, 1, 0), (1, 1, 1), (1, 1, 1), (2, 2, 1)]
    assert repeated_paragraphs(df.where("false")).count() == 0


def test_bands_reach_the_recall():
    bands, rows = tune_bands(0.75, 0.9995)
    assert 1 - (1 - 0.75 ** rows) ** bands >= 0.9995


def test_cuts_follow_the_content():
    """A passage inside two long lines is cut at the same words, wherever it stands."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(9000)}"
    passage = [word() for _ in range(400)]
    found = []
    for before in (37, 90):
        words = [word() for _ in range(before)] + passage + [word() for _ in range(70)]
        text = " ".join(words)
        starts = {len(text[:a].split()) for _, a, _ in pieces(text)}
        found.append({s - before for s in starts if before + 45 < s < before + 355})
    assert found[0] == found[1] and len(found[0]) >= 4
    assert len(pieces(" ".join(passage[:60]))) == 1
