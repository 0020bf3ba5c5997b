import random
import zlib

import numpy as np

from curatrix.llm.toxicity import monotone, segments, toxicity


def maximal(scores):
    """All maximal scoring segments by their definition: take the best segment, then the same left and right of it."""
    best, at = 0.0, None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            total = sum(scores[i:j])
            if total > best + 1e-9 or at and abs(total - best) <= 1e-9 and j - i < at[1] - at[0] and i >= at[0] and j <= at[1]:
                best, at = total, (i, j)
    if at is None:
        return []
    left = maximal(scores[:at[0]])
    right = [(a + at[1], b + at[1], s) for a, b, s in maximal(scores[at[1]:])]
    return [*left, (*at, best), *right]


def test_segments_equal_the_definition():
    rng = random.Random(3)
    for _ in range(200):
        scores = [rng.uniform(-1, 1) for _ in range(rng.randrange(0, 14))]
        got = segments(np.array(scores, float))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in maximal(scores)]
        assert all(abs(s - sum(scores[a:b])) < 1e-9 for a, b, s in got)


def test_monotone():
    curve = monotone(np.array([0, 3, 1, 9.0]), np.array([9, 1, 5, 0.0]))
    assert (np.diff(curve) >= 0).all() and 0 <= curve[0] < 0.2 and curve[-1] > 0.9


def fixture(n=600):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(300)]
    docs, toxic = [], {}
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(30, 200))]
        toxic[i] = int(i % 5 == 0)
        if toxic[i]:
            for _ in range(rng.randrange(2, 6)):
                text.insert(rng.randrange(len(text)), rng.choice(["vile", "Nasty", "foul", "rotten"]))
        docs.append((i, " ".join(text), "l", "s", 1.5))
    return docs, toxic


def test_held_out_texts_and_odd_rows(spark):
    docs, toxic = fixture()
    odd = [(9001, None, "l", "s", 0.0), (9002, "", "l", "s", 0.0), (9003, "vile " * 5000, "l", "s", 0.0), (None, "nasty foul vile", "l", "s", 0.0), (5, docs[5][1], "l", "s", 0.0)]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string, source string, score double")
    labels = spark.createDataFrame([(i, 1, t) for i, t in toxic.items()] + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity(df, labels).collect()
    assert len(rows) == len(docs) + len(odd)
    got = {r.doc_id: r for r in rows}
    for i, t in toxic.items():
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        if got[i].held_out:
            assert got[i].predicted == t
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert got[9001].score == got[9002].score == min(r.score for r in rows) and got[9003].predicted == got[None].predicted == 1
    assert got[9003].passages[0].first_word == 0 and got[9003].passages[0].end_word == 5000
    again = {r.doc_id: r.score for r in toxicity(df, labels).collect()}
    assert again == {i: r.score for i, r in got.items()}
    assert toxicity(df.where("false"), labels).count() == 0
    assert {r.predicted for r in toxicity(df, labels.where("false")).collect()} == {0}
