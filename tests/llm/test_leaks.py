"""Leaks against all windows and all alignments on small tables."""

import random

from curatrix.llm.decontaminate import contaminated

from .brute import leaks


def sentence(pick, n):
    kinds = (lambda: pick.choice(["runs", "red", "to", "the", "old", "mill", "sees", "a"]), lambda: str(pick.choice([3, 7, 12, "1,5", "$4"])),
             lambda: pick.choice(["Anna", "Émile", "Bo", "Carl,"]), lambda: pick.choice(["km", "hours", "kg."]))
    return " ".join(pick.choices(kinds, (6, 2, 2, 1))[0]() for _ in range(n))


def edited(pick, text):
    words = text.split()
    for _ in range(pick.randrange(4)):
        at = pick.randrange(len(words))
        words[at] = sentence(pick, 1) if pick.random() < 0.3 else {"3": "7", "12": "3", "Anna": "Bo", "km": "hours"}.get(words[at], words[at])
    return " ".join(words)


def test_same_as_all_windows_and_alignments(spark):
    pick = random.Random(8)
    items = [(i, sentence(pick, n)) for i, n in enumerate((1, 2, 3, 4, 5, 7, 8, 9, 12, 20, 30))]
    items += [(20, "3 7 12 3 7 12 3 7 12"), (21, None), (22, " ... "), (23, items[9][1]), (9, "another text of the same item in plain words")]
    docs = [(i, t) for i, (_, t) in enumerate(items)]
    for i in range(60):
        parts = [edited(pick, t) for _, t in pick.sample([x for x in items if x[1] and x[1].strip(" .")], 2)]
        docs.append((100 + i, sentence(pick, 6) + " " + " and so ".join(parts) + " " + sentence(pick, 5)))
    docs += [(300, "xx " * 4000 + items[10][1] + " yy" * 4000), (None, items[9][1]), (301, "3 7 12 3 9 12 3 7 12 3")]
    df = spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in docs], "doc_id long, text string, place int, hash string, covered double")
    rows = contaminated(df, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, windows int")).collect()
    want = leaks(docs, items)
    assert len(want) > 40
    for r in rows:
        own = {i: v for (d, i), v in want.items() if d == r.doc_id}
        assert r.item_ids == sorted(own) and r.leaked == bool(own), (r.doc_id, r.item_ids, own)
        assert r.n_exact == sum(e for _, e in own.values()), (r.doc_id, r, own)
        assert abs(r.covered - max((c for c, _ in own.values()), default=0)) < 1e-12


def test_two_values_that_tie(spark):
    """Of two document values that as many windows hold, the unchanged one counts."""
    item = "in the yard 12 crates stand near the river and then the men load 12 crates on a cart at the mill"
    docs = [(1, item.replace("load 12", "load 15")), (2, item.replace("yard 12", "yard 15")), (3, item.replace("yard 12", "yard 16").replace("load 12", "load 15"))]
    items = [(0, item)]
    got = {r.doc_id: (r.leaked, r.covered) for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = leaks(docs, items)
    assert got == {d: ((d, 0) in want, want.get((d, 0), (0.0,))[0]) for d, _ in docs}
