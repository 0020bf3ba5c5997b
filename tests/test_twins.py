"""Series twins against all pairs, and how few pairs meet with all their words."""

import random

import pytest

from curatrix.operators import joins


def titles(n, seed):
    pick = random.Random(seed)
    words = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(60)]
    rows = []
    for i in range(n):
        if i % 4 == 3:
            own = rows[pick.randrange(len(rows))][1].split()
            own[pick.randrange(len(own))] = pick.choice(words)
        else:
            own = [pick.choice(words[:pick.choice([8, 25, 60])]) for _ in range(pick.choice([2, 3, 5, 9, 14, 30]))]
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("sure", [1, 6, 50])
@pytest.mark.parametrize("shared,share", [(2, 0.7), (3, 0.5)])
def test_twins_equal_all_pairs(spark, monkeypatch, sure, shared, share):
    monkeypatch.setattr(joins, "SURE_WORDS", sure)
    rows = titles(160, 5)
    sets = {}
    for i, name in rows:
        sets.setdefault(frozenset(name.split()), i)
    want = set()
    for a, i in sets.items():
        for b, j in sets.items():
            if i < j and len(a) >= shared and len(b) >= shared and len(a & b) >= shared and len(a & b) / max(len(a), len(b)) > share:
                want.add((i, j, len(a & b)))
    got = {tuple(r) for r in joins.series_twins(spark.createDataFrame(rows, "appid long, name string"), shared, share).collect()}
    assert got == want and want


def test_sets_that_share_one_rare_word_do_not_meet_with_all_words(spark):
    rows = [(i, f"rare {' '.join(f'w{i}x{j}' for j in range(20))}".replace("0", "a").replace("1", "b").replace("2", "c").replace("3", "d").replace("4", "e").replace("5", "f").replace("6", "g").replace(
        "7", "h").replace("8", "i").replace("9", "j")) for i in range(40)]
    found = joins.series_twins(spark.createDataFrame(rows, "appid long, name string"))
    assert found.count() == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in plan and "AS sure#" in plan
