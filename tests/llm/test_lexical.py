"""Lexical search against a plain ranking of all documents."""

import math
import random
import re
from collections import Counter

import pytest

from curatrix.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS, ITEMS = "doc_id long, text string, score string, term int", "item_id long, text string, bundle int"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    held, total = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    asked = {}
    for i, t in set(items):
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        found = []
        for i, c, n in counts:
            m = 25 + (75 * n * held) // total
            score = sum(r * math.floor(1000 * math.log((2 * held + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t, r in wanted.items() if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, **kw):
    out = lexical.ranked(spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS), spark.createDataFrame([(i, t, 2) for i, t in items], ITEMS), **kw)
    return sorted((tuple(r) for r in out.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(seed, documents=150, items=9):
    pick = random.Random(seed)
    words = [f"w{j}" for j in range(60)] + ["é", "É", "Straße", "ab", "AB"]
    weights = [1 / (j + 1) for j in range(len(words))]

    def text(n):
        return " ,-".join(pick.choices(words, weights, k=n))

    docs = [(i, text(pick.randint(0, 40))) for i in range(documents)]
    docs += [(1000 + j, docs[3][1]) for j in range(40)] + [(None, docs[3][1]), (5, "w1 w2"), (5, "w1 w2"), (6, None), (7, ""), (8, "!? -"), (9, "w50 " * 3000)]
    asked = [(j, text(pick.randint(0, 12)) + " w59 w3 w3") for j in range(items)]
    asked += [asked[0], (1, "w7 w8"), (None, "w4"), (20, None), (21, "never"), (22, docs[3][1])]
    return docs, asked


@pytest.mark.parametrize("shard, held, bundle, owners", [(8192, 1 << 20, 64, lexical.OWNERS), (13, 1 << 20, 3, (0.02, 0.1, 0.3, 1.0)), (8192, 50, 1, (0.0, 1.0))])
def test_equals_a_plain_ranking(spark, monkeypatch, shard, held, bundle, owners):
    monkeypatch.setattr(lexical, "BUNDLE", bundle)
    docs, items = corpus(11)
    assert found(spark, docs, items, owners=owners, shard=shard, held=held) == brute(docs, items, 10)


def test_few_documents_and_small_k(spark):
    docs, items = corpus(12, 12, 4)
    assert found(spark, docs, items, k=3) == brute(docs, items, 3)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == found(spark, [(1, "a")], []) == found(spark, [(1, None)], [(1, "a")]) == []


def test_hash_filter_may_err_on_the_safe_side(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BITS", 64)
    docs, items = corpus(13, 40, 5)
    assert found(spark, docs, items) == brute(docs, items, 10)
