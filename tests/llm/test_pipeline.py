"""The pipeline's stages against plain versions on the smallest tables."""

import corpus_pipeline as cp
from curatrix.llm.storage import stored

from .brute import near_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    after = []
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, SF), "stage")
        after.append({r.doc_id: r for r in docs.collect()})
        assert docs.count() == len(after[-1])
        if name != "mixing":
            assert docs.columns == cp.DOCUMENT
    fine, one, clear, cut, mix = after
    insults = "trash pathetic idiot disgusting worthless stupid loser scum moron".split()
    assert all(any(w in rows[i].text.lower() for w in insults) for i in set(rows) - set(fine))
    want = near_components([(i, r.text) for i, r in fine.items()])
    assert set(one) == {i for i, (_, c) in want.items() if c == i}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) >= 8]
    assert {i for i, r in one.items() if any(t in r.text for t in items)} <= set(one) - set(clear)
    assert len(one) - len(clear) <= 0.2 * len(one)
    assert set(cut) == set(clear)
    assert all(cut[i].text == clear[i].text or "<" in cut[i].text for i in cut)
    assert all(r.n_chars == len(r.text) for r in cut.values())
    total = sum(len(r.text.split()) for r in cut.values())
    assert abs(sum(r.taken for r in mix.values()) - total) <= 10
    assert set(mix) <= set(cut) and all(mix[i].text == cut[i].text and mix[i].taken > 0 for i in mix)


LONG = "the quiet river runs by the old stone mill and the miller counts his sacks of grain while the rain falls on the hills "


def odd_documents(spark):
    rows = [(1, LONG + "one", "en", "a", None), (2, LONG + "one two", "en", "a", 5), (2, "another text under the same id with enough words of its own", "en", "b", 5),
            (3, LONG + "one", None, None, 5), (3, LONG + "one", None, None, 5), (None, LONG + "one", "en", "a", 5), (None, LONG + "one", "en", "a", 5), (None, None, None, None, None),
            (4, None, "en", "a", 0), (5, "", "en", "a", 0), (5, "", "en", "a", 0), (6, "x " * 30000, "en", None, 60000), (7, "one", "de", "b", 3)]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, component string, kept int")


def test_stages_take_odd_rows_and_extra_columns(spark):
    docs = odd_documents(spark)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns == (cp.DOCUMENT if name != "mixing" else [*cp.DOCUMENT, "taken"])
        rows = out.collect()
        keys = [(r.doc_id, r.text) for r in rows]
        if name == "near duplicates":
            assert sorted(map(str, keys)) == sorted(map(str, [(1, LONG + "one"), (2, "another text under the same id with enough words of its own"), (None, LONG + "one"), (None, LONG + "one"),
                                                              (None, None), (4, None), (5, ""), (6, "x " * 30000), (7, "one")]))
        elif name == "mixing":
            assert all(r.taken > 0 for r in rows) and {r.doc_id for r in rows} <= {1, 2, 3, 6, 7, None}
        else:
            assert sorted(map(str, keys)) == sorted(str((r.doc_id, r.text)) for r in docs.collect()), name


def test_empty_tables(spark):
    docs = odd_documents(spark).where("false")
    for name, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
