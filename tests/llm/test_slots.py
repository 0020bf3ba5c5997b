"""Leaks whose slot values coincide or were edited in one place."""

from curatrix.llm.decontaminate import contaminated

ITEM = "a farmer owns 12 cows and 7 goats on the hill and he sells 3 of them to a neighbour in the next village before winter"
LEAD = "it was a long day in the hills and nobody said a word "


def run(spark, texts, item):
    docs = spark.createDataFrame(list(enumerate(LEAD + t for t in texts)), "doc_id long, text string")
    return {r.doc_id: r for r in contaminated(docs, spark.createDataFrame([(0, item)], "item_id long, text string")).collect()}


def test_different_values_may_coincide(spark):
    redrawn = ITEM.replace("12", "8").replace(" 7 ", " 8 ").replace(" 3 ", " 5 ")
    got = run(spark, [redrawn, ITEM], ITEM)
    assert got[0].leaked and got[0].covered == 1.0 and got[0].n_exact == 0 and got[1].n_exact == 1


def test_an_edited_occurrence_costs_its_windows_only(spark):
    item = "on monday 12 crates stand in the yard of the old mill near the river and in the evening a driver takes all 12 crates to town"
    edited = item.replace("all 12", "all 15")
    windows = len(item.split()) - 7  # 3 of them hold the first 12, 4 the second
    got = run(spark, [edited, item.replace("12", "15")], item)
    assert got[0].leaked and got[0].n_exact == 0 and got[0].covered == (windows - 3) / windows
    assert got[1].leaked and got[1].covered == 1.0
