from curatrix.llm.decontaminate import clean, contaminated

ITEM = "Alice buys 12 red apples and 5 green pears for 30 dollars, so how many fruits does Alice carry home today?"
OTHER = "Bruno buys 40 red apples and 7 green pears for 90 euros, so how many fruits does Bruno carry home today?"
TORN = "Bruno buys 40 red apples and 7 green pears for 90 euros, so how many fruits does Carla carry home today?"
LEAD = "it was a long day in the hills and nobody said a word "


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string, id int")
    b = spark.createDataFrame(items, "item_id long, text string, key string")
    return {r.doc_id: r for r in contaminated(d, b).collect()}, d, b


def test_exact_and_reparameterised_leaks(spark):
    docs = [(1, LEAD + ITEM + " " + LEAD), (2, LEAD + OTHER), (3, LEAD * 5), (4, None), (5, ""), (6, LEAD + TORN), (7, ITEM.upper() + " x")]
    docs = [(i, t, "clash", 3) for i, t in docs]
    got, d, b = run(spark, docs, [(0, ITEM, "x"), (9, ITEM, "y"), (1, None, "z"), (2, "", ""), (3, "a day", "")])
    assert {i for i, r in got.items() if r.leaked} >= {1, 2} and not {3, 4, 5} & {i for i, r in got.items() if r.leaked}
    assert got[1].item_ids == [0, 9] and got[1].n_exact == 2 and got[1].covered == 1.0
    assert got[2].n_items == 2 and got[2].n_exact == 0
    assert not got[6].leaked or got[6].covered < 1
    kept = {r.doc_id for r in clean(d, b).collect()}
    assert kept == {i for i, r in got.items() if not r.leaked}
    assert clean(d, b).columns == d.columns


def test_inconsistent_slots_do_not_count(spark):
    words = "the sum of 5 and 5 is asked when 5 boys meet 5 girls at noon"
    wrong = "the sum of 7 and 8 is asked when 9 boys meet 6 girls at noon"
    right = "the sum of 7 and 7 is asked when 7 boys meet 7 girls at noon"
    got, _, _ = run(spark, [(1, wrong, "", 0), (2, right, "", 0)], [(0, words, "")])
    assert not got[1].leaked and got[2].leaked and got[2].n_exact == 0


def test_empty_tables_repeated_rows_and_null_ids(spark):
    docs = [(1, ITEM, "", 0), (1, ITEM, "", 0), (None, ITEM, "", 0)]
    got, d, b = run(spark, docs, [(0, ITEM, "")])
    assert got[None].leaked and got[1].leaked and contaminated(d, b).count() == 3
    assert contaminated(d.where("false"), b).count() == 0
    assert [r.leaked for r in contaminated(d, b.where("false")).collect()] == [False] * 3
    assert clean(d, b.where("false")).count() == 3


def test_planted_passages(spark):
    """Every document that quotes a whole item is caught, and all that is caught shares its words."""
    sf = "/root/testdata/sf0.001"
    d, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [r.text for r in b.collect() if len(r.text.split()) >= 8]
    want = {r.doc_id for r in d.collect() if any(t in r.text for t in items)}
    got = {r.doc_id for r in contaminated(d, b).where("leaked").collect()}
    assert want <= got and len(got - want) <= 0.02 * d.count()
