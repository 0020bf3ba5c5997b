"""A stage of op3 runs one Python function: each further one would be a worker of its own beside it in every task."""

from curatrix.llm import paragraphs


def test_no_key_of_a_bitmap_passes_two_python_functions(spark, monkeypatch):
    seen, plain = [], paragraphs.bitmap

    def watched(keys, column, bits):
        seen.append(keys._jdf.queryExecution().executedPlan().toString().count("MapInArrow"))
        return plain(keys, column, bits)

    monkeypatch.setattr(paragraphs, "bitmap", watched)
    words = [f"w{i}" for i in range(120)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "x y z " + " ".join(words[10:80])), (3, "one line of its own")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in paragraphs.repeated_paragraphs(docs).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] > 0 and got[3]["n_removed"] == 0
    assert seen and max(seen) == 1
