from curatrix.llm.url_filter import judged

URLS = [None, "", "no scheme", "http://EXAMPLE.org/es/1", "https://www.example.org/en/12?x", "https://example.org/en/2", "http://notexample.org/es/1", "ftp://a.com/fr/x#y", "http://com/de/",
        "http://a.com?/fr/", "x://y.org", "http://b.net/shop/1", "http://a.ORG/é", "a://b://c.org/", "http://org#/", "http://evil.com/de/spam", "http://evil.com.net/de/spam"]


def test_rules_and_parts(spark):
    df = spark.createDataFrame([(i, u, "x", None) for i, u in enumerate(URLS)] + [(3, URLS[3], "x", None), (None, URLS[3], "x", None)], "page_id long, url string, host string, label string")
    got = {r.page_id: r for r in judged(df).collect()}
    assert judged(df).count() == len(URLS) + 2
    rule = {i: r.rule for i, r in got.items() if i is not None}
    assert [rule[i] for i in range(len(URLS))] == [None, None, None, "example.org/es/", "example.org/en/1", "org/", "org/", "com/fr/", "com/de/", None, None, None, "org/", None, None, "com/de/", None]
    assert (got[0].host, got[0].path, got[3].host, got[9].path, got[13].host, got[10].path) == ("", "", "example.org", "", "b:", "")
    assert got[3].verdict == "block" and got[5].verdict == "allow" and {r.verdict for r in got.values()} == {"allow", "block"}
    assert judged(df.where("false")).count() == 0
    assert {r.verdict for r in judged(df.where("page_id = 11")).collect()} == {"allow"}


def test_model_separates_unseen_urls(spark):
    good = [f"http://site{i}.com/fr/article-{i}" for i in range(40)]
    bad = [f"http://pills{i}.com/de/buy-now-{i}" for i in range(40)]
    unseen = ["http://site77.com/xx/article-9", "http://pills99.com/xx/buy-now-7"]
    df = spark.createDataFrame(list(enumerate(good + bad + unseen)), "page_id long, url string")
    got = {r.page_id: (r.verdict, r.score) for r in judged(df).collect()}
    assert got[80][0] == "allow" and got[81][0] == "block" and got[80][1] > 0 > got[81][1]
