"""Private keys are spans with their body, judged by it and cut."""

import random
import string

from curatrix.llm import secret_scan


def body(seed, n=26):
    rng = random.Random(seed)
    return ["".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(64)) for _ in range(n)] + ["Ab3=="]


def key(lines, kind="RSA ", end="\n", last=True):
    return end.join([f"-----BEGIN {kind}PRIVATE KEY-----", *lines] + [f"-----END {kind}PRIVATE KEY-----"] * last)


def test_keys_are_judged_by_their_bodies_and_cut(spark):
    shared, cipher = key(body(1)), ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF", ""]
    own = [key(body(2)), key(body(3), ""), key(cipher + body(4)), key(body(5), end="\\n"), key(body(6), end='\\n" +\n  "'), key(body(7)[:-1], "EC ", last=False), key(body(8, 400))]
    rows = [(i, f"é see {shared} end", f"s{i}", "en") for i in range(4)] + [(10 + i, f"é see {k} end", f"s{i % 5}", "en") for i, k in enumerate(own)]
    rows += [(30, "the line -----BEGIN PRIVATE KEY----- stands first, 2 of them here", "s1", "en"), (31, "-----BEGIN PRIVATE KEY-----" + " a1-" * 30000, "s2", "en"),
             (32, "-----BEGIN PRIVATE KEY-----\n" * 2000, "s3", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    found = {r.doc_id: r.findings for r in secret_scan.secrets(df).collect()}
    assert all(not found[i] for i in range(4))  # the same key of four owners is an example
    cut = {r.doc_id: r.text for r in secret_scan.without_live(df).collect()}
    for i, k in enumerate(own):
        assert [(f.verdict, f.start, f.end) for f in found[10 + i]] == [("live", 6, 6 + len(k))]
        assert cut[10 + i] == "é see <pem> end"
    assert [cut[i] for i in (0, 30, 31, 32)] == [rows[0][1], *(t for _, t, *_ in rows[-3:])]


def test_one_body_in_two_layouts_is_one_value(spark):
    rows = [(1, key(body(9)), "s1", "en"), (2, key(body(9), end="\\n"), "s2", "en"), (3, key(body(9), end='\\n" +\n"'), "s3", "en")]
    assert [r.findings for r in secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()] == [[]] * 3
