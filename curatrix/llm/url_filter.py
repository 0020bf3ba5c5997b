"""URL filter: host and path rules first, then a ratio of two character language models.

Rules: a rule fits its host and all subdomains if the path starts with the rule's path; the longest fitting rule wins (of equal
length, blocking ones). What rules allow and block trains two variable-order Markov models of characters: contexts of three, two, one
and no characters, each mixed with the next shorter one by the number of different followers (Witten-Bell), the last with equal chances.
A URL's score is the mean over its characters of log P(allowed) - log P(blocked); the cut is where the rule-judged URLs
are separated with the least balanced error, in the middle of the gap there.

Characters are folded to a closed alphabet of ``ALPHABET`` (a-z, one digit sign, punctuation, one sign for the rest), so there are at most
39 ** 4 different 4-grams whatever the input; URLs that fold alike are counted and scored once. Counts cover all rows.

A null url, or one without ``://``, has an empty host and path and fits no rule; the models judge what text there is. Repeated rows are
judged each, ids may be null, extra columns are ignored; if no rule judges anything, scores are 0 and the rest is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.storage import stored

ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.-_?=&#:%^$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_SCALE = 1_000_000
_BINS = 1000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def _ordered(rules: tuple[Rule, ...]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text))


def host_and_path(url: Column) -> tuple[Column, Column]:
    some = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(some, _PARTS, 1), _UPPER, _LOWER), F.regexp_extract(some, _PARTS, 2)


def _first_rule(rules: tuple[Rule, ...], value) -> Column:
    out = F.lit(None).cast("string")
    for r in reversed(_ordered(rules)):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def folded(url: Column) -> Column:
    """The url in the closed alphabet, with three start signs and an end sign."""
    text = F.translate(F.coalesce(url, F.lit("")), _UPPER + "123456789^$", _LOWER + "0" * 9 + "%%")
    return F.concat(F.lit("^^^"), F.regexp_replace(text, r"[^a-z0/.\-_?=&#:%]", "%"), F.lit("$"))


def _grams(urls: DataFrame) -> DataFrame:
    return urls.withColumn("gram", F.explode(F.transform(F.sequence(F.lit(1), F.length("folded") - 3), lambda i: F.substr("folded", i, F.lit(4)))))


def _mixed_with(counts: DataFrame, shorter: DataFrame | None) -> DataFrame:
    """(gram, pa, pr): chances of the last character after the ones before it, mixed with those of the gram without its first."""
    context = Window.partitionBy(F.expr("left(gram, length(gram) - 1)"))
    if shorter is None:
        rows = counts.withColumns({"qa": F.lit(1.0 / len(ALPHABET)), "qr": F.lit(1.0 / len(ALPHABET))})
    else:
        rows = counts.withColumn("tail", F.expr("substr(gram, 2)")).join(
            shorter.select(F.col("gram").alias("tail"), F.col("pa").alias("qa"), F.col("pr").alias("qr")), "tail")

    def chance(n: str, q: str) -> Column:
        total, kinds = F.sum(n).over(context), F.sum((F.col(n) > 0).cast("long")).over(context)
        return F.when(total > 0, (F.col(n) + kinds * F.col(q)) / (total + kinds)).otherwise(F.col(q))

    return rows.select("gram", chance("a", "qa").alias("pa"), chance("r", "qr").alias("pr"))


def gram_ratios(urls: DataFrame) -> DataFrame:
    """(gram, ratio) of every 4-gram of (folded, label, n); the ratio of log chances is in millionths."""
    four = stored(_grams(urls).groupBy("gram").agg(F.sum(F.when(F.col("label") == "allow", F.col("n")).otherwise(0)).alias("a"),
                                                   F.sum(F.when(F.col("label") == "block", F.col("n")).otherwise(0)).alias("r")), "grams")
    model = None
    for size in (1, 2, 3, 4):
        counts = four if size == 4 else four.groupBy(F.expr(f"right(gram, {size})").alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        model = _mixed_with(counts, model)
    return stored(model.select("gram", F.round((F.ln("pa") - F.ln("pr")) * _SCALE).cast("long").alias("ratio")), "ratios")


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url") -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict, score (mean log ratio; positive speaks for allowed) and cut."""
    host, path = host_and_path(F.col(url))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), folded(F.col(url)).alias("folded"))
    rows = rows.withColumn("rule", _first_rule(rules, lambda r: r.text)).withColumn("label", _first_rule(rules, lambda r: r.verdict))
    rows = stored(rows, "urls")
    urls = stored(rows.groupBy("folded", "label").agg(F.count("*").alias("n")), "folded")
    ratios = gram_ratios(urls)
    scores = stored(_grams(urls.select("folded").distinct()).join(ratios, "gram").groupBy("folded").agg(
        F.round(F.sum("ratio") / F.count("*")).cast("long").alias("score")), "scores")
    known = urls.where("label is not null").join(scores, "folded").groupBy(
        F.greatest(F.lit(-_BINS), F.least(F.lit(_BINS), F.floor(F.col("score") / 10_000))).cast("long").alias("bin")).agg(
        F.sum(F.when(F.col("label") == "allow", F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == "block", F.col("n")).otherwise(0)).alias("r"))
    below, everything = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()  # 2001 rows at most

    def share(n: str, window) -> Column:
        return F.coalesce(F.sum(n).over(window), F.lit(0)) / F.greatest(F.lit(1), F.sum(n).over(everything))

    middle = F.floor((F.coalesce(F.max("bin").over(below) + 1, F.col("bin")) + F.col("bin")) / 2)
    wrong = known.select("bin", middle.alias("middle"), F.round(share("a", below) + 1 - share("r", below), 9).alias("wrong"))
    cut = wrong.agg(F.coalesce(F.min_by("middle", F.struct("wrong", "bin")), F.lit(0)).alias("cut"))
    limit = cut.first()["cut"] * 10_000
    out = rows.join(scores, "folded", "left")
    method = F.when(F.col("score") >= limit, "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("label", method).alias("verdict"), (F.col("score") / _SCALE).alias("score"), F.lit(limit / _SCALE).alias("cut"))


def _case_sql(rules: tuple[Rule, ...], value) -> str:
    whens = " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{value(r)}'" for r in _ordered(rules))
    return f"CASE {whens} END"


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The rows of ``judged`` in DuckDB SQL, over all rows one by one."""
    steps, lower = [], None
    for size in (1, 2, 3, 4):
        q = "1.0 / %d" % len(ALPHABET)
        join, qa, qr = ("", q, q) if lower is None else (f" JOIN m{size - 1} s ON s.gram = substr(c.gram, 2)", "s.pa", "s.pr")
        steps.append(f"""m{size} AS (SELECT gram, CASE WHEN ta > 0 THEN (a + ka * qa) / (ta + ka) ELSE qa END AS pa, CASE WHEN tr > 0 THEN (r + kr * qr) / (tr + kr) ELSE qr END AS pr FROM (
SELECT c.gram, a, r, {qa} AS qa, {qr} AS qr, sum(a) OVER w AS ta, sum(r) OVER w AS tr, count(*) FILTER (WHERE a > 0) OVER w AS ka, count(*) FILTER (WHERE r > 0) OVER w AS kr
FROM (SELECT right(gram, {size}) AS gram, sum(a)::DOUBLE AS a, sum(r)::DOUBLE AS r FROM four GROUP BY 1) c{join} WINDOW w AS (PARTITION BY left(c.gram, {size - 1}))))""")
        lower = size
    return f"""WITH u AS (SELECT row_number() OVER () AS rid, page_id, translate(regexp_extract(coalesce(url, ''), '{_PARTS}', 1), '{_UPPER}', '{_LOWER}') AS host,
regexp_extract(coalesce(url, ''), '{_PARTS}', 2) AS path, '^^^' || regexp_replace(translate(coalesce(url, ''), '{_UPPER}123456789^$', '{_LOWER}{'0' * 9}%%'), '[^a-z0/.\\-_?=&#:%]', '%', 'g') || '$' AS folded FROM pages),
p AS (SELECT *, {_case_sql(rules, lambda r: r.text)} AS rule, {_case_sql(rules, lambda r: r.verdict)} AS label FROM u),
g AS (SELECT rid, label, substr(folded, i::INT, 4) AS gram FROM (SELECT rid, label, folded, unnest(range(1, length(folded) - 2)) AS i FROM p)),
four AS (SELECT gram, count(*) FILTER (WHERE label = 'allow') AS a, count(*) FILTER (WHERE label = 'block') AS r FROM g GROUP BY gram),
{', '.join(steps)},
ratios AS (SELECT gram, round((ln(pa) - ln(pr)) * {_SCALE})::BIGINT AS ratio FROM m4),
scored AS (SELECT rid, round(sum(ratio)::DOUBLE / count(*))::BIGINT AS score FROM g JOIN ratios USING (gram) GROUP BY rid),
bins AS (SELECT greatest(-{_BINS}, least({_BINS}, floor(score / 10000.0)))::BIGINT AS bin, count(*) FILTER (WHERE label = 'allow') AS a, count(*) FILTER (WHERE label = 'block') AS r
FROM p JOIN scored USING (rid) WHERE label IS NOT NULL GROUP BY 1),
wrong AS (SELECT bin, floor((coalesce(max(bin) OVER b + 1, bin) + bin) / 2.0)::BIGINT AS middle, round(coalesce(sum(a) OVER b, 0) / greatest(1, sum(a) OVER ()) + 1 - coalesce(sum(r) OVER b, 0) / greatest(1, sum(r) OVER ()), 9) AS wrong FROM bins WINDOW b AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT coalesce((SELECT middle FROM wrong ORDER BY wrong, bin LIMIT 1), 0) * 10000 AS cut)
SELECT page_id, host, path, rule, coalesce(label, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict, score / {_SCALE}.0 AS score, cut / {_SCALE}.0 AS cut
FROM p JOIN scored USING (rid), cut"""
