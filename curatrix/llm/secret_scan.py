"""Secrets in texts, told apart by who owns them: values that many owners share are copied examples, others are live.

Patterns propose spans; the values of all spans are hashed and counted over the whole corpus by distinct repositories and owners. A
value of ``EXAMPLE_OWNERS`` owners or more is an example; one of a single owner that has digits and six different characters looks
live; the rest is shared or weak. Base kinds (assign, access, hex) are always reported; the added ones (signed tokens,
repository tokens, private keys) unless they are examples. A private key is a span from its header to its END line, or over the long
base64 runs after a header without one; its value is the base64 body less line ends, quotes and comment signs, and the header only if nothing follows.

Counting is in two steps of partial aggregation (value, owner, repository; then value), so a value in a third of all texts is a few rows
a task. Null and empty texts have no spans; a null owner or repository counts as one; repeated rows are counted as copies; ids may be null; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.spans import JOINED_SQL, Kind, joined, keeps, number, spans_sql, with_spans
from curatrix.llm.storage import stored

_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"""(?:{_WORDS})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
_VALUE = rf"""(?:{_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
EXAMPLE_OWNERS = 3
_PEM = "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
_CIPHER = r"(?:[\s\\nr]{0,4}+Proc-Type:\x20?4,ENCRYPTED)?+(?:[\s\\nr]{0,4}+DEK-Info:\x20?[A-Z0-9-]++,[0-9A-Fa-f]++)?+"
_PEM_BODY = (rf"""{_PEM}{_CIPHER}(?:[A-Za-z0-9+/=\s\\"',;#*>|.]*+-----END [A-Z ]{{0,30}}PRIVATE KEY-----"""
             r"""|(?:(?:\\[nr]|[\s"',;#*>|.+]){0,12}+[A-Za-z0-9+/]{40,}+={0,2}+){0,400}+)""")


@keeps("assign")
def _assign(v: Column) -> Column:
    return F.length(F.regexp_extract(v, _VALUE, 1)) >= 12


@keeps("access")
def _access(v: Column) -> Column:
    return F.length(v) >= 18


KINDS = [
    Kind("assign", _ASSIGN, _ASSIGN, "assign", f"length(regexp_extract(v, '{_VALUE.replace(chr(39), chr(39) * 2)}', 1)) >= 12", r"t. rlike '[:=]'"),
    Kind("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]+", "access", "length(v) >= 18", "contains(t., 'AKIA')"),
    Kind("hex", r"[0-9a-f]{16,}+", r"[0-9a-f]+", "all", "length(v) >= 16", r"t. rlike '[0-9a-f]{16}'"),
    Kind("signed", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "all", "true",
         "contains(t., 'eyJ')", base=False),
    Kind("repository", r"\bgh[pousr]_[A-Za-z0-9]{20,}", r"\bgh[pousr]_[A-Za-z0-9]{20,}", "all", "true", "contains(t., 'gh')", base=False),
    Kind("pem", _PEM_BODY, _PEM, "all", "true", "contains(t., '-----BEGIN ')", base=False),
]
_BASE = sum(k.base for k in KINDS)
_KEY = [k.name for k in KINDS].index("pem")


def _located(docs: DataFrame, text: str, owner: str, repository: list[str]) -> DataFrame:
    """Rows without texts: doc_id, key, owner, repository and the spans with their secret values hashed."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
                       F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repository]).alias("repository"),
                       F.coalesce(F.col(text), F.lit("")).alias("__text"))
    rows = with_spans(rows, "__text", KINDS, "__spans").drop("__text")

    def secret(s: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(s["value"], rf"^{_PEM}{_CIPHER}|-----END.*", ""), r"""\\[nr]|["']\s*\+\s*["']|[^A-Za-z0-9+/]""", "")
        return F.when(s["rank"] == 0, F.regexp_extract(s["value"], _VALUE, 1)).when((s["rank"] == _KEY) & (body != ""), body).otherwise(s["value"])

    spans = F.transform("__spans", lambda s: F.struct(s["start"], s["rank"], s["end"], F.sha2(secret(s), 256).alias("hash"), (
        secret(s).rlike("[0-9]") & (F.size(F.array_distinct(F.split(secret(s), ""))) >= 6)).alias("rich")))
    return rows.withColumn("spans", spans).drop("__spans")


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, copies, owners, repositories) over the whole corpus of rows (hash, owner, repository)."""
    by_place = spans.groupBy("hash", "owner", "repository").agg(F.count("*").alias("copies"))
    by_owner = by_place.groupBy("hash", "owner").agg(F.sum("copies").alias("copies"), F.count("*").alias("repositories"))
    places = by_place.groupBy("hash", "repository").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("repositories"))
    owners = by_owner.groupBy("hash").agg(F.sum("copies").alias("copies"), F.count("*").alias("owners"))
    return owners.join(places, "hash")


def secrets(docs: DataFrame, text: str = "text", owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Per row of ``docs``: doc_id, __key (xxhash64 of the text) and ``findings``: start, rank, end, hash, copies, owners, repositories, verdict (example, live, shared or weak)."""
    rows = stored(_located(docs, text, owner, list(repository)), "secrets")
    each = rows.where("size(spans) > 0").select("doc_id", "key", "owner", "repository", F.inline("spans"))
    known = ownership(each.select("hash", "owner", "repository"))
    verdict = (F.when(F.col("owners") >= EXAMPLE_OWNERS, "example").when((F.col("owners") == 1) & F.col("rich"), "live")
               .when(F.col("owners") > 1, "shared").otherwise("weak"))
    judged = each.select("doc_id", "key", "start", "rank", "end", "hash", "rich").distinct().join(known, "hash").withColumn("verdict", verdict)
    judged = judged.where((F.col("rank") < _BASE) | (F.col("verdict") != "example"))
    findings = judged.groupBy(F.col("doc_id").alias("id"), "key").agg(
        F.array_sort(F.collect_list(F.struct("start", "rank", "end", "hash", "copies", "owners", "repositories", "verdict"))).alias("findings"))
    found = rows.where("size(spans) > 0").select("doc_id", "key").join(
        findings.withColumnRenamed("key", "k"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")), "left").select("doc_id", F.col("key").alias("__key"), "findings")
    none = rows.where("size(spans) = 0").select("doc_id", F.col("key").alias("__key"), F.lit(None).cast(found.schema["findings"].dataType).alias("findings"))
    return found.unionByName(none).withColumn("findings", F.coalesce("findings", F.array().cast(found.schema["findings"].dataType)))


def digest(docs: DataFrame) -> DataFrame:
    """Per document the counts of the base kinds, the hash of their places, all places, and the numbers of live values and examples."""
    found = secrets(docs)
    counts = [number("findings", "rank", r).alias(f"n_{k.name}") for r, k in enumerate(KINDS) if k.base]
    judged = [number("findings", "verdict", v).alias(f"n_{v}") for v in ("live", "example")]
    plain = F.filter("findings", lambda s: s["rank"] < _BASE)
    return found.select("doc_id", *counts, F.sha2(joined(plain, KINDS), 256).alias("base_sha256"), joined(F.col("findings"), KINDS).alias("spans"), *judged)


_SECRET = f"CASE rank WHEN 0 THEN regexp_extract(v, '{_VALUE.replace(chr(39), chr(39) * 2)}', 1) ELSE v END"


def digest_sql(table: str = "documents") -> str:
    return f"""WITH {spans_sql(KINDS, table)}, named AS (SELECT s.*, {_SECRET} AS value, coalesce(t.source, '') AS owner, coalesce(t.source, '') || '/' || coalesce(t.lang, '') AS repository
FROM spans s JOIN t USING (rid)),
known AS (SELECT value, count(DISTINCT owner) AS owners FROM named GROUP BY value),
judged AS (SELECT n.*, CASE WHEN owners >= {EXAMPLE_OWNERS} THEN 'example' WHEN owners = 1 AND regexp_matches(value, '[0-9]') AND len(list_distinct(string_split(value, ''))) >= 6 THEN 'live'
WHEN owners > 1 THEN 'shared' ELSE 'weak' END AS verdict FROM named n JOIN known USING (value)),
found AS (SELECT * FROM judged WHERE rank < {_BASE} OR verdict != 'example')
SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE rank = {r}) AS n_{k.name}" for r, k in enumerate(KINDS) if k.base)},
sha256({JOINED_SQL.format(filter=f' FILTER (WHERE rank < {_BASE})')}) AS base_sha256, {JOINED_SQL.format(filter='')} AS spans,
count(*) FILTER (WHERE verdict = 'live') AS n_live, count(*) FILTER (WHERE verdict = 'example') AS n_example
FROM t LEFT JOIN found USING (rid) GROUP BY rid, doc_id"""


def without_live(docs: DataFrame, text: str = "text", owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """All rows of ``docs``; spans that look live are replaced by ``<kind>`` in ``text``, all else stays as it is."""
    found = secrets(docs, text, owner, repository).select(
        F.col("doc_id").alias("__id"), F.filter("findings", lambda s: s["verdict"] == "live").alias("__live"), "__key")
    found = found.where("size(__live) > 0").dropDuplicates(["__id", "__key"])
    match = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("__key"))
    names = F.array(*[F.lit(f"<{k.name}>") for k in KINDS])
    apart = F.aggregate("__live", F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>"), lambda a, s: F.when(
        s["start"] < F.coalesce(F.try_element_at(a, F.lit(-1))["end"], F.lit(0)), a).otherwise(
        F.concat(a, F.array(F.struct(s["start"], s["rank"].cast("int").alias("rank"), s["end"])))))  # of spans that overlap, the first
    body = F.col(text)
    pieces = F.transform("__cut", lambda s, i: F.concat(
        F.substr(body, (F.when(i == 0, F.lit(0)).otherwise(F.get("__cut", i - 1)["end"]) + 1).cast("int"),
                 (s["start"] - F.when(i == 0, F.lit(0)).otherwise(F.get("__cut", i - 1)["end"])).cast("int")), F.get(names, s["rank"])))
    rest = F.substr(body, (F.element_at("__cut", -1)["end"] + 1).cast("int"))
    out = docs.join(found, match, "left").withColumn("__cut", F.when(F.col("__live").isNotNull(), apart))
    return out.withColumn(text, F.when(F.col("__cut").isNotNull(), F.concat(F.array_join(pieces, ""), rest)).otherwise(body)).select(*docs.columns)
