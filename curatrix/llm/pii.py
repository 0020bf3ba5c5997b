"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score.

Email, ip, card and phone are base kinds, found whatever stands around them; IBANs (mod 97) and social security numbers are
added if their score, moved by the words within 40 characters, reaches ``threshold``. Null and empty texts have no spans, rows are judged one
by one (so repeats are repeated, ids may be null), extra columns are ignored unless they are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.spans import JOINED_SQL, Kind, joined, keeps, number, spans_sql, with_spans

_DIGITS = "translate(v, '+ ().-', '')"


@keeps("ip")
def _ip(v: Column) -> Column:
    return ~F.exists(F.split(v, "[.]"), lambda p: ~p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


@keeps("card")
def _card(v: Column) -> Column:
    digits = F.translate(v, " -", "")
    return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)


@keeps("phone")
def _phone(v: Column) -> Column:
    return F.length(F.translate(v, "+ ().-", "")).between(9, 15)


@keeps("iban")
def _iban(v: Column) -> Column:
    code = F.translate(v, " ", "")
    moved = F.split(F.concat(F.substr(code, F.lit(5)), F.left(code, F.lit(4))), "")
    rest = F.aggregate(moved, F.lit(0), lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).when(
        c.between("A", "Z"), (a * 100 + F.ascii(c) - 55) % 97).otherwise(a))
    return F.length(code).between(15, 34) & (rest == 1)


_LUHN = ("list_sum(list_transform(range(length({d})), lambda k: CASE WHEN k % 2 = 0 THEN substr({d}, length({d}) - k, 1)::INT "
         "ELSE (2 * substr({d}, length({d}) - k, 1)::INT) // 10 + (2 * substr({d}, length({d}) - k, 1)::INT) % 10 END)) % 10 = 0")
_CARD = "translate(v, ' -', '')"
_CODE = "(substr(replace(v, ' ', ''), 5) || left(replace(v, ' ', ''), 4))"
_MOD = (f"list_reduce(list_prepend(0, list_transform(range(length({_CODE})), lambda k: ascii(substr({_CODE}, k + 1, 1)))), "
        "lambda a, c: CASE WHEN c < 58 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END) = 1")

KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "all", "true", "contains(t., '@')", score=0.8,
         context="mail|contact|write|courriel|correo|kontakt", against="example|test"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "ip",
         "list_bool_and(list_transform(string_split(v, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(nullif(ltrim(p, '0'), '') AS INT), 0) <= 255))",
         r"t. rlike '[0-9][.][0-9]'", score=0.6, context="ip|address|host|server|login|adresse", against="version|release|section|chapter"),
    Kind("card", r"(?<![0-9])(?=(?:[0-9][ -]?){12})[0-9]++(?:[ -][0-9]++)*+", r"[0-9](?:[ -]?[0-9])+", "card",
         f"length({_CARD}) BETWEEN 12 AND 19 AND {_LUHN.format(d=_CARD)}", r"t. rlike '(?:[0-9][ -]?){12}'", score=0.8,
         context="card|visa|credit|payment|karte|carte|tarjeta", against="order|isbn|serial|tracking"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", "phone", f"length({_DIGITS}) BETWEEN 9 AND 15",
         "contains(t., '+')", score=0.6, context="phone|call|tel|mobile|fax|anruf|appel", against="order|version"),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", "iban",
         f"length(replace(v, ' ', '')) BETWEEN 15 AND 34 AND {_MOD}", r"t. rlike '[A-Z]{2}[0-9]{2}'", base=False, score=0.8,
         context="iban|account|bank|konto|compte|cuenta", against="order|serial"),
    Kind("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "all", "true", r"t. rlike '[0-9]{3}-[0-9]{2}-[0-9]{4}'",
         base=False, score=0.3, context="ssn|social security|taxpayer", against="order|phone|part"),
]
THRESHOLD = 0.5
RAISE, LOWER = 0.15, 0.25


def _score(s: Column) -> Column:
    near = F.concat_ws(" ", s["before"], s["after"])
    out = F.lit(0.0)
    for rank, k in enumerate(KINDS):
        raised = F.lit(k.score) + F.when(near.rlike(k.context), F.lit(0.3 if k.name == "ssn" else RAISE)).otherwise(F.lit(0.0))
        out = F.when(s["rank"] == rank, F.round(raised - F.when(near.rlike(k.against), F.lit(LOWER)).otherwise(F.lit(0.0)), 2)).otherwise(out)
    return out


def personal_data(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default doc_id) and ``findings``: start, rank, end, value, score of every span, by start, then kind."""
    rows = docs.select(*(keep or ["doc_id"]), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    rows = with_spans(rows, "__text", KINDS, "__spans").drop("__text")
    scored = F.transform("__spans", lambda s: F.struct(s["start"], s["rank"], s["end"], s["value"], _score(s).alias("score")))
    base = sum(k.base for k in KINDS)
    return rows.withColumn("findings", F.filter(scored, lambda s: (s["rank"] < base) | (s["score"] >= threshold))).drop("__spans")


def digest(docs: DataFrame) -> DataFrame:
    """Per document the counts of the base kinds, the hash of their places, all places, and the mean score."""
    found = personal_data(docs)
    base = sum(k.base for k in KINDS)
    counts = [number("findings", "rank", r).alias(f"n_{k.name}") for r, k in enumerate(KINDS) if k.base]
    plain = F.filter("findings", lambda s: s["rank"] < base)
    return found.select("doc_id", *counts, F.sha2(joined(plain, KINDS), 256).alias("base_sha256"), joined(F.col("findings"), KINDS).alias("spans"),
                        F.round(F.aggregate("findings", F.lit(0.0), lambda a, s: a + s["score"]), 2).alias("score_sum"))


def _score_sql() -> str:
    near = "(before || ' ' || after)"
    cases = " ".join(f"WHEN {r} THEN round({k.score} + CASE WHEN regexp_matches({near}, '{k.context}') THEN {0.3 if k.name == 'ssn' else RAISE} ELSE 0 END"
                     f" - CASE WHEN regexp_matches({near}, '{k.against}') THEN {LOWER} ELSE 0 END, 2)" for r, k in enumerate(KINDS))
    return f"CASE rank {cases} END"


_BASE = sum(k.base for k in KINDS)
SQL = f"""WITH {spans_sql(KINDS)}, scored AS (SELECT *, ({_score_sql()})::DOUBLE AS score FROM spans),
found AS (SELECT * FROM scored WHERE rank < {_BASE} OR score >= {THRESHOLD})
SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE rank = {r}) AS n_{k.name}" for r, k in enumerate(KINDS) if k.base)},
sha256({JOINED_SQL.format(filter=f' FILTER (WHERE rank < {_BASE})')}) AS base_sha256, {JOINED_SQL.format(filter='')} AS spans, round(coalesce(sum(score), 0), 2) AS score_sum
FROM t LEFT JOIN found USING (rid) GROUP BY rid, doc_id"""
