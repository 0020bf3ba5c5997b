"""Text, date and price columns, filters and flags."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from curatrix.checks.registry import check
from curatrix.functions import dates, money, text
from curatrix.operators import filters, language, normalize

AS_OF, NOW = dt.date(1999, 1, 1), dt.datetime(1999, 1, 1)


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def entity_sql(x: str) -> str:
    for name, char in text.NAMED_ENTITIES:
        x = f"replace({x}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


def clean_sql(x: str) -> str:
    out = f"regexp_replace({entity_sql(x)}, '<[^\\n]*?>', '', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '[\\r\\n\\t\\f\\v  ]+', ' ', 'g'), '[\\x00-\\x1f]', '', 'g')"
    return f"trim(translate(regexp_replace({out}, ' +', ' ', 'g'), '’‘“”—–', '''''\"\"--'))"


@check("clean_text_pages", f"SELECT page_id, {clean_sql('html')} AS cleaned FROM pages")
def _(t):
    return t.table("pages").select("page_id", text.clean_text(F.col("html")).alias("cleaned"))


@check("clean_text_documents", f"SELECT doc_id, {clean_sql('text')} AS cleaned FROM documents")
def _(t):
    return t.table("documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


def hits_sql(lang: str) -> str:
    return f"len(list_filter(tokens, lambda w: list_contains({sql_list(text.STOP_WORDS[lang])}, w)))"


TOKENS_SQL = "regexp_extract_all(lower(text), '([\\p{L}]{1,})', 1)"
LANG_SQL = f"""
, tok AS (SELECT doc_id, text, {TOKENS_SQL} AS tokens FROM documents),
hit AS (SELECT *, {', '.join(hits_sql(x) + ' AS n_' + x for x in sorted(text.STOP_WORDS))} FROM tok),
best AS (SELECT *, greatest({', '.join('n_' + x for x in sorted(text.STOP_WORDS))}) AS top FROM hit),
lang AS (SELECT doc_id, text, CASE WHEN top = 0 THEN NULL
  {' '.join(f"WHEN n_{x} = top THEN '{x}'" for x in sorted(text.STOP_WORDS))} END AS detected FROM best)
"""


@check("learnt_language")
def _(t):
    """Languages of all documents by n-grams learnt from two thirds of them; whole texts and their first words (the short texts of reviews)."""
    docs = t.table("documents")
    model = language.train(docs.filter("crc32(cast(doc_id AS string)) % 3 <> 1"))
    short = F.array_join(F.slice(F.split("text", " "), 1, 8), " ")
    return docs.select("doc_id", "lang", F.expr("crc32(cast(doc_id AS string)) % 3 = 1").alias("held_out"), model.detect(F.col("text")).alias("detected"), model.detect(short).alias("detected_short"))


@check("detect_language", LANG_SQL + """
SELECT doc_id, detected, coalesce(length(trim(text)) >= 10 AND detected = 'en', false) AS english FROM lang""")
def _(t):
    c = F.col("text")
    return t.table("documents").select("doc_id", text.detect_language(c).alias("detected"),
                                       text.is_english(c).alias("english"))


FOLD_NAME_SQL = ("trim(regexp_replace(regexp_replace(translate(lower({x}), '" + text.ACCENTED + "', '" + text.UNACCENTED
                 + "'), '[™®©:]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))")


@check("fold_name", f"SELECT doc_id, {FOLD_NAME_SQL.format(x='text')} AS folded FROM documents")
def _(t):
    return t.table("documents").select("doc_id", text.fold_name(F.col("text")).alias("folded"))


def fold_title_sql(x: str) -> str:
    out = f"regexp_replace(lower({x}), '\\b({'|'.join(text.EDITION_WORDS)})\\b', '', 'g')".replace("director's", "director''s")
    for table in (text.ROMAN_NUMERALS, text.NUMBER_WORDS):
        for value, word in enumerate(table, start=1):
            out = f"regexp_replace({out}, '\\b{word}\\b', '{value}', 'g')"
    return f"trim(regexp_replace(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@check("fold_title", f"""
, named AS (SELECT appid, title || CASE WHEN appid % 2 = 0 THEN ': Definitive Edition IV' ELSE ' (Two) HD' END AS t FROM items)
SELECT appid, {fold_title_sql('t')} AS folded FROM named""")
def _(t):
    suffix = F.when(F.col("appid") % 2 == 0, F.lit(": Definitive Edition IV")).otherwise(F.lit(" (Two) HD"))
    return t.items.select("appid", text.fold_title(F.concat("title", suffix)).alias("folded"))


@check("numbers_differ", """
SELECT page_id, list_sort(list_distinct(regexp_extract_all(url, '(\\d+)', 1)))
  <> list_sort(list_distinct(regexp_extract_all(html, '(\\d+)', 1))) AS differs FROM pages""")
def _(t):
    return t.table("pages").select("page_id", text.numbers_differ(F.col("url"), F.col("html")).alias("differs"))


@check("parse_vote_map", """
, lit AS (SELECT appid, '{' || string_agg('''' || tag || ''': ' || votes, ', ' ORDER BY tag) || '}' AS tags FROM votes GROUP BY 1)
SELECT appid, tag, CAST(votes AS INTEGER) AS votes FROM votes""")
def _(t):
    pair = F.concat(F.lit("'"), "tag", F.lit("': "), F.col("votes").cast("string"))
    literal = t.votes.groupBy("appid").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(pair)), ", "), F.lit("}")).alias("tags"))
    return literal.select("appid", F.explode(filters.tag_map()).alias("tag", "votes"))


@check("parse_tag_and_genre_lists", """
SELECT appid, list_sort(list_filter(list_transform(string_split(
           CASE WHEN genres LIKE '[%' THEN regexp_replace(genres, '[\\[\\]''"]', '', 'g') ELSE genres END, ','), lambda x: trim(x)), lambda x: x <> '')) AS genre_list,
  CASE WHEN tags IS NULL THEN [] ELSE list_sort(regexp_extract_all(tags, '''([^'']*)''\\s*:', 1)) END AS tag_list
FROM raw_items""")
def _(t):
    return t.raw_items.select("appid", F.array_sort(filters.genre_array()).alias("genre_list"),
                              F.array_sort(text.parse_tag_list(F.col("tags"))).alias("tag_list"))


@check("embedding_text", """
, bundled AS (SELECT conv_id, string_agg(text, ' | ' ORDER BY turn) FILTER (role = 'user') AS r,
                     string_agg(text, ' ' ORDER BY turn) FILTER (role = 'system') AS d FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN trim(coalesce(d, '')) = '' AND trim(coalesce(r, '')) = '' THEN ''
  ELSE 'description: ' || lower(trim(coalesce(d, ''))) || ' reviews: ' || lower(trim(coalesce(r, ''))) END AS encoder_text FROM bundled""")
def _(t):
    def joined(role, sep):
        turns = F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text"))))
        return F.when(F.size(turns) > 0, F.array_join(F.transform(turns, lambda x: x["text"]), sep))

    # a conversation is a bounded group: its turns are one dialogue
    grouped = t.table("conversations").groupBy("conv_id").agg(joined("user", " | ").alias("r"), joined("system", " ").alias("d"))
    return grouped.select("conv_id", text.embedding_text(F.col("d"), F.col("r")).alias("encoder_text"))


PRICE_SQL = """CASE WHEN price IS NULL OR price = '' THEN NULL
  WHEN regexp_matches(lower(price), 'demo|pass|preview|alpha|beta|coming soon|n/a') THEN NULL
  WHEN contains(lower(price), 'free') THEN 0.0::DOUBLE
  WHEN regexp_matches(price, '\\d+[.,]\\d{2}') THEN CAST(replace(regexp_extract(price, '(\\d+[.,]\\d{2})', 1), ',', '.') AS DOUBLE)
  WHEN regexp_matches(price, '^\\s*\\$?\\d+\\s*$') AND CAST(regexp_extract(price, '(\\d+)', 1) AS DOUBLE) < 200
  THEN CAST(regexp_extract(price, '(\\d+)', 1) AS DOUBLE) END"""


@check("parse_price", f"SELECT appid, {PRICE_SQL} AS price_numeric FROM raw_items")
def _(t):
    return t.raw_items.select("appid", money.parse_price(F.col("price")).alias("price_numeric"))


@check("free_item_test", f"""
, p AS (SELECT appid, price, ln(1 + ({PRICE_SQL})) AS lp FROM raw_items),
s AS (SELECT avg(lp) AS m, stddev_samp(lp) AS sd FROM p)
SELECT appid, (coalesce((lp - m) / sd < -1.4, false) OR contains(lower(coalesce(price, '')), 'free'))
   AND NOT regexp_matches(coalesce(price, ''), '[1-9]') AS is_free FROM p, s""")
def _(t):
    priced = normalize.price_z(t.raw_items.select("appid", "price", money.parse_price(F.col("price")).alias("price_numeric")))
    return priced.select("appid", money.is_free(F.col("price"), F.col("price_z")).alias("is_free"))


@check("repair_number", """
SELECT appid, coalesce(TRY_CAST(replace(positive_text, ',', '') AS DOUBLE), 0.0::DOUBLE) AS positive FROM raw_items""")
def _(t):
    return t.raw_items.select("appid", text.repair_number(F.col("positive_text")).alias("positive"))


@check("validated_tags", """
, ok AS (SELECT tag FROM votes GROUP BY 1 HAVING sum(votes) > (SELECT sum(votes) / count(DISTINCT tag) FROM votes))
SELECT appid, tag, CAST(votes AS BIGINT) AS votes FROM votes WHERE tag IN (SELECT tag FROM ok)""")
def _(t):
    per_tag = t.votes.groupBy("tag").agg(F.sum("votes").alias("n"))
    bar = per_tag.agg((F.sum("n") / F.count("*")).alias("x")).scalar()
    validated = per_tag.filter(F.col("n") > bar).agg(F.collect_set("tag").alias("x")).scalar()  # bounded by the tag vocabulary
    maps = t.votes.groupBy("appid").agg(F.map_from_entries(F.collect_list(F.struct("tag", "votes"))).alias("m"))
    kept = filters.keep_validated_tags(F.col("m"), F.col("validated"))
    return maps.withColumn("validated", validated).select("appid", F.explode(kept).alias("tag", "votes"))


@check("top_vocabulary", """
SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '([\\p{L}]{3,})', 1)) AS word FROM documents)
GROUP BY 1 ORDER BY n DESC, word LIMIT 200""")
def _(t):
    tokens = t.table("documents").select(F.explode(text.words(F.col("text"), 3)).alias("word"))
    return tokens.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(200)


@check("repair_names", """
, messy AS (SELECT appid, CASE appid % 5 WHEN 0 THEN 'Unknown' WHEN 1 THEN repeat(name, 8) WHEN 2 THEN '<b>' || name WHEN 3 THEN NULL ELSE title END AS shown FROM items)
SELECT m.appid, CASE WHEN shown IS NULL OR shown = 'Unknown' OR length(shown) > 50 OR contains(shown, '<') OR contains(shown, ':')
  THEN coalesce(i.title, shown) ELSE shown END AS name FROM messy m LEFT JOIN items i ON m.appid = i.appid""")
def _(t):
    from curatrix.operators.joins import repair_names
    k = F.col("appid")
    messy = t.items.select("appid", F.when(k % 5 == 0, F.lit("Unknown")).when(k % 5 == 1, F.repeat("name", 8))
                           .when(k % 5 == 2, F.concat(F.lit("<b>"), "name")).when(k % 5 == 3, F.lit(None)).otherwise(F.col("title")).alias("name"))
    return repair_names(messy, t.items.select("appid", F.col("title").alias("name")))


@check("release_dates", "SELECT appid, raw, parsed FROM parsed_dates")
def _(t):
    return t.dated.select("appid", "raw", dates.parse_release_date(F.col("raw"), AS_OF).alias("parsed"))


@check("date_z_and_year", """
, c AS (SELECT appid, parsed, CASE WHEN parsed > TIMESTAMP '1999-01-01' THEN TIMESTAMP '1999-01-01' ELSE parsed END AS d FROM parsed_dates),
s AS (SELECT avg(epoch(d)) AS m, stddev_pop(epoch(d)) AS sd, avg(year(parsed)) AS my FROM c)
SELECT appid, d AS parsed_date, round(CASE WHEN d IS NULL THEN 0 ELSE (epoch(d) - m) / sd END, 6) + 0e0 AS date_z,
  round(coalesce(CAST(year(parsed) AS DOUBLE), my), 6) AS release_year FROM c, s""")
def _(t):
    parsed = t.dated.select("appid", dates.parse_release_date(F.col("raw"), AS_OF).alias("parsed_date"))
    out = normalize.date_z(normalize.year_or_mean(parsed), AS_OF)
    return out.select("appid", "parsed_date", normalize.r6("date_z"), normalize.r6("release_year"))


UNRELEASED_SQL = """(coalesce(parsed > TIMESTAMP '1999-01-01', false)
  OR regexp_matches(lower(raw), 'coming soon|to be announced|maybe|tbd'))"""


@check("unreleased_and_upcoming", f"""
SELECT appid, {UNRELEASED_SQL} AS unreleased, coalesce(parsed > TIMESTAMP '1999-01-01', false)
  OR regexp_matches(lower(raw), 'coming|tba|tbd|announced|soon|2000|2001|2002|2003|2004|q[234]\\s*1999') OR lower(raw) = '1999' AS upcoming
FROM parsed_dates""")
def _(t):
    raw, parsed = F.col("raw"), dates.parse_release_date(F.col("raw"), AS_OF)
    return t.dated.select("appid", dates.is_unreleased(parsed, raw, NOW).alias("unreleased"),
                          dates.is_upcoming(parsed, raw, NOW).alias("upcoming"))


@check("unparsed_dates", "SELECT DISTINCT raw FROM parsed_dates WHERE parsed IS NULL")
def _(t):
    return t.dated.filter(dates.parse_release_date(F.col("raw"), AS_OF).isNull()).select("raw").distinct()


PRECLEAN_SQL = """
, doubled AS (SELECT *, 0 AS seq FROM raw_items UNION ALL SELECT * REPLACE ('again' AS name), 1 AS seq FROM raw_items),
pre AS (SELECT appid, name, genres, categories, languages, price, coalesce(tags, '{}') AS tags, short_description, mature_content
        FROM (SELECT *, row_number() OVER (PARTITION BY appid ORDER BY seq) AS rn FROM doubled WHERE NOT is_dlc)
        WHERE rn = 1 AND name IS NOT NULL)"""
FLAGS_SQL = PRECLEAN_SQL + """
, flagged AS (SELECT *, contains(lower(coalesce(categories, '')), 'vr only') AS is_vr_only, contains(lower(languages), 'english') AS is_english,
  contains(lower(tags), 'utilities') AS is_utility, mature_content > 0 OR contains(lower(tags), '''hentai'':') AS is_nsfw,
  contains(lower(coalesce(price, '')), 'delisted') OR contains(lower(name), 'delisted') AS is_delisted,
  length(short_description) < 10 AND tags = '{}' AND genres = '' AS is_hollow FROM pre)"""


def precleaned(t):
    doubled = t.raw_items.withColumn("seq", F.lit(0)).unionByName(
        t.raw_items.withColumn("name", F.lit("again")).withColumn("seq", F.lit(1)))
    return filters.preclean(doubled, ["seq"])


def flagged(t):
    return filters.with_flags(precleaned(t))


FLAG_COLUMNS = "is_vr_only, is_english, is_utility, is_nsfw, is_delisted, is_hollow"


@check("preclean_items", PRECLEAN_SQL + " SELECT appid, name, tags FROM pre")
def _(t):
    return precleaned(t).select("appid", "name", "tags")


@check("item_flags", FLAGS_SQL + f" SELECT appid, {FLAG_COLUMNS} FROM flagged")
def _(t):
    return flagged(t).select("appid", *FLAG_COLUMNS.split(", "))


@check("delisting_checks", FLAGS_SQL + """
, gone AS (SELECT appid FROM review_stats WHERE (NOT negative > 9 AND NOT positive > 25) OR n > 40)
SELECT appid, is_delisted OR appid IN (SELECT appid FROM gone) AS is_delisted,
  CASE WHEN appid IN (SELECT appid FROM gone) THEN 'Delisted' ELSE price END AS price FROM flagged""")
def _(t):
    checks = t.review_stats.select("appid", (F.col("negative") > 9).alias("has_action_button"),
                                   (F.col("positive") > 25).alias("is_coming_soon"), (F.col("n") > 40).alias("is_delisted_kw"))
    return filters.apply_delisting_checks(flagged(t), checks).select("appid", "is_delisted", "price")


@check("eligible_items", FLAGS_SQL + f"""
SELECT f.appid FROM flagged f JOIN parsed_dates d ON f.appid = d.appid JOIN review_stats s ON f.appid = s.appid
WHERE is_english AND NOT is_vr_only AND NOT is_utility AND NOT is_nsfw AND NOT is_delisted AND NOT is_hollow
  AND NOT {UNRELEASED_SQL} AND positive + negative > 0""")
def _(t):
    dated = t.dated.select("appid", F.col("raw").alias("release_date"), dates.parse_release_date(F.col("raw"), AS_OF).alias("parsed_date"))
    df = flagged(t).join(dated, "appid").join(t.review_stats, "appid")
    keep = filters.eligible(english_only=True, remove_vr=True, remove_utilities=True, remove_delisted=True,
                            remove_hollow=True, remove_nsfw=True, unreleased_after=NOW)
    return df.filter(keep & filters.has_reviews()).select("appid")


@check("genre_and_tag_filters", """
SELECT appid, contains(lower(genres), 'promo') OR contains(lower(genres), 'brand#7') AS genre_hit,
  coalesce(contains(tags, '''STANDARD'':') AND contains(tags, '''Brand#3'':'), false) AS both_tags,
  coalesce(contains(tags, '''Brand#3'':') AND NOT contains(tags, '''ECONOMY'':'), false) AS kept FROM raw_items""")
def _(t):
    tags = filters.tag_map()
    return t.raw_items.select("appid", filters.any_genre(["Promo", "brand#7"]).alias("genre_hit"),
                              filters.all_tags(["STANDARD", "Brand#3"], tags).alias("both_tags"),
                              filters.include_exclude(F.map_keys(tags), ["Brand#3"], ["ECONOMY"]).alias("kept"))


@check("quality_gate", FLAGS_SQL + """
SELECT f.appid, n >= 25 AND positive / (n + 1e-9) >= 0.65 AND NOT is_hollow AND NOT is_delisted AND NOT is_utility AND NOT is_nsfw AS passes,
  CASE WHEN n >= 25 AND positive / (n + 1e-9) >= 0.65 AND NOT is_hollow AND NOT is_delisted AND NOT is_utility AND NOT is_nsfw
  THEN 0.0::DOUBLE ELSE -0.4::DOUBLE END AS penalty FROM flagged f JOIN review_stats s ON f.appid = s.appid""")
def _(t):
    gate = filters.quality_gate(min_reviews=25)
    return flagged(t).join(t.review_stats, "appid").select("appid", gate.alias("passes"), filters.gate_penalty(gate).alias("penalty"))


@check("profile_exclusion", """
, mine AS (SELECT appid, rating, playtime FROM ratings WHERE user_id = (SELECT user_id FROM ratings GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 1))
SELECT 'rated' AS mode, count(*) AS n FROM items WHERE appid NOT IN (SELECT appid FROM mine WHERE rating >= 7)
UNION ALL SELECT 'all', count(*) FROM items WHERE appid NOT IN (SELECT appid FROM mine)
UNION ALL SELECT 'completed', count(*) FROM items WHERE appid NOT IN (SELECT appid FROM mine WHERE rating >= 7 OR playtime > 25)
UNION ALL SELECT 'none', count(*) FROM items WHERE appid NOT IN (SELECT appid FROM mine WHERE rating = 0)""")
def _(t):
    mine = busiest_user(t).withColumns({"rated": F.col("rating") >= 7, "playtime": F.greatest(F.col("playtime") - 25, F.lit(0))})
    out = None
    for mode in ("rated", "all", "completed", "none"):
        ignored = mine.filter(F.col("rating") == 0) if mode == "none" else None
        part = filters.exclude_profile(t.items, mine, mode, ignored).agg(F.lit(mode).alias("mode"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def busiest_user(t):
    """All ratings of the user with the most ratings."""
    def build():
        top = t.ratings.groupBy("user_id").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "user_id").limit(1)
        return t.ratings.join(F.broadcast(top.select("user_id")), "user_id", "left_semi")

    return t.once("busiest", build)


@check("reliable_or_all", """
, g AS (SELECT *, (SELECT bool_or(n >= 45) FROM catalogue) AS any_strict, (SELECT bool_or(n >= 4500) FROM catalogue) AS none_so_big FROM catalogue)
SELECT 'strict' AS pool, appid FROM g WHERE CASE WHEN any_strict THEN n >= 45 ELSE n > 0 END
UNION ALL SELECT 'fallback', appid FROM g WHERE CASE WHEN none_so_big THEN n >= 4500 ELSE n > 0 END""")
def _(t):
    cat = t.catalogue
    strict = filters.reliable_or_all(cat, F.col("n") >= 45, F.col("n") > 0).select(F.lit("strict").alias("pool"), "appid")
    return strict.unionByName(filters.reliable_or_all(cat, F.col("n") >= 4500, F.col("n") > 0).select(F.lit("fallback").alias("pool"), "appid"))
