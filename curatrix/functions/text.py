"""Text cleaning and normalizing columns. All of it stays inside Spark's own expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named character references, replaced before the ampersand itself.
NAMED_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "),
                  ("&reg;", "®"), ("&trade;", "™"), ("&copy;", "©"), ("&hellip;", "…"), ("&ndash;", "–"),
                  ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"),
                  ("&amp;", "&"))
# Typographic marks and what they become.
SMART_MARKS, PLAIN_MARKS = "’‘“”—–", "''\"\"--"
# The printable characters code page 1252 puts where ISO 8859-1 has control codes.
CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_CODES = ("\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99"
                "\x9a\x9b\x9c\x9e\x9f")
# Accented letters (lower case) and their base letters.
ACCENTED = "àáâãäåāăąçćčďèéêëēęěìíîïīłñńňòóôõöōøřśšťùúûüūůýÿźżž"
UNACCENTED = "aaaaaaaaacccdeeeeeeeiiiiilnnnooooooorsstuuuuuuyyzzz"
# Words dropped from a title before matching.
EDITION_WORDS = ("edition", "enhanced", "goty", "game of the year", "complete", "anniversary", "remastered",
                 "remake", "collection", "bundle", "definitive", "director's cut", "hd")
ROMAN_NUMERALS = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
# Frequent function words per language.
STOP_WORDS = {
    "en": ("the", "and", "of", "to", "is", "in", "that", "it", "for", "with", "was", "are", "this", "not", "on"),
    "fr": ("le", "la", "les", "et", "des", "une", "est", "que", "pour", "dans", "qui", "avec", "sur", "pas", "du"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "von", "auf", "für", "den", "zu", "sich"),
    "es": ("el", "los", "las", "y", "que", "una", "por", "con", "para", "del", "como", "se", "un", "en", "no"),
}
MULTIBYTE_AS_LATIN = "[Â-ß][\u0080-¿]|[à-ï][\u0080-¿]{2}|[ð-ô][\u0080-¿]{3}"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``use``, which may mention it many times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _numeric_entities(text: Column) -> Column:
    """Decimal and hexadecimal character references, resolved piece by piece after each ``&#``."""

    def resolve(piece: Column) -> Column:
        hexa = F.regexp_extract(piece, "^[xX]([0-9a-fA-F]{1,6});", 1)
        number = F.when(hexa != "", F.conv(hexa, 16, 10).cast("int")).otherwise(
            F.regexp_extract(piece, "^([0-9]{1,7});", 1).try_cast("int"))

        def char_or_same(code: Column) -> Column:
            usable = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
            char = F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")
            return F.when(usable, F.concat(char, F.regexp_replace(piece, "^[xX]?[0-9a-fA-F]+;", ""))).otherwise(
                F.concat(F.lit("&#"), piece))

        return bind(number, char_or_same)

    def rebuild(pieces: Column) -> Column:
        tail = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), resolve)
        return F.concat(pieces[0], F.array_join(tail, ""))

    return bind(F.split(text, "&#"), rebuild)


def unescape(text: Column) -> Column:
    out = _numeric_entities(text)
    for name, char in NAMED_ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def repair_double_encoding(text: Column) -> Column:
    """Undo UTF-8 bytes once read as code page 1252, where that reading is fully valid."""


    def attempt(original: Column) -> Column:
        return bind(F.translate(original, CP1252_CHARS, CP1252_CODES), lambda latin: F.when(
            latin.rlike(MULTIBYTE_AS_LATIN) & ~latin.rlike("[^\u0000-ÿ]")
            & ~F.regexp_replace(latin, MULTIBYTE_AS_LATIN, "").rlike("[\u0080-ÿ]"),
            F.decode(F.encode(latin, "ISO-8859-1"), "UTF-8")).otherwise(original))

    return bind(text, attempt)


def clean_text(text: Column, repair: bool = True) -> Column:
    """Markup-free single-line text: entities, tags, white space, control codes, typographic marks."""
    out = F.regexp_replace(unescape(text), "<[^\\n]*?>", "")
    out = F.regexp_replace(out, "[\\r\\n\\t\\f\\x0B  ]+", " ")
    out = F.regexp_replace(out, "[\\x00-\\x1f]", "")
    out = F.translate(F.regexp_replace(out, " +", " "), SMART_MARKS, PLAIN_MARKS)
    if repair:
        for _ in range(3):
            out = repair_double_encoding(out)
    return F.coalesce(F.trim(out), F.lit(""))


def fold_name(text: Column) -> Column:
    """Lower-case ASCII words of a name: accents folded, trade marks and colons dropped."""
    out = F.translate(F.lower(text), ACCENTED, UNACCENTED)
    out = F.regexp_replace(F.regexp_replace(out, "[™®©:]", ""), "[^a-z0-9]+", " ")
    return F.coalesce(F.trim(out), F.lit(""))


def fold_title(text: Column) -> Column:
    """A title reduced for matching: no edition words, numerals and number words as digits."""
    out = F.regexp_replace(F.lower(text), "\\b(" + "|".join(EDITION_WORDS) + ")\\b", "")
    for words in (ROMAN_NUMERALS, NUMBER_WORDS):
        for value, word in enumerate(words, start=1):
            out = F.regexp_replace(out, f"\\b{word}\\b", str(value))
    out = F.regexp_replace(F.regexp_replace(out, "[^\\p{L}\\p{N}_\\s]", " "), "\\s+", " ")
    return F.coalesce(F.trim(out), F.lit(""))


def digit_runs(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("(\\d+)"), F.lit(1))))


def numbers_differ(left: Column, right: Column) -> Column:
    """True when two titles carry different sets of numbers (a sequel and its original)."""
    return digit_runs(left) != digit_runs(right)


def words(text: Column, min_length: int = 1) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"([\\p{{L}}]{{{min_length},}})"), F.lit(1))


def stop_word_hits(tokens: Column, language: str) -> Column:
    known = F.array(*[F.lit(w) for w in STOP_WORDS[language]])
    return F.size(F.filter(tokens, lambda t: F.array_contains(known, t)))


def detect_language(text: Column) -> Column:
    """Language whose function words occur most; null when none occurs. Ties go to the earlier code."""
    codes = sorted(STOP_WORDS)

    def most_hits(tokens: Column) -> Column:
        return F.array_max(F.array(*[F.struct(stop_word_hits(tokens, lang).alias("n"), F.lit(-i).alias("order"), F.lit(lang).alias("lang"))
                                     for i, lang in enumerate(codes)]))

    return bind(bind(words(text), most_hits), lambda best: F.when(best["n"] > 0, best["lang"]))


def is_english(text: Column) -> Column:
    return F.coalesce((F.length(F.trim(text)) >= 10) & (detect_language(text) == "en"), F.lit(False))


def parse_vote_map(text: Column) -> Column:
    """``{'Action': 100, "It's": 5}`` or ``['Action', 'Indie']`` as MAP<STRING,INT>; anything else is empty."""
    pair = "(?:'([^'\\\\]*)'|\"([^\"\\\\]*)\")\\s*:\\s*(-?\\d+)"
    body = F.trim(text)
    joined = F.transform(F.regexp_extract_all(body, F.lit(pair), F.lit(0)), lambda p: F.struct(
        F.concat(F.regexp_extract(p, pair, 1), F.regexp_extract(p, pair, 2)).alias("key"),
        F.regexp_extract(p, pair, 3).cast("int").alias("value")))
    listed = F.transform(F.regexp_extract_all(body, F.lit("'([^']*)'"), F.lit(1)),
                         lambda t: F.struct(t.alias("key"), F.lit(1).alias("value")))
    empty = F.map_from_entries(F.slice(joined, 1, 0))
    well_formed = body.rlike("^\\{.*\\}$")
    parsed = F.when(well_formed, F.map_from_entries(joined)).when(
        body.rlike("^\\[.*\\]$"), F.map_from_entries(F.array_distinct(listed))).otherwise(empty)
    return F.coalesce(parsed, F.create_map().cast("map<string,int>"))


def parse_list(text: Column) -> Column:
    """Comma text or a bracketed list literal as trimmed, non-empty names."""
    plain = F.when(text.startswith("["), F.regexp_replace(text, "[\\[\\]'\"]", "")).otherwise(text)
    parts = F.transform(F.split(F.coalesce(plain, F.lit("")), ","), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def parse_tag_list(text: Column) -> Column:
    """Tag names of a field that may hold a dict literal, a list literal or comma text."""
    return F.when(F.trim(text).startswith("{"), F.map_keys(parse_vote_map(text))).otherwise(parse_list(text))


def embedding_text(description: Column, reviews: Column) -> Column:
    """The text handed to an encoder; empty when both parts are."""
    d, r = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (description, reviews))
    return F.when((d == "") & (r == ""), F.lit("")).otherwise(
        F.concat(F.lit("description: "), d, F.lit(" reviews: "), r))


def repair_number(text: Column) -> Column:
    """``1,234`` as 1234, anything that is no number as 0."""
    return F.coalesce(F.regexp_replace(text, ",", "").try_cast("double"), F.lit(0.0))
