"""Literal cases of text, date, price and vector functions."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from curatrix.functions import dates, html, money, normal, text
from curatrix.functions import vectors as V


def one(spark, column, **values):
    names = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    row = spark.createDataFrame([tuple(v for _, v in values.values())], names)
    return row.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(("raw", "clean"), [
    ("<b>Hi</b>  &amp;\n you", "Hi & you"), ("it’s – “ok”", "it's - \"ok\""), ("&#65;&#x42;c", "ABc"), ("cafÃ©", "café"), ("plain é", "plain é"),
    (None, ""), ("a\x07b", "ab"), ("&amp;lt;", "&lt;"), ("â‚¬5", "€5")])
def test_clean_text(spark, raw, clean):
    assert one(spark, text.clean_text(F.col("s")), s=("string", raw)) == clean


@pytest.mark.parametrize(("raw", "folded"), [
    ("Age of Empires II: Definitive Edition", "age of empires 2"), ("Skyrim Special Edition", "skyrim special"), ("Final Fantasy VII", "final fantasy 7"), ("Part Two", "part 2")])
def test_fold_title(spark, raw, folded):
    assert one(spark, text.fold_title(F.col("s")), s=("string", raw)) == folded


def test_fold_name(spark):
    assert one(spark, text.fold_name(F.col("s")), s=("string", "Pokémon™: Été")) == "pokemon ete"


@pytest.mark.parametrize(("a", "b", "differ"), [("doom", "doom 2", True), ("doom 2016", "doom 2016", False)])
def test_numbers_differ(spark, a, b, differ):
    assert one(spark, text.numbers_differ(F.col("a"), F.col("b")), a=("string", a), b=("string", b)) is differ


@pytest.mark.parametrize(("raw", "parsed"), [
    ("{'Action': 100, 'Indie': 50}", {"Action": 100, "Indie": 50}), ('{"It\'s": 3}', {"It's": 3}), ("[]", {}), ("", {}), (None, {}), ("['A', 'B']", {"A": 1, "B": 1}), ("{broken", {})])
def test_parse_vote_map(spark, raw, parsed):
    assert one(spark, text.parse_vote_map(F.col("s")), s=("string", raw)) == parsed


@pytest.mark.parametrize(("raw", "value"), [("$19.99", 19.99), ("12,34", 12.34), ("Free To Play", 0.0), ("N/A", None), ("5", 5.0), ("730", None), ("Free Demo", None), (None, None)])
def test_parse_price(spark, raw, value):
    assert one(spark, money.parse_price(F.col("s")), s=("string", raw)) == value


@pytest.mark.parametrize(("raw", "value"), [
    ("2023", dt.datetime(2023, 7, 1)), ("Jan 2023", dt.datetime(2023, 1, 15)), ("2023 March", dt.datetime(2023, 3, 15)), ("invalid date", None), ("Coming soon", dt.datetime(2025, 1, 1)),
    ("Q3 2026", dt.datetime(2025, 1, 1)), ("9 May, 2020", dt.datetime(2020, 5, 9)), ("2020-02-30", None), ("", None)])
def test_release_dates(spark, raw, value):
    assert one(spark, dates.parse_release_date(F.col("s"), dt.date(2024, 1, 1)), s=("string", raw)) == value


def test_upcoming_depends_on_the_given_day(spark):
    day = dt.datetime(2024, 5, 1)
    cases = {"TBA": True, "2024": True, "2026": True, "Q1 2024": False, "Q3 2024": True, "2 Jan, 2020": False}
    for raw, expected in cases.items():
        assert one(spark, dates.is_upcoming(F.lit(None).cast("timestamp"), F.col("s"), day), s=("string", raw)) is expected


@pytest.mark.parametrize("x", [-7.5, -3.0, -1.0, -0.1, 0.0, 0.4, 2.0, 5.0])
def test_normal_functions(spark, x):
    truth = 0.5 * math.erfc(-x / math.sqrt(2))
    assert one(spark, normal.cdf("x"), x=("double", x)) == pytest.approx(truth, rel=1e-12, abs=1e-16)
    if 1e-9 < truth < 1 - 1e-9:
        assert one(spark, normal.quantile("p"), p=("double", truth)) == pytest.approx(x, abs=1e-7)


def test_vectors(spark):
    a, b = ("array<double>", [1.0, 2.0, 0.0]), ("array<double>", [2.0, 0.0, 1.0])
    assert one(spark, V.weighted_jaccard(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(1 / 5)
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(2 / 5)
    blend = one(spark, V.softmin_blend(F.col("a"), 0.05), a=("array<double>", [0.2, 0.9]))
    assert 0.2 <= blend < 0.21
    p = ("array<double>", [0.5, 0.5])
    assert one(spark, V.jensen_shannon_similarity(F.col("p"), F.col("p")), p=p) == pytest.approx(1.0, abs=1e-4)


def test_media_and_cards(spark):
    card = '<div class="review_box"><a href="/app/10">x</a><img src="icon_thumbsDown.png"></div>'
    assert one(spark, html.card_vote(F.element_at(html.review_cards(F.col("h")), 1)), h=("string", card)) is False


def test_profile_id(spark):
    assert one(spark, html.profile_id(F.col("s")), s=("string", "https://x.invalid/profiles/76561198000000001/")) == "76561198000000001"
    assert one(spark, html.profile_id(F.col("s")), s=("string", "https://x.invalid/id/somebody")) is None
