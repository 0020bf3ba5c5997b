"""Release dates written in many ways. Every function takes the reference day; none reads a clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for an unknown future date.
PLACEHOLDERS = ("coming soon", "to be announced", "maybe", "tbd")
ABSURD_YEARS = ("9998", "6969", "9000", "2099")
UPCOMING_WORDS = ("coming", "tba", "tbd", "announced", "soon")
FREE_FORMS = ("d MMM, yyyy", "MMM d, yyyy", "d MMM yyyy", "MMM d yyyy", "d MMMM, yyyy", "MMMM d, yyyy",
              "d MMMM yyyy", "MMMM d yyyy", "yyyy/M/d", "M/d/yyyy", "yyyy-M-d")


def parse_release_date(text: Column, as_of: dt.date) -> Column:
    """Timestamp of a release text: placeholders a year ahead, a bare year in July, a month at its middle."""
    s = F.trim(text)
    ahead = F.add_months(F.lit(as_of), 12).cast("timestamp")

    def month_form(month: str, year: str) -> Column:
        joined = F.concat_ws(" ", F.regexp_extract(s, *month), F.lit("15"), F.regexp_extract(s, *year))
        return F.coalesce(F.try_to_timestamp(joined, F.lit("MMMM d yyyy")), F.try_to_timestamp(joined, F.lit("MMM d yyyy")))

    month_first, year_first = "^([A-Za-z]+)\\s+(\\d{4})$", "^(\\d{4})\\s+([A-Za-z]+)$"
    absurd = "\\b(" + "|".join(ABSURD_YEARS) + ")\\b"
    return (F.when(s.isNull() | (s == ""), F.lit(None).cast("timestamp"))
            .when(F.lower(s).isin(*PLACEHOLDERS) | s.rlike(absurd) | s.rlike("^[Qq][1-4]\\s+\\d{4}$"), ahead)
            .when(s.rlike("^\\d{4}-\\d{2}-\\d{2}$"), F.try_to_timestamp(s, F.lit("yyyy-MM-dd")))
            .when(s.rlike("^\\d{4}$"), F.try_to_timestamp(F.concat(s, F.lit("-07-01")), F.lit("yyyy-MM-dd")))
            .when(s.rlike(month_first), month_form((month_first, 1), (month_first, 2)))
            .when(s.rlike(year_first), month_form((year_first, 2), (year_first, 1)))
            .otherwise(F.coalesce(*[F.try_to_timestamp(s, F.lit(form)) for form in FREE_FORMS])))


def is_placeholder(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(PLACEHOLDERS))


def is_unreleased(parsed: Column, text: Column, as_of: dt.datetime) -> Column:
    return F.coalesce(parsed > F.lit(as_of), F.lit(False)) | is_placeholder(text)


def is_upcoming(parsed: Column, text: Column, as_of: dt.datetime) -> Column:
    """Not out yet: an exact future date, an announcement word, a near year, a later quarter, this bare year."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    year, quarter = as_of.year, (as_of.month - 1) // 3 + 1
    later_quarters = "".join(str(q) for q in range(quarter + 1, 5))
    marks = [*UPCOMING_WORDS, *[str(year + k) for k in range(1, 6)]]
    by_quarter = lowered.rlike(f"q[{later_quarters}]\\s*{year}") if later_quarters else F.lit(False)
    return (F.coalesce(parsed > F.lit(as_of), F.lit(False)) | lowered.rlike("|".join(marks)) | by_quarter
            | (lowered == str(year)))
