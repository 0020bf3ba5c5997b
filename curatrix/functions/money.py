"""Price texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a price text that say nothing about the price.
NO_PRICE_WORDS = ("demo", "pass", "preview", "alpha", "beta", "coming soon", "n/a")


def parse_price(text: Column) -> Column:
    """Number in a price text; free is 0; unknown is null; a bare whole number counts below 200."""
    s = F.lower(F.trim(text))
    decimal = F.regexp_extract(s, "(\\d+[.,]\\d{2})", 1)
    whole = F.regexp_extract(s, "^\\s*\\$?(\\d+)\\s*$", 1).try_cast("double")
    return (F.when(s.isNull() | (s == "") | s.rlike("|".join(NO_PRICE_WORDS)), F.lit(None).cast("double"))
            .when(s.contains("free"), F.lit(0.0))
            .when(decimal != "", F.replace(decimal, F.lit(","), F.lit(".")).cast("double"))
            .when(whole < 200, whole))


def is_free(price: Column, price_z: Column) -> Column:
    """Very cheap by z-score or called free, and without any digit 1-9."""
    text = F.lower(F.coalesce(price, F.lit("")))
    return (F.coalesce(price_z < -1.4, F.lit(False)) | text.contains("free")) & ~text.rlike("[1-9]")
