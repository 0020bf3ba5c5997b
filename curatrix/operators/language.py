"""Language identification from character n-grams: naive Bayes over hashed 1- to 3-grams, learnt from texts with a known language.

A text is lower-cased; runs of anything but letters become one space. Every n-gram of it (n = 1, 2, 3) falls in one of ``BUCKETS`` hashed cells. The model is the
log share of each cell per language with add-one smoothing: languages x BUCKETS numbers whatever the corpus. A text's score for a language is the
sum over its n-grams; a text without letters has no language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS, MAX_LANGUAGES = 1 << 16, 256
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def letters(text: Column) -> Column:
    """Lower-case letters with single spaces between words and around the text; null for a null text."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}]+", " ")), F.lit(" "))


def cells(text: str) -> np.ndarray:
    """The cells of all n-grams of a text, with repeats."""
    if not text or not text.strip():
        return np.zeros(0, np.int64)
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    out, h = [], np.zeros(len(c), np.uint64)
    for n in range(3):
        if len(c) <= n:
            break
        h = (h[:len(c) - n] * _A + c[n:] + np.uint64(1)) * _B
        out.append((h ^ (h >> np.uint64(29))) * _A >> np.uint64(48))
    return np.concatenate(out).astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    """Log shares (languages x BUCKETS) and prior log weights."""

    languages: list[str]
    logs: np.ndarray

    def scores(self, texts: pd.Series) -> np.ndarray:
        """Log-likelihood of each text per language; NaN without letters."""
        out = np.full((len(texts), len(self.languages)), np.nan)
        for i, text in enumerate(texts):
            at = cells(text)
            if len(at):
                out[i] = self.logs[:, at].sum(axis=1)
        return out

    def detect(self, text: Column) -> Column:
        """The most likely language of a column of texts; ties go to the earlier code."""
        shared = _broadcast(self)

        @F.pandas_udf(T.StringType())
        def best(texts: pd.Series) -> pd.Series:
            model = shared.value
            scores = model.scores(texts)
            names = np.array([*model.languages, None], object)
            return pd.Series(names[np.where(np.isnan(scores[:, 0]), len(model.languages), np.nan_to_num(scores).argmax(axis=1))])

        return best(letters(text))

    def confidence(self, text: Column, language: str) -> Column:
        """Posterior chance of one language with equal priors."""
        shared, at = _broadcast(self), self.languages.index(language)

        @F.pandas_udf(T.DoubleType())
        def share(texts: pd.Series) -> pd.Series:
            scores = shared.value.scores(texts)
            e = np.exp(scores - scores.max(axis=1, keepdims=True))
            return pd.Series(e[:, at] / e.sum(axis=1))

        return share(letters(text))


def _broadcast(model: LanguageModel):
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession().sparkContext.broadcast(model)


def train(docs: DataFrame, text: str = "text", language: str = "lang") -> LanguageModel:
    """A model from all rows with a text and a language: counts are summed in each task, then over tasks."""
    rows = docs.filter(F.col(text).isNotNull() & F.col(language).isNotNull()).select(F.col(language).alias("lang"), letters(F.col(text)).alias("text"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for frame in frames:
            for name, texts in frame.groupby("lang")["text"]:
                own = totals.setdefault(name, np.zeros(BUCKETS, np.int64))
                for value in texts:
                    own += np.bincount(cells(value), minlength=BUCKETS)
        for name, own in totals.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": name, "cell": at, "n": own[at]})

    counts = rows.mapInPandas(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    names = [r["lang"] for r in rows.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    total = np.ones((len(names), BUCKETS))
    place = {n: i for i, n in enumerate(names)}
    for r in counts.toLocalIterator():  # at most languages x BUCKETS rows
        total[place[r["lang"]], r["cell"]] += r["n"]
    return LanguageModel(names, np.log(total) - np.log(total.sum(axis=1, keepdims=True)))
