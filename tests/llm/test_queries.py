"""The registered queries against their SQL on the smallest tables, and the words of numpy against plain ones."""

import numpy as np
import pyarrow as pa
import pytest

from curatrix.llm import queries
from curatrix.llm.words import blocks, shingles, word_hashes
from tests.conftest import SMALL
from verify import canonical

from .brute import shingle_set


def test_every_operator_is_registered():
    assert [int(name[2:].split("_")[0]) for name in queries.QUERIES] == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(name, spark, duck):
    assert canonical(queries.QUERIES[name](spark, SMALL).toPandas()) == canonical(duck.sql(queries.SQL[name]).df())


def test_shingles_of_odd_texts():
    texts = [None, "", " ", "One", "one  TWO\tthree", "a b c d e", "a b c d e f", "É é", "x" * 5000 + " y", "a\x0bb\x0cc\rd\ne f g", "\x00 \x1f q"]
    seen: dict[int, tuple] = {}
    for limit in (1 << 20, 8):
        for at, to, data, offsets in blocks(pa.array(texts), limit):
            values, rows = shingles(*word_hashes(data, offsets))
            for i in range(to - at):
                got = set(values[rows[i]:rows[i + 1]].tolist())
                want = shingle_set(texts[at + i])
                assert len(got) == len(want)
                if len(want) == 1:
                    assert seen.setdefault(got.copy().pop(), want.copy().pop()) == want.copy().pop()
    assert np.array_equal(word_hashes(*next(blocks(pa.array(["ABC é"])))[2:])[0], word_hashes(*next(blocks(pa.array(["abc é"])))[2:])[0])
