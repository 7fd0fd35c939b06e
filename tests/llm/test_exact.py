import collections
import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shellsieve.llm.common import LOWER, UPPER
from shellsieve.llm.exact import KEYS, exact_duplicates

ROWS = [
    (1, "Same"), (2, "sAME"), (3, "same "), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "É"),
    (9, "ab" * 5000), (10, "aB" * 5000), (11, "ab" * 4999 + "ba"), (None, "same"), (None, "lone"),
    (None, "lone"), (2, "same"), (12, "0123456789abcdef" * 3), (13, "0123456789abcdef" * 3 + "0"),
]


def model(rows):
    fold = str.maketrans(UPPER, LOWER)
    groups = collections.defaultdict(list)
    for i, text in rows:
        groups[(text or "").translate(fold)].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known, default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        first = ids.index(keep)
        out += [(i, keep, len(ids), k == first, sha) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("block_bytes", [3, 16, 4096])
def test_equals_the_model(docs_of, block_bytes):
    assert result(exact_duplicates(docs_of(ROWS), block_bytes=block_bytes)) == model(ROWS)


def test_blocks_whose_keys_collide(docs_of):
    weak = (lambda block: F.octet_length(block).cast("long"), KEYS[1])
    rows = [(1, "aa"), (2, "bb"), (3, "aa"), (4, "aabb"), (5, "bbaa")]
    assert result(exact_duplicates(docs_of(rows), block_bytes=2, keys=weak)) == model(rows)
    with pytest.raises(ValueError, match="share every key"):
        exact_duplicates(docs_of(rows), block_bytes=2, keys=weak[:1])


def test_empty_table(docs_of):
    assert exact_duplicates(docs_of([]).limit(0)).collect() == []


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 9), st.text("aAbBéÉ\n", max_size=9)), min_size=1, max_size=20))
def test_random_texts(docs_of, rows):
    rows = [(i * 100 + n, t) for n, (i, t) in enumerate(rows)]
    assert result(exact_duplicates(docs_of(rows), block_bytes=2)) == model(rows)


def test_other_names(spark):
    df = spark.createDataFrame([(1, "x"), (2, "X")], "`my.id` long, `a b` string")
    assert [r.keep_id for r in exact_duplicates(df, "my.id", "a b").collect()] == [2, 2]
