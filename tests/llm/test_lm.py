import collections
import math
import random
import re

import pytest

from shellsieve.llm import lm
from shellsieve.llm.lm import lm_scores


def micros(x):
    return round(math.log(x) * 1_000_000)


def model(rows, vocabulary, min_count=2, backoff=0.4):
    texts = [(i, (t or "").encode().lower().split()) for i, t in rows]
    count = collections.Counter(w for _, ws in texts for w in ws)
    known = set(sorted(count, key=lambda w: (-count[w], w))[:vocabulary])
    texts = [(i, [w if w in known else None for w in ws]) for i, ws in texts]
    one = collections.Counter(w for _, ws in texts for w in ws)
    two = collections.Counter(p for _, ws in texts for p in zip(ws, ws[1:], strict=False))
    before = collections.Counter(p[0] for p in two.elements())
    total = sum(one.values())
    out = []
    for i, ws in texts:
        score = 0
        for k, w in enumerate(ws):
            pair = (ws[k - 1], w) if k else None
            if pair and two[pair] >= min_count:
                score += micros(two[pair]) - micros(before[pair[0]])
            else:
                score += micros(one[w]) - micros(total) + (micros(backoff) if pair else 0)
        out.append((i, len(ws), score))
    return sorted(out, key=repr)


@pytest.mark.parametrize("vocabulary", [None, 1, 4, 100])
@pytest.mark.parametrize("hot_share", [1, 6, 700])
def test_equals_the_model(docs_of, monkeypatch, vocabulary, hot_share):
    monkeypatch.setattr(lm, "BATCH_WORDS", 50)
    monkeypatch.setattr(lm, "COUNTED_WORDS", 3)
    monkeypatch.setattr(lm, "HOT_SHARE", hot_share)
    monkeypatch.setattr(lm, "NUMBERED", 3)
    monkeypatch.setattr(lm, "PARTITION_WORDS", 5000)
    rng = random.Random(hot_share)
    rows = [(i, " ".join(rng.choices("aBcdefgh", weights=range(1, 9), k=rng.randint(0, 20)))) for i in range(60)]
    rows += [(100, None), (101, "É é É"), (None, "a b"), (5, "a b a"), (5, "a b a"), (102, "h " * 500), (103, "h " * 500)]
    rows += [(7, None), (7, None), (None, "a b"), (8, "long " * 20_000)]
    found = lm_scores(docs_of(rows), vocabulary=vocabulary, min_count=2 if vocabulary else 1).collect()
    assert sorted(map(tuple, found), key=repr) == model(rows, vocabulary or 1000, 2 if vocabulary else 1)


@pytest.mark.parametrize("min_count", [1, 2])
def test_all_words_and_pairs(docs_of, min_count):
    """Most words and pairs are seen once."""
    rng = random.Random(min_count)
    rows = [(i, " ".join([f"once{i}x{k} {rng.choice('abc')}" for k in range(700)])) for i in range(100)]
    rows += [(100, None), (None, "a b"), (5, "a once5x3 a")]
    found = lm_scores(docs_of(rows), min_count=min_count).collect()
    assert sorted(map(tuple, found), key=repr) == model(rows, 1 << 20, min_count)


def test_copies_of_blocks(docs_of, monkeypatch):
    """Blocks that hold the same rows have one name, and texts without words fill blocks of their own."""
    monkeypatch.setattr(lm, "BATCH_TEXTS", 2)
    monkeypatch.setattr(lm, "HOT_SHARE", 4)
    rows = [(1, "a b c a d"), (2, "a b a b e")] * 5 + [(None, None), (3, "")] * 4 + [(None, "c a")] * 4
    docs = docs_of(rows).coalesce(1)
    assert sorted(map(tuple, lm_scores(docs).collect()), key=repr) == model(rows, 100, 1)


def test_ids_of_text(docs_of):
    rows = [(1, "a b c"), (None, "b c b c"), (3, None)]
    docs = docs_of(rows).selectExpr("cast(doc_id as string) doc_id", "text")
    found = [(r[0] and int(r[0]), r[1], r[2]) for r in lm_scores(docs).collect()]
    assert sorted(found, key=repr) == model(rows, 100, 1)


def test_empty_tables(docs_of):
    assert lm_scores(docs_of([])).collect() == []
    assert [tuple(r) for r in lm_scores(docs_of([(1, None)])).collect()] == [(1, 0, 0)]


def test_pairs_are_joined_with_count_tables(docs_of, monkeypatch):
    """Exploded pairs, hot ones too, meet grouped count tables in joins; both readings share one shuffle."""
    plans, stored = {}, lm.Scratch.stored

    def keep(self, df, purpose):
        plans[purpose] = df._jdf.queryExecution().executedPlan().toString()
        return stored(self, df, purpose)

    monkeypatch.setattr(lm.Scratch, "stored", keep)
    monkeypatch.setattr(lm, "HOT_SHARE", 4)
    monkeypatch.setattr(lm, "PARTITION_WORDS", 3)
    rows = [(1, "a b a c"), (2, "b d a b")]
    assert sorted(map(tuple, lm_scores(docs_of(rows)).collect())) == model(rows, 100, 1)
    plan = plans["texts"]
    assert "Window" not in plan
    assert re.search(r"BroadcastHashJoin \[hot#", plan)
    assert re.search(r"ShuffledHashJoin \[bucket#\w+, before#\w+, word#\w+\]", plan)
    packed = re.findall(r"Exchange shufflepartition\w*.*\n\W*(Filter isnotnull\(bucket).*\n\W*MapInArrow explode", plan)
    assert len(packed) == 2
