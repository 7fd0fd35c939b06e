import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from shellsieve.llm import search
from shellsieve.llm.search import Best, Lists, answer, best_documents, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain_search(docs, items, k=10):
    """item_id, rank, doc_id, score from the scores of all pairs."""
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs = sum(1 for _, c in counts if c)
    n_terms = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc_id, c in counts:
            n, score = sum(c.values()), 0
            for t in set(plain_terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - 90 + (90 * n * n_docs) // n_terms
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        scored.sort(key=lambda row: row[:3])
        out += [(item, rank, row[3], -row[0]) for rank, row in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def test_terms():
    text = "Ab-c1 é中x\tÀB_c\x7fZ\xa0q \x00 9"
    assert [t.decode() for t in terms_of(text.encode())] == plain_terms(text)
    assert terms_of(None) == terms_of(b"") == terms_of(b" .-\n") == []


def random_block(rng, n_docs, n_terms):
    """Sizes, terms and impacts of documents; few different impacts, so ties are many."""
    docs = [sorted(rng.sample(range(n_terms), rng.randint(0, n_terms))) for _ in range(n_docs)]
    impacts = [rng.choice([0, 1, 1, 2, 5, 40]) for d in docs for _ in d]
    return docs, impacts


@pytest.mark.parametrize("seed", range(40))
def test_stop_equals_all_scores(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(search, "FIRST_PLACES", rng.choice([1, 2, 8]))
    n_terms, k = rng.randint(1, 8), rng.choice([1, 3, 10])
    own = np.array(sorted(rng.sample(range(n_terms), rng.randint(1, n_terms))))
    wanted = np.zeros(n_terms, bool)
    wanted[own] = True
    best, scored, first = Best(k), [], 0
    for _ in range(3):
        docs, impacts = random_block(rng, rng.randint(0, 120), n_terms)
        lists = Lists(
            np.array([len(d) for d in docs], np.int64), np.array([t for d in docs for t in d], np.int64),
            np.array(impacts, np.int64), n_terms,
        )
        ids = list(range(first, first + len(docs)))
        entries = iter(impacts)
        for doc_id, doc in zip(ids, docs, strict=True):
            scored.append((-sum(i for t, i in [(t, next(entries)) for t in doc] if wanted[t]), doc_id))
        answer(lists, ids, own, wanted, best)
        assert not lists.met.any() and not lists.seen.any()
        first += len(docs)
    expected = sorted(s for s in scored if s[0] < 0)[:k]
    assert [(row[0], row[2]) for row in best.rows] == expected


def test_stops_before_the_end():
    # One document is far above all others, so reading stops soon.
    n = 5000
    impacts = np.arange(n, 0, -1)
    impacts[0] = 10 * n
    lists = Lists(np.ones(n, np.int64), np.zeros(n, np.int64), impacts, 1)
    best = Best(1)
    assert answer(lists, list(range(n)), np.array([0]), np.ones(1, bool), best) < 50
    assert best.rows == [(-10 * n, False, 0)]


NAMES = "alpha beta gamma delta the of in Über 12 x9".split()


def corpus(rng, n):
    rows = [(i, " ".join(rng.choices(NAMES, k=rng.randint(0, 30)))) for i in range(n)]
    rows += [(i, rows[i][1]) for i in range(0, n, 7)] + [(n + 1, None), (n + 2, ""), (None, "alpha beta"), (None, None)]
    rows += [(n + 3, "alpha " * 3000), (n + 4, "...")]
    return rows


def test_search_equals_all_pairs(spark, docs_of, monkeypatch):
    rng = random.Random(2)
    rows = corpus(rng, 150)
    items = [(i, " ".join(rng.sample(NAMES, 3))) for i in range(12)]
    items += [(3, items[3][1]), (50, None), (51, ""), (52, "nowhere"), (None, "ALPHA über"), (53, "the " * 50)]
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id long, score long")
    monkeypatch.setattr(search, "BLOCK_DOCS", 16)
    expected = plain_search(rows, items)
    assert sorted(map(tuple, best_documents(docs_of(rows), asked).collect()), key=repr) == expected
    # In several passes over the documents, and with another k.
    found = best_documents(docs_of(rows), asked, k=3, item_bytes=400)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_search(rows, items, 3)


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id string, text string")
    some = spark.createDataFrame([("a", "alpha")], "item_id string, text string")
    assert best_documents(docs_of([(1, "alpha")]), none).collect() == []
    assert best_documents(docs_of([]), some).collect() == []
    # The only document has the term, whose weight is then ln(4/3).
    assert [tuple(r) for r in best_documents(docs_of([(1, "alpha")]), some).collect()] == plain_search(
        [(1, "alpha")], [("a", "alpha")]
    )
