import hashlib
import random
import zlib

import pytest

from shellsieve.llm import periods
from shellsieve.llm.periods import periodic_runs, runs_of, with_planted_runs
from shellsieve.llm.queries import op11_periodic_runs

SMALL = "/root/testdata/sf0.001"


def plain_runs(words, least):
    """Every period, every maximal stretch that has it; only those of no smaller period."""
    out = []
    for period in range(1, len(words) // 2 + 1):
        at = 0
        while at + period < len(words):
            if words[at] != words[at + period]:
                at += 1
                continue
            start = at
            while at + period < len(words) and words[at] == words[at + period]:
                at += 1
            length = at + period - start
            part = words[start: start + length]
            smaller = any(part[r:] == part[:-r] for r in range(1, period))
            if length >= max(least, 2 * period) and not smaller:
                out.append((start, length, period))
    return sorted(out, key=lambda run: (run[0], run[2]))


def plain_collapse(words, runs):
    out = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in out)


def random_words(rng):
    letters = rng.choice([1, 2, 3, 5])
    words = [rng.randrange(letters) for _ in range(rng.randint(0, 60))]
    if words and rng.random() < 0.6:
        words += words[: rng.randint(1, len(words))] * rng.randint(1, 6)
        words += [rng.randrange(letters) for _ in range(rng.randint(0, 8))]
    return words


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_equal_all_periods(least):
    rng = random.Random(least)
    for _ in range(150):
        texts = [random_words(rng) for _ in range(rng.randint(0, 6))]
        assert runs_of(texts, least) == [plain_runs(t, least) for t in texts]


def test_fibonacci_words_and_high_powers():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert runs_of([b, [7] * 500, b[:100]], 12) == [plain_runs(b, 12), [(0, 500, 1)], plain_runs(b[:100], 12)]


def test_long_texts_take_a_moment():
    rng = random.Random(5)
    base = [rng.randrange(50) for _ in range(30)]
    # One long run, and a phrase that follows 5,000 different words.
    phrases = [w for i in range(5000) for w in (1000 + i, 1, 2, 3, 4, 5, 6, 7, 10_000 + i)]
    assert runs_of([base * 1500, phrases], 12) == [[(0, 45_000, 30)], []]


ROWS = [
    (1, "a b c " * 4), (2, None), (3, ""), (4, " \n\t "), (None, "x " * 12), (1, "a b c " * 4),
    (6, "one two\x0bthree four"), (7, "w " * 11), (8, "é è " * 20 + "end"),
]


def test_rows_of_every_kind(docs_of, monkeypatch):
    monkeypatch.setattr(periods, "BATCH_WORDS", 20)
    found = periodic_runs(docs_of(ROWS)).collect()
    expected = []
    for doc_id, text in ROWS:
        words = [w.decode() for w in (text or "").encode().split()]
        runs = plain_runs(words, 12)
        expected.append((doc_id, runs, plain_collapse(words, runs).encode()))
    assert sorted(((r.doc_id, [tuple(x) for x in r.runs], bytes(r.collapsed)) for r in found), key=repr) == sorted(
        expected, key=repr
    )
    assert periodic_runs(docs_of([])).collect() == []


def plain_planted(doc_id, words):
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_planted_parts(docs_of):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 70))) for i in range(300)] + [(None, "a b"), (4, None)]
    found = with_planted_runs(docs_of(rows)).collect()
    assert [(r.doc_id, (r.text or "").split()) for r in found] == [
        (i, plain_planted(i, (t or "").split()) if i is not None else t.split()) for i, t in rows
    ]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    expected = {}
    for row in docs:
        words = plain_planted(row.doc_id, [w.decode() for w in (row.text or "").encode().split()])
        runs = plain_runs(words, 12) if len(words) <= 400 else None
        if runs is None:
            continue
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        expected[row.doc_id] = (
            len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(plain_collapse(words, runs).encode()).hexdigest(),
        )
    found = {r.doc_id: tuple(r)[1:] for r in op11_periodic_runs(spark, SMALL).collect()}
    assert len(found) == len(docs) and len(expected) > 0.6 * len(docs)
    assert sum(e[0] > 0 for e in expected.values()) > 10
    assert {i: found[i] for i in expected} == expected
