import hashlib
import random
import re

import pytest

from shellsieve.llm.common import LOWER, UPPER
from shellsieve.llm.decontaminate import contamination, drop_contaminated, remove_spans

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate(str.maketrans(UPPER, LOWER)))


def windows(items, size=10):
    out = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            out.setdefault(tuple(w[i: i + n]), set()).add("" if item is None else str(item))
    return out


def model(docs, items):
    table, out = windows(items), []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in table}:
            for i in range(len(w) - n + 1):
                if names := table.get(tuple(w[i: i + n])):
                    found |= names
                    hit.update(range(i, i + n))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=repr)


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS seed", "1 AS length")


PASSAGE = "Eins zwei DREI vier, fünf sechs sieben acht neun zehn elf zwölf"
ITEMS = [(1, PASSAGE), (2, "short one"), (10, "Word"), (3, None), (4, " !? "), (2, "other text Ñandú"), (None, "null id here")]
DOCS = [
    (1, "x " + PASSAGE.lower() + " y"), (2, "a SHORT-one b"), (3, None), (4, ""), (5, "word"),
    (6, "eins zwei drei vier fünf sechs sieben acht neun"), (7, PASSAGE + " " + PASSAGE), (7, "short one"),
    (None, "null ID here"), (None, "null ID here"), (8, "ÑANDÚ other text ñandú other text Ñandú"),
    (9, "ten " * 40 + PASSAGE + " ten" * 40), (10, "\x00word\x7fword"),
]


def test_equals_the_model(spark, docs_of):
    found = contamination(docs_of(DOCS), benchmark(spark, ITEMS)).collect()
    assert sorted(map(tuple, found), key=repr) == model(DOCS, ITEMS)


@pytest.mark.parametrize("seed", range(2))
def test_few_words_in_random_order(spark, docs_of, seed):
    rng = random.Random(seed)
    text = lambda most: " ".join(rng.choices(["a", "B", "É", "7"], k=rng.randint(0, most)))
    items = [(i, text(14)) for i in range(12)]
    docs = [(i, text(60)) for i in range(40)]
    found = contamination(docs_of(docs), benchmark(spark, items)).collect()
    assert sorted(map(tuple, found), key=repr) == model(docs, items)


def test_drop_and_cut(spark, docs_of):
    items = benchmark(spark, ITEMS)
    dirty = {i for i, *_, hit in model(DOCS, ITEMS) if hit}
    left = drop_contaminated(docs_of(DOCS), items)
    assert left.columns == docs_of(DOCS).columns
    assert {r.doc_id for r in left.collect()} == {6, 3, 4}
    assert {1, 2, 5, 7, 9} <= dirty
    cut = remove_spans(docs_of(DOCS), items)
    assert cut.columns == docs_of(DOCS).columns
    texts = sorted(((r.doc_id, r.text) for r in cut.collect()), key=repr)
    assert (1, "x y") in texts and (2, "a b") in texts and (3, None) in texts and (5, "") in texts
    assert (6, DOCS[5][1]) in texts and (9, "ten " * 40 + ("ten " * 40).strip()) in texts
    assert len(texts) == len(DOCS)


def test_nothing_to_look_for_and_in(spark, docs_of):
    none = benchmark(spark, ITEMS).limit(0)
    sha = hashlib.sha256(b"").hexdigest()
    found = contamination(docs_of([(1, "a b")]), none).collect()
    assert list(map(tuple, found)) == [(1, 2, 0, 0, sha, False)]
    assert contamination(docs_of([]), benchmark(spark, ITEMS)).collect() == []
    assert drop_contaminated(docs_of([(1, "a b")]), none).count() == 1


def test_a_long_text(spark, docs_of):
    text = "lorem ipsum " * 200_000 + PASSAGE
    (row,) = contamination(docs_of([(1, text)]), benchmark(spark, ITEMS[:1])).collect()
    assert (row.n_words, row.n_hit, row.n_items) == (400_012, 12, 1)


def test_no_python_in_the_plan(spark, docs_of):
    df = contamination(docs_of(DOCS), benchmark(spark, ITEMS))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
