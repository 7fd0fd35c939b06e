import itertools
import random

import pytest
from pyspark.sql import functions as F

from shellsieve.llm import mix as mixing
from shellsieve.llm.mix import min_cost_flow, mix, mixed, source_targets


def test_targets():
    assert source_targets([100, 100, 100], [3, 1, 2], 300, 2) == [150.0, 50.0, 100.0]
    targets = source_targets([10, 100, 100], [3, 1, 2], 315, 2)
    assert targets[0] == 20 and sum(targets) == pytest.approx(315)
    assert targets[2] == pytest.approx(2 * targets[1]) and targets[2] <= 200
    assert source_targets([0, 0], [1, 1], 0, 2) == [0, 0] and source_targets([], [], 0, 2) == []


def least_cost(supplies, members, quotas, copies):
    """Cheapest words that meet the quotas as far as can be, by trying everything."""
    best = None
    spaces = []
    for n, m in zip(supplies, members, strict=True):
        spaces.append([x for x in itertools.product(range(copies * n + 1), repeat=len(m)) if sum(x) <= copies * n])
    for choice in itertools.product(*spaces):
        got, cost = [0] * len(quotas), 0
        for n, m, words in zip(supplies, members, choice, strict=True):
            for s, w in zip(m, words, strict=True):
                got[s] += w
            cost += sum(1 + k // n for k in range(sum(words)))
        if all(g <= q for g, q in zip(got, quotas, strict=True)):
            value = (-sum(got), cost)
            best = value if best is None or value < best else best
    return best


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_cheapest(seed):
    rng = random.Random(seed)
    members = [[0], [1], [0, 1]]
    supplies = [rng.randint(0, 3) for _ in members]
    quotas = [rng.randint(0, 7) for _ in range(2)]
    flow = min_cost_flow(supplies, members, quotas, 2)
    got, cost = [0, 0], 0
    for n, f in zip(supplies, flow, strict=True):
        for s, w in f:
            assert w >= 0
            got[s] += w
        words = sum(w for _, w in f)
        assert words <= 2 * n
        cost += sum(1 + k // n for k in range(words))
    assert all(g <= q for g, q in zip(got, quotas, strict=True))
    assert (-sum(got), cost) == least_cost(supplies, members, quotas, 2)


def sources(spark, n=600, seed=0):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["b", "a", "é", "Z", None, "b", "b"])) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x"))


def check(df, rows):
    words, taken, target, source_size = {}, {}, {}, {}
    of = {r.doc_id: r for r in df.collect()}
    for r in rows:
        row = of[r.doc_id]
        n = len((row.text or "").split())
        assert r.size == n and 0 <= r.taken <= 2 * n
        words[row.source] = words.get(row.source, 0) + n
        taken[row.source] = taken.get(row.source, 0) + r.taken
        target[row.source], source_size[row.source] = r.target, r.source_size
    order = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    expected = source_targets([words[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(words.values()), 2)
    assert source_size == words
    assert [target[s] for s in order] == pytest.approx(expected)
    for s in order:
        assert abs(taken[s] - target[s]) <= 16


def test_mix_reaches_its_targets(spark, monkeypatch):
    df = sources(spark)
    rows = mix(df).collect()
    assert len(rows) == 600
    check(df, rows)
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, mix(df.repartition(5)).collect())) == sorted(map(key, rows))
    monkeypatch.setattr(mixing, "ORDERED_ROWS", 0)
    monkeypatch.setattr(mixing, "DIGIT_BITS", 4)
    check(df, mix(df).collect())


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a", "b"] if i % 3 else ["a"]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    found = mix(df, F.col("sources"), weights=(1, 2), share=1.0).collect()
    # Both quotas together are all words once; source b holds two thirds, its quota as many.
    assert sum(r.taken for r in found) == 3000 and {r.copies for r in found} == {1}


def test_odd_rows(spark):
    schema = "doc_id long, text string, source string"
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, "c d e", None), (2, None, "x"), (3, "", "y"), (None, "c d e", None)]
    df = spark.createDataFrame(rows, schema)
    found = mix(df).collect()
    assert len(found) == 6 and all(r.taken in (0, r.size, 2 * r.size) for r in found)
    assert sum(r.size for r in found) == 10
    out = mixed(df)
    assert out.columns == df.columns
    assert out.count() == sum(r.copies for r in found)
    assert mix(df.limit(0)).collect() == [] and mixed(df.limit(0)).collect() == []


def test_mixed_has_as_many_rows_as_copies(spark):
    df = sources(spark, 200, 1)
    copies = {r.doc_id: r.copies for r in mix(df).collect()}
    found = {}
    for r in mixed(df).collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == {i: n for i, n in copies.items() if n}


def test_many_sources(spark):
    """More sources than patterns the flow takes; every one near its target."""
    n = 50_000
    df = spark.range(2 * n).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("w "), (F.col("id") % 7 + F.when(F.col("id") % n == 0, 5000).otherwise(0)).cast("int")).alias("text"),
        F.format_string("s%06d", F.col("id") % n).alias("source"),
    )
    rows = mix(df).collect()
    assert len(rows) == 2 * n
    of, sizes = {}, [0] * n
    for r in rows:
        of.setdefault(r.doc_id % n, []).append(r)
        sizes[r.doc_id % n] += r.size
    targets = source_targets(sizes, [(3, 1, 2)[i % 3] for i in range(n)], 1.5 * sum(sizes), 2)
    for source, some in of.items():
        assert all(r.target == pytest.approx(targets[source]) and r.taken <= 2 * r.size for r in some)
        assert abs(sum(r.taken for r in some) - targets[source]) <= max(r.size for r in some) / 2 + 1


def test_a_long_text_and_overlapping_sources_beside_others(spark):
    rows = [(0, "w " * 200_000, ["z"])] + [(i, "w " * 9, ["a", "b"] if i % 2 else ["c"]) for i in range(1, 200)]
    rows += [(500, "w w", None), (501, "w", [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    found = mix(df, F.col("sources"), weights=(1,), share=1.0).collect()
    by = {r.doc_id: r for r in found}
    assert by[500].taken == by[501].taken == 0 and by[500].target is None
    # Small sources take twice their words; the long text has what they leave.
    assert all(by[i].copies == 2 for i in range(1, 200)) and by[0].copies == 1


def test_too_many_overlapping_patterns(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 3)
    rows = [(i, "w", [f"s{i}", "all"]) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    with pytest.raises(ValueError, match="membership patterns"):
        mix(df, F.col("sources"))
