import random

import xxhash

from shellsieve.llm import simhash
from shellsieve.llm.components import components
from shellsieve.llm.simhash import drop_near_duplicates, fingerprint, links, near_duplicates


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i: i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def classes(prints):
    """Component of every value: linked at two differing bits or fewer."""
    prints = sorted(set(prints))
    return roots(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2])


def test_fingerprint(monkeypatch):
    texts = ["", " \n", "a", "A b", "a b c", "x y z w " * 50, "É é É é", "a b c d", "\x1ca b c"]
    for text in texts:
        assert fingerprint(text.encode()) & (1 << 64) - 1 == plain_fingerprint(text)
    assert fingerprint(None) == 0
    long = " ".join(random.Random(1).choices("abcdefgh", k=5000))
    monkeypatch.setattr(simhash, "PIECE_BYTES", 37)
    monkeypatch.setattr(simhash, "PIECE_SHINGLES", 11)
    assert fingerprint(long.encode()) & (1 << 64) - 1 == plain_fingerprint(long)


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def near_values(rng, centers, around):
    out = []
    for _ in range(centers):
        center = rng.getrandbits(64)
        for _ in range(around):
            value = center
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                value ^= 1 << bit
            out.append(value)
    return out


def connected(spark, values):
    df = spark.createDataFrame([(signed(v),) for v in set(values)], "fp long")
    pairs = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in links(df).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    return roots(set(values), pairs)


def partition(of):
    out = {}
    for value, root in of.items():
        out.setdefault(root, set()).add(value)
    return sorted(map(sorted, out.values()))


def test_links_connect_as_all_pairs_do(spark):
    values = near_values(random.Random(3), 12, 25) + [0, 1, 3, 1 << 63, (1 << 64) - 1]
    assert partition(connected(spark, values)) == partition(classes(values))


def test_frequent_keys_connect_the_same(spark, monkeypatch):
    values = near_values(random.Random(4), 3, 60)
    for bound in (1, 5):
        monkeypatch.setattr(simhash, "PAIRED_UP_TO", bound)
        assert partition(connected(spark, values)) == partition(classes(values))


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)]
    pairs += [(7, 7), (300, 200), (200, 300), (300, 250)]
    df = spark.createDataFrame(pairs, "a long, b long")
    expected = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}
    expected |= {200: 200, 250: 200, 300: 200}
    found = {r.node: r.root for r in components(df).collect()}
    assert all(found.get(n, n) == root for n, root in expected.items()) and 7 in expected
    assert components(df.limit(0)).collect() == []


TEXT = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf " * 30
ROWS = [
    (5, TEXT), (2, TEXT), (9, TEXT.upper()), (7, None), (8, ""), (3, "a b"), (4, "c d"), (None, "a  B"),
    (None, "only null"), (11, TEXT + "now"), (3, "a b"),
]


def test_near_duplicates(docs_of):
    prints = {i: plain_fingerprint(t) for i, t in enumerate([t for _, t in ROWS])}
    of = classes(prints.values())
    least = {}
    for k, (doc_id, _) in enumerate(ROWS):
        if doc_id is not None:
            root = of[prints[k]]
            least[root] = min(least.get(root, doc_id), doc_id)
    expected = [(i, f"{prints[k]:016x}", least.get(of[prints[k]])) for k, (i, _) in enumerate(ROWS)]
    found = near_duplicates(docs_of(ROWS)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def test_one_row_of_each_group_stays(docs_of):
    kept = drop_near_duplicates(docs_of(ROWS))
    assert kept.columns == docs_of(ROWS).columns
    groups = {r.component_id for r in near_duplicates(docs_of(ROWS)).collect()}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(groups, key=repr)


def test_empty_table(docs_of):
    assert near_duplicates(docs_of([])).collect() == []
    assert drop_near_duplicates(docs_of([])).collect() == []
