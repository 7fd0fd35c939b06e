import random

import numpy as np
import pyarrow as pa
import pytest

from shellsieve.llm import passages
from shellsieve.llm.passages import _pack, _pack_sorted, _unpack, _unpack_sorted, without_repeated_passages

WINDOW = 13


def plain(rows):
    """doc_id, words, removed words and kept text from all windows of all rows."""
    texts = [(i, [w.decode() for w in (t or "").encode().split()]) for i, t in rows]
    first = {}
    for doc_id, words in texts:
        for i in range(len(words) - WINDOW + 1):
            window = tuple(words[i: i + WINDOW])
            if doc_id is not None:
                first[window] = min(doc_id, first.get(window, doc_id))
    out = []
    for doc_id, words in texts:
        gone = set()
        for i in range(len(words) - WINDOW + 1):
            smallest = first.get(tuple(words[i: i + WINDOW]))
            if smallest is not None and (doc_id is None or smallest < doc_id):
                gone.update(range(i, i + WINDOW))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), kept.encode()))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in df.collect()), key=repr)


def test_packed_integers():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**64, 1000, dtype=np.uint64)
    assert (_unpack(_pack(values)) == values).all()
    values.sort()
    assert (_unpack_sorted(_pack_sorted(values)) == values).all()
    assert len(_unpack(_pack(values[:0]))) == 0


NAMES = [f"n{i}" for i in range(400)]


def corpus(seed, n=120):
    """Texts with passages of others, copies, near copies, texts of one repeated word."""
    rng = random.Random(seed)
    shared = [" ".join(rng.choices(NAMES, k=rng.randint(10, 40))) for _ in range(8)]
    rows = []
    for i in rng.sample(range(10 * n), n):
        kind = rng.random()
        text = " ".join(rng.choices(NAMES, k=rng.randint(0, 60)))
        if rows and kind < 0.2:
            text = rng.choice(rows)[1]
        elif kind < 0.5:
            text = f"{text} {rng.choice(shared)}\n{rng.choice(shared)}"
        elif kind < 0.6:
            text = "same " * rng.randint(1, 40)
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_all_windows(docs_of, monkeypatch, seed):
    # Small blocks, parts and automata, so that texts of all of them meet.
    monkeypatch.setattr(passages, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(passages, "PART_KEYS", 500)
    monkeypatch.setattr(passages, "AUTOMATON_WINDOWS", 7)
    rows = corpus(seed)
    assert found(without_repeated_passages(docs_of(rows))) == plain(rows)


TEXT = " ".join(NAMES[:30])
ROWS = [
    (5, TEXT), (2, "x " + TEXT + " y"), (9, TEXT.upper()), (7, None), (8, ""), (3, " ".join(NAMES[:12])),
    (None, TEXT), (None, TEXT + " z"), (5, TEXT), (5, TEXT + " tail"), (11, " ".join(NAMES[100:140]) * 2),
    (12, "long " + "word " * 20_000), (13, "word\t" * 50), (14, "é " * 13), (15, " é " * 13 + "é " * 13),
]


def test_rows_of_every_kind(docs_of):
    assert found(without_repeated_passages(docs_of(ROWS))) == plain(ROWS)
    assert without_repeated_passages(docs_of([])).collect() == []


def test_equal_ids_in_different_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(passages, "BLOCK_BYTES", 1)
    rows = [(5, TEXT)] * 3 + [(4, TEXT), (4, TEXT + " z"), (6, TEXT)]
    assert found(without_repeated_passages(docs_of(rows))) == plain(rows)


def test_shared_keys_never_remove_other_words():
    """A phrase sent by mistake, as by two windows of one key, removes nothing it does not equal."""
    blob = pa.BufferOutputStream()
    table = pa.table({"doc_id": pa.array([7]), "text": pa.array([TEXT.encode()], pa.binary())})
    with pa.ipc.new_stream(blob, table.schema) as stream:
        stream.write_table(table)
    blocks = pa.table({"block": [0], "blob": pa.array([blob.getvalue().to_pybytes()], pa.binary())})
    wrong = " ".join([*NAMES[:12], "other"]).encode()
    right = " ".join(["other", *NAMES[3:16], "unknown"]).encode()
    sent = pa.table({"block": [0, 0], "first": [1, 2], "words": pa.array([wrong, right], pa.binary())})
    row = passages._kept(blocks, sent).to_pylist()[0]
    assert row["n_removed"] == 13
    assert row["kept"] == " ".join(NAMES[:3] + NAMES[16:30]).encode()
