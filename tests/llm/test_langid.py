import zlib
from functools import partial

import numpy as np
import pytest

from shellsieve.llm import langid
from shellsieve.llm.langid import Model, drop_undetermined, fit, identify_languages

SMALL = "/root/testdata/sf0.01"


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    model = Model.start(["a", "b", "c"], hidden=3)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    runs = rng.integers(97, 101, (5, 4)).astype(np.uint8)
    inside, label = np.ones((5, 4), np.float32), np.array([0, 1, 2, 1])
    inside[3:, 1] = 0

    def loss():
        picked = model.positions(runs)[:, label, np.arange(4)]
        return -(np.log(picked) * inside).sum() / inside.sum()

    for name, grad in model.gradients(runs, inside, label).items():
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        weight, value = model.weights[name], model.weights[name][at]
        weight[at] = value + 0.01
        above = loss()
        weight[at] = value - 0.01
        slope = (above - loss()) / 0.02
        weight[at] = value
        assert slope == pytest.approx(float(grad[at]), rel=0.01)


def test_pooling_equals_one_text_at_a_time(monkeypatch):
    model = fit([("x", b"abab" * 16), ("y", b"cdcd" * 16), ("x", b"ab")], steps=5)
    texts = [b"", b"a", b"ab" * 32, b"abcd" * 100, b"d" * 65]
    monkeypatch.setattr(langid, "BATCH", 3)
    pooled = model.pooled(texts)
    assert np.allclose(pooled[1:].sum(axis=1), 1) and not pooled[0].any()
    for text, row in zip(texts[1:], pooled[1:], strict=True):
        pieces = [text[i: i + langid.RUN] for i in range(0, len(text), langid.RUN)]
        total = 0
        for piece in pieces:
            runs = np.frombuffer(piece.ljust(langid.RUN, b"\0"), np.uint8)[:, None]
            total = total + model.positions(np.ascontiguousarray(runs))[: len(piece), :, 0].sum(axis=0)
        assert np.allclose(total / len(text), row, atol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = identify_languages(docs).collect()
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string, found int"
    good = [(i, "the cat and the dog " * 20 if i % 2 else "der hund und die katze " * 20, "en" if i % 2 else "de", "", 1) for i in range(60)]
    odd = [(100, None, "en", "", 1), (101, "", "de", "", 1), (102, "123 !?", None, "", 1), (None, "the dog and the cat", "en", "", 1), (103, "the cat " * 100_000, None, "", 1)]
    df = spark.createDataFrame(good + odd, schema)
    found = {r.doc_id: r for r in identify_languages(df).collect()}
    assert [found[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3
    assert [found[i].score for i in (100, 101, 102)] == [0.0] * 3
    assert found[103].lang_pred == "en" and found[None].lang_pred == "en" and found[None].held_out
    kept = drop_undetermined(df)
    assert kept.columns == df.columns and kept.count() == 62
    assert identify_languages(df.limit(0)).collect() == []
    nothing = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    (row,) = identify_languages(nothing).collect()
    assert (row.lang_pred, row.score) == ("und", 0.0)


def test_scores_decide_what_is_undetermined(spark):
    parts = {"x": "abc ", "y": "fgh ", "z": "pqr "}
    rows = [(i, part * (20 + i), lang) for lang, part in parts.items() for i in range(10)]
    rows.append((99, "".join(part * 40 for part in parts.values()), None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in drop_undetermined(docs).collect()) == sorted(list(range(10)) * 3)


def test_texts_stay_where_nothing_can_be_learned(spark):
    rows = [(1, "some text", None), (2, "12 34", None), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [r.doc_id for r in drop_undetermined(docs).collect()] == [1]


def test_a_language_of_few_different_texts_is_learned(spark):
    """Copies do not take a language's texts out of the sample."""
    few = [(f"{c * 3}{c} {c}{c}", "few") for c in "abcdefghij"] * 4000
    many = [(f"zz {i}", "many") for i in range(300)]
    df = spark.createDataFrame(few + many, "text string, lang string")
    for seed in range(3):
        found = langid._sample(df, seed)
        assert {run for lang, run in found if lang == "few"} == {t.encode() for t, _ in few}
        assert sum(lang == "few" for lang, _ in found) == 10
        assert sum(lang == "many" for lang, _ in found) == langid.TEXTS


def test_many_languages(spark, monkeypatch):
    """Hundreds of languages are learned and told apart; no text of a known one is dropped."""
    monkeypatch.setattr(langid, "fit", partial(fit, steps=3))
    rows = [(3 * i + j, f"{i:03d} word {'abc'[j]} " * 5, f"l{i}") for i in range(600) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = identify_languages(docs).collect()
    assert len(found) == 1800 and {r.lang_pred for r in found} <= {f"l{i}" for i in range(600)}
    assert all(0 <= r.score <= 1 for r in found)
    assert drop_undetermined(docs).count() >= 0.98 * 1800
