"""Language of texts by a bidirectional gated recurrent network over bytes.

A text is cut into runs of equal length. Over each run one network goes forwards and one
backwards, a byte a step; both states at a byte give the probabilities of the languages
there, and a text's are the mean over all its bytes. The network is trained in numpy by
backpropagation through time on a bounded sample of labelled texts.

The state of a direction is h. With the byte's input a and u = U h, update gate z, reset gate
r and candidate n are

    z = g(a_z + u_z),  r = g(a_r + u_r),  n = s(a_n + r u_n),  h' = h + z (n - h)

with s(x) = x / (1 + |x|) and g(x) = (1 + s(x)) / 2, which cost no exponential.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shellsieve.llm.common import col, ship, sized_broadcast
from shellsieve.sources.checkpoints import Scratch

#: Bytes of a run, size of a state, and runs that go through the network at once.
RUN, HIDDEN, BATCH = 64, 8, 4096
#: The sample: texts of a language and runs of a text (spread over all of it).
TEXTS, RUNS = 240, 24
STEPS, STEP_RUNS, RATE, SEED = 150, 512, 0.02, 42
UNDETERMINED = "und"
#: Share of the texts not learned from whose scores may lie below the mark a stage goes by.
LEAST_SHARE = 0.001


def _soft(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x)
    scale += 1
    x /= scale
    return x


def _slope(s: np.ndarray) -> np.ndarray:
    """Derivative of s by its value."""
    out = 1 - np.abs(s)
    return out * out


@dataclass
class Model:
    """Weights by name: for the directions f and b input E, bias-free U; output W and c."""

    languages: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def start(cls, languages: Sequence[str], hidden: int = HIDDEN, seed: int = SEED) -> Model:
        rng, k = np.random.default_rng(seed), len(languages)
        put = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        return cls(list(languages), {
            "Ef": put(3 * hidden, 256), "Uf": put(3 * hidden, hidden),
            "Eb": put(3 * hidden, 256), "Ub": put(3 * hidden, hidden),
            "W": put(k, 2 * hidden), "c": np.zeros((k, 1), np.float32),
        })

    def states(self, runs: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """States (step, feature, run) of one direction over ``runs`` (step, run)."""
        inputs, recur = self.weights["E" + way], self.weights["U" + way]
        hidden, (steps, n) = recur.shape[1], runs.shape
        out = np.empty((steps, hidden, n), np.float32)
        h, a = np.zeros((hidden, n), np.float32), np.empty((3 * hidden, n), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            np.take(inputs, runs[t], axis=1, out=a, mode="clip")
            u = recur @ h
            a[: 2 * hidden] += u[: 2 * hidden]
            s = _soft(a[: 2 * hidden])
            if keep is not None:
                s = s.copy()
            gates = s * np.float32(0.5)
            gates += np.float32(0.5)
            z, r = gates[:hidden], gates[hidden:]
            x = a[2 * hidden:]
            x += r * u[2 * hidden:]
            cand = _soft(x)
            if keep is not None:
                cand = cand.copy()
                keep.append((t, h, s, z, r, u[2 * hidden:], cand))
            change = cand - h
            change *= z
            h = np.add(h, change, out=out[t])
        return out

    def positions(self, runs: np.ndarray) -> np.ndarray:
        """Probabilities (step, language, run) at every byte of ``runs`` (step, run)."""
        w, hidden = self.weights["W"], self.weights["Uf"].shape[1]
        scores = np.matmul(w[:, :hidden], self.states(runs, "f"))
        scores += np.matmul(w[:, hidden:], self.states(runs, "b"))
        scores += self.weights["c"]
        scores -= scores.max(axis=1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=1, keepdims=True)
        return scores

    def pooled(self, texts: Sequence[bytes], run: int = RUN) -> np.ndarray:
        """Mean probabilities (text, language) over all bytes of each text."""
        n_runs = np.array([-(-len(x) // run) for x in texts])
        total = np.zeros((len(texts), len(self.languages)))
        owner = np.repeat(np.arange(len(texts)), n_runs)
        data = np.zeros((len(owner), run), np.uint8)
        flat, at = data.reshape(-1), 0
        for text, n in zip(texts, n_runs.tolist(), strict=True):
            flat[at: at + len(text)] = np.frombuffer(text, np.uint8)
            at += n * run
        length = np.full(len(owner), run)
        last = np.cumsum(n_runs) - 1
        size = np.array([len(x) for x in texts])
        length[last[n_runs > 0]] = (size - (n_runs - 1) * run)[n_runs > 0]
        # Of many languages fewer runs at once, so that their probabilities stay as small.
        batch = max(64, BATCH * 16 // max(16, len(self.languages)))
        for lo in range(0, len(owner), batch):
            part = slice(lo, lo + batch)
            probs = self.positions(np.ascontiguousarray(data[part].T))
            inside = np.arange(run)[:, None] < length[part]
            sums = np.einsum("tkn,tn->nk", probs, inside.astype(np.float32))
            np.add.at(total, owner[part], sums)
        return total / np.maximum(size, 1)[:, None]

    def gradients(self, runs: np.ndarray, inside: np.ndarray, label: np.ndarray):
        """Of the mean cross-entropy over the bytes ``inside``, by backpropagation through time."""
        w, hidden = self.weights["W"], self.weights["Uf"].shape[1]
        kept = {"f": [], "b": []}
        states = {way: self.states(runs, way, kept[way]) for way in "fb"}
        scores = np.matmul(w[:, :hidden], states["f"]) + np.matmul(w[:, hidden:], states["b"])
        scores += self.weights["c"]
        scores -= scores.max(axis=1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=1, keepdims=True)
        scores[:, label, np.arange(len(label))] -= 1
        scores *= inside[:, None, :] / max(inside.sum(), 1)
        out = {
            "W": np.concatenate(
                [np.einsum("tkn,thn->kh", scores, states[way], optimize=True) for way in "fb"], axis=1
            ),
            "c": scores.sum(axis=(0, 2))[:, None],
        }
        for way, columns in (("f", slice(0, hidden)), ("b", slice(hidden, 2 * hidden))):
            recur = self.weights["U" + way]
            to_inputs = np.zeros((len(runs), 3 * hidden, runs.shape[1]), np.float32)
            grad, dh = np.zeros_like(recur), np.zeros((hidden, runs.shape[1]), np.float32)
            for t, h, s, z, r, un, cand in reversed(kept[way]):
                dh = dh + w[:, columns].T @ scores[t]
                dn = dh * z * _slope(cand)
                dgates = np.concatenate([dh * (cand - h), dn * un]) * _slope(s) * 0.5
                du = np.concatenate([dgates, dn * r])
                to_inputs[t, : 2 * hidden], to_inputs[t, 2 * hidden:] = dgates, dn
                grad += du @ h.T
                dh = dh * (1 - z) + recur.T @ du
            flat = runs.reshape(-1)
            rows = to_inputs.transpose(1, 0, 2).reshape(3 * hidden, -1)
            out["U" + way] = grad
            out["E" + way] = np.stack([np.bincount(flat, row, 256) for row in rows])
        return out


def fit(samples: Sequence[tuple[str, bytes]], run: int = RUN, steps: int = STEPS, seed: int = SEED) -> Model:
    """A model for runs of bytes and their languages; languages weigh the same."""
    model = Model.start(sorted({language for language, _ in samples}), seed=seed)
    if not model.languages:
        return model
    number = {language: i for i, language in enumerate(model.languages)}
    by: list[list[bytes]] = [[] for _ in model.languages]
    for language, data in samples:
        if data:
            by[number[language]].append(data[:run])
    filled = [i for i, runs in enumerate(by) if runs]
    if not filled:
        return model
    tables, lengths = {}, {}
    for i in filled:
        tables[i] = np.stack([np.frombuffer(x.ljust(run, b"\0"), np.uint8) for x in by[i]])
        lengths[i] = np.array([len(x) for x in by[i]])
    rng = np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v, np.float64), np.zeros_like(v, np.float64)) for k, v in model.weights.items()}
    for step in range(1, steps + 1):
        label = rng.choice(filled, STEP_RUNS)
        pick = [rng.integers(len(tables[i])) for i in label]
        runs = np.ascontiguousarray(np.stack([tables[i][j] for i, j in zip(label, pick, strict=True)]).T)
        length = np.array([lengths[i][j] for i, j in zip(label, pick, strict=True)])
        inside = (np.arange(run)[:, None] < length).astype(np.float32)
        rate = RATE * (1 - (step - 1) / steps)
        for name, grad in model.gradients(runs, inside, label).items():
            first, second = moments[name]
            first += 0.1 * (grad - first)
            second += 0.001 * (grad * grad - second)
            move = first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            model.weights[name] = (model.weights[name] - rate * move).astype(np.float32)
    return model


def _sample(labelled: DataFrame, seed: int) -> list[tuple[str, bytes]]:
    """At most ``TEXTS`` texts of each language, at most ``RUNS`` runs spread over each."""
    # Different texts count, by their hash, so that copies neither crowd out others nor pile up.
    labelled = labelled.withColumn("order", F.xxhash64(F.lit(seed), "text"))
    scratch = Scratch(labelled.sparkSession)
    different = scratch.stored(labelled.select("lang", "order").distinct(), "sample-texts")
    counts = different.groupBy("lang").agg(F.count("*").alias("n"))
    # Of a language's texts about three times as many as needed go to the ranking.
    some = F.pmod("order", F.lit(1 << 20)) * F.col("n") < F.lit((1 << 20) * 3 * TEXTS)
    few = different.join(sized_broadcast(scratch.stored(counts, "sample-counts"), 64), "lang").filter(some)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    wanted = few.select("lang", "order").withColumn("rank", rank).filter(F.col("rank") <= TEXTS)
    wanted = sized_broadcast(scratch.stored(wanted.select("lang", "order"), "sample-chosen"), 64)
    chosen = labelled.join(wanted, ["lang", "order"]).groupBy("lang", "order").agg(F.min("text").alias("text"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                n = -(-len(text) // RUN)
                for i in sorted({j * n // RUNS for j in range(min(RUNS, n))} if n > RUNS else range(n)):
                    out.append((lang, text[i * RUN: (i + 1) * RUN]))
            yield pd.DataFrame(out, columns=["lang", "run"])

    runs = chosen.select("lang", F.col("text").cast("binary").alias("text"))
    rows = runs.mapInPandas(cut, "lang string, run binary").collect()
    scratch.drop()
    return sorted((lang, bytes(run)) for lang, run in rows)


def train(
    docs: DataFrame,
    learn: Column | None = None,
    text_col: str = "text",
    lang_col: str = "lang",
    seed: int = SEED,
) -> Model:
    """A model learned from text and language of rows where ``learn`` holds and neither is null.

    The sample is bounded: ``TEXTS`` texts a language, chosen by a hash of the text, and
    ``RUNS`` runs of ``RUN`` bytes of a text, spread over the whole of it.
    """
    ship(docs.sparkSession)
    rows = docs if learn is None else docs.filter(learn)
    rows = rows.select(
        col(lang_col).cast("string").alias("lang"), col(text_col).cast("string").alias("text")
    ).filter("lang is not null and text is not null")
    return fit(_sample(rows, seed), seed=seed)


def predictions(text: Column, model: Model) -> Column:
    """A struct of lang and score; the score is the pooled probability of the language."""

    @F.pandas_udf("lang string, score double")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            known = [i for i, x in enumerate(texts) if x is not None] if model.languages else []
            while known:
                # About 8 MB at once, or a single longer text.
                take, size = 0, 0
                while take < len(known) and (not take or size + len(texts.iat[known[take]]) < 8 << 20):
                    size += len(texts.iat[known[take]])
                    take += 1
                part, known = known[:take], known[take:]
                pooled = model.pooled([texts.iat[i] for i in part])
                best = pooled.argmax(axis=1)
                for i, k, row in zip(part, best.tolist(), pooled, strict=True):
                    langs[i], scores[i] = model.languages[k], min(max(float(row[k]), 0.0), 1.0)
            yield pd.DataFrame({"lang": langs, "score": scores})

    return identify(F.when(_letters(text), text.cast("string").cast("binary")))


def _letters(text: Column) -> Column:
    return text.cast("string").rlike(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: a fifth by crc32 of its id; null ids are."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, by a model of the rows not held out.

    ``lang_pred`` is ``und`` with score 0 where the text is null or has no letter, and
    everywhere if there is nothing to learn from. The whole text counts, whatever its length.
    An empty table gives no rows.
    """
    model = train(docs, ~held_out(col(id_col)), text_col, lang_col)
    return docs.select(
        col(id_col).alias("doc_id"),
        held_out(col(id_col)).alias("held_out"),
        predictions(col(text_col), model).alias("found"),
    ).select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")


def least_score(docs: DataFrame, model: Model, learn: Column, text_col: str, lang_col: str) -> float:
    """The score below which a text's language counts as undetermined.

    It lies halfway between chance, which depends on the number of languages, and the score that
    all but ``LEAST_SHARE`` of the labelled texts with letters reach that were not learned from;
    0 if there are none such.
    """
    rows = docs.filter(~learn & col(lang_col).isNotNull() & _letters(col(text_col)))
    scores = rows.select(predictions(col(text_col), model)["score"].alias("score"))
    reached = scores.agg(F.percentile_approx("score", LEAST_SHARE, 100_000)).first()[0]
    chance = 1 / len(model.languages)
    return 0.0 if reached is None else min(reached, (reached + chance) / 2)


def drop_undetermined(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``docs`` without the rows whose language stays undetermined.

    That are rows without letters, null and empty texts among them, and those whose best language
    scores less than ``least_score``. If there is nothing to learn from, rows with letters stay. An empty
    table stays empty.
    """
    learn = ~held_out(col(id_col))
    model = train(docs, learn, text_col, lang_col)
    if not model.languages:
        return docs.filter(_letters(col(text_col)))
    least = least_score(docs, model, learn, text_col, lang_col)
    found = predictions(col(text_col), model)
    return docs.filter((found["lang"] != UNDETERMINED) & (found["score"] >= least))
