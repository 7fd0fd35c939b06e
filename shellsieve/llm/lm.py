"""Stupid-backoff scores of documents under a bigram model of the corpus.

A word w after b scores log c(b w) - log c(b .), the count of b before any word, if the pair
occurs at least ``min_count`` times in the corpus, and else log a + log c(w) - log N. The
first word of a text scores log c(w) - log N. Logs are rounded to millionths, so that sums do
not depend on their order.

All of it is relational. Words have 64-bit keys and are counted by a grouping. Texts are
exploded into their pairs, each once a text with its times. Pairs are dealt by hash and grouped to
a count table, which is joined with the count table of words for the counts of first words; the exploded pairs
are joined with it, and their gains are summed per document. Where the first word is frequent a pair is dealt by both
of its words, and the first one's count is broadcast, so that no word gathers anywhere. Words that are more than one in
``HOT_SHARE`` of all words are hot: pairs of two such words are at most ``HOT_SHARE`` squared, are counted
in each task first, and their count table is broadcast to the exploded pairs.

What crosses the network is a row for a block of texts, a bucket of the dealing and a kind of pair,
with the pairs, the places of their texts in the block, and times in lists. The ``NUMBERED`` most
frequent words go by a number of two bytes. The row that names the texts of a block travels along,
so that places are understood whatever order the texts are read in.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shellsieve.llm.common import col, digest, ship
from shellsieve.operators.findings import numbered
from shellsieve.sources.checkpoints import Scratch, stored

BACKOFF, SCALE = 0.4, 1_000_000
#: A word is hot if it is more than one in so many; so there are fewer hot words than this.
HOT_SHARE = 700
#: At most so many of the most frequent words have a number of two bytes; which ones changes no score.
NUMBERED = 32_000
#: Words and texts of a block, which are exploded together; a longer text ends its block.
BATCH_WORDS, BATCH_TEXTS = 1 << 18, 30_000
#: Words whose pairs are counted together, in one bucket.
PARTITION_WORDS = 2_000_000
#: Different words that a task counts at once.
COUNTED_WORDS = 400_000
#: The key of words outside a vocabulary.
UNKNOWN = 0


def word_counts(rows: DataFrame) -> DataFrame:
    """word (binary) and n, over all texts of ``rows`` (text)."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = Counter()
        for frame in frames:
            for text in frame["text"]:
                found.update((text or b"").lower().split())
                if len(found) >= COUNTED_WORDS:
                    yield pd.DataFrame({"word": list(found), "n": list(found.values())})
                    found.clear()
        if found:
            yield pd.DataFrame({"word": list(found), "n": list(found.values())})

    counted = rows.select("text").mapInPandas(count, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> list[bytes]:
    """The ``most`` most frequent words, ties in the order of their bytes.

    A power of two below the count of the last of them is found first; the words above it are
    numbered by a range sort, so that no task and not the driver gets more than it returns.
    """
    powers = [1 << k for k in range(63)]
    above = counts.agg(*(F.count_if(F.col("n") >= p) for p in powers)).first()
    least = max((p for p, n in zip(powers, above, strict=True) if n >= most), default=1)
    listed = numbered(counts.filter(F.col("n") >= least), [F.desc("n"), F.asc("word")], "place", costly=False)
    return [bytes(r.word) for r in listed.filter(F.col("place") <= most).collect()]


class Batch:
    """Some texts: keys of the words, and each text's words as places in the list of keys."""

    def __init__(self, texts: list[list[bytes]], known: set[bytes] | None):
        self.sizes = np.array([len(words) for words in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        # A word that is asked for the first time gets the next number.
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        numbered = map(numbers.__getitem__, chain.from_iterable(texts))
        self.codes = np.fromiter(numbered, np.int64, int(self.sizes.sum()))
        keys = (xxhash.xxh64_intdigest(w) if known is None or w in known else UNKNOWN for w in numbers)
        self.keys = np.fromiter(keys, np.uint64, len(numbers)).view(np.int64)
        if known is not None:
            # Words that share a key are one word.
            self.keys, at = np.unique(self.keys, return_inverse=True)
            self.codes = at[self.codes]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, their times, and how often each ends a text."""
        times = np.bincount(self.codes, minlength=len(self.keys))
        last = self.codes[self.ends[self.sizes > 0] - 1]
        return self.keys, times, np.bincount(last, minlength=len(self.keys))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word, second word and times of the different pairs of each text."""
        text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        inside = np.flatnonzero(text[1:] == text[:-1]) if len(text) else np.zeros(0, np.int64)
        bits = len(self.keys).bit_length()
        both = (text[inside] << (2 * bits)) | (self.codes[inside] << bits) | self.codes[inside + 1]
        both, times = np.unique(both, return_counts=True)
        mask = (1 << bits) - 1
        return both >> (2 * bits), (both >> bits) & mask, both & mask, times


def _batches(batches: Iterator[pa.RecordBatch], known) -> Iterator[tuple[pa.RecordBatch, Batch]]:
    """Rows (doc_id, digest, text) and their words, some texts at once."""
    for batch in batches:
        held, size, start = [], 0, 0
        for at, text in enumerate(batch.column(2)):
            held.append((text.as_py() or b"").lower().split())
            size += len(held[-1])
            if size >= BATCH_WORDS or len(held) >= BATCH_TEXTS or at == batch.num_rows - 1:
                yield batch.slice(start, at + 1 - start), Batch(held, known)
                held, size, start = [], 0, at + 1


def _counted_words(rows: DataFrame, shared) -> DataFrame:
    """word (key), n and follows: how often it occurs, and how often before another word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, batch in _batches(batches, shared.value):
            keys, times, ends = batch.words()
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(times), pa.array(times - ends)], ["word", "n", "follows"]
            )

    counted = rows.mapInArrow(count, "word long, n long, follows long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("follows").alias("follows"))


def _hot_counts(rows: DataFrame, shared, numbered) -> DataFrame:
    """before, word and pair, their count, for pairs of two hot words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, _, hot = numbered.value
        for _, batch in _batches(batches, shared.value):
            is_hot = np.isin(batch.keys, keys[hot])[batch.codes]
            is_hot = is_hot[:-1] & is_hot[1:]
            is_hot[batch.ends[(batch.ends > 0) & (batch.ends < len(batch.codes))] - 1] = False
            at = np.flatnonzero(is_hot)
            both, times = np.unique(batch.codes[at] * len(batch.keys) + batch.codes[at + 1], return_counts=True)
            before, word = np.divmod(both, max(len(batch.keys), 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.keys[before]), pa.array(batch.keys[word]), pa.array(times)],
                ["before", "word", "pair"],
            )

    counted = rows.mapInArrow(count, "before long, word long, pair long")
    return counted.groupBy("before", "word").agg(F.sum("pair").alias("pair"))


def _lists(values, sizes: np.ndarray) -> pa.ListArray:
    """``values`` cut into lists of the given sizes."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values if isinstance(values, pa.Array) else pa.array(values))


def _block_pairs(rows: DataFrame, shared, numbered, buckets: int) -> DataFrame:
    """All pairs in lists, by block of texts, bucket and kind; ``place`` and ``n`` hold their texts and times.

    ``hot`` holds pairs of two hot words, as the place of the first among the hot words times their
    number, and that of the second. Of other pairs ``first_number`` or ``first`` holds the first words,
    ``second_number`` or ``second`` the second ones. One more row a block has ``doc`` of its texts: id,
    digest, number of words, first word. A pair is dealt by both words if the first has a number, else
    by the first; pairs of hot words stay together, since they need no others of their kind.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    types = {
        "block": "long", "bucket": "int", "place": "array<short>", "n": "array<int>",
        "hot": "array<int>", "first_number": "array<short>", "second_number": "array<short>",
        "first": "array<long>", "second": "array<long>",
        "doc": f"array<struct<doc_id:{kind},digest:long,n_words:long,head:long>>",
    }

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers, hot = numbered.value
        hot_keys = keys[hot]
        for rows, batch in _batches(batches, shared.value):
            texts = rows.num_rows
            name = xxhash.xxh64(rows.column(1).to_numpy(zero_copy_only=False).tobytes())
            name.update(repr(rows.column(0).to_pylist()))
            block = int(np.uint64(name.intdigest()).view(np.int64))
            at = np.searchsorted(keys, batch.keys)
            number = np.append(numbers, np.int16(-1))[at]
            number[np.append(keys, 0)[at] != batch.keys] = -1
            is_hot = (number >= 0) & np.append(hot, False)[at]
            hot_at = np.searchsorted(hot_keys, batch.keys)
            text, before, word, times = batch.pairs()
            filled = batch.sizes > 0
            head = np.zeros(texts, np.int64)
            head[filled] = batch.keys[batch.codes[(batch.ends - batch.sizes)[filled]]]
            doc = pa.StructArray.from_arrays(
                [rows.column(0), rows.column(1), pa.array(batch.sizes), pa.array(head, mask=~filled)],
                ["doc_id", "digest", "n_words", "head"],
            )
            far = number < 0
            dealt = batch.keys.view(np.uint64) >> np.uint64(8)
            both = dealt[before] + np.where(far[before], np.uint64(0), dealt[word] * np.uint64(0x9E3779B97F4A7C15 >> 8))
            group = (both % np.uint64(buckets)).astype(np.int64) * 5 + far[before] * 2 + far[word]
            group = np.where(is_hot[before] & is_hot[word], block % buckets * 5 + 4, group)
            order = np.argsort(group, kind="stable")
            group, text, before, word, times = (x[order] for x in (group, text, before, word, times))
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            sizes, group = np.diff(starts, append=len(group)), group[starts]
            none = np.zeros(len(sizes), np.int64)

            def parted(values, wanted: np.ndarray, *words: np.ndarray) -> pa.ListArray:
                """Lists of ``values`` of the words in rows that are wanted, else empty ones."""
                inside = np.repeat(wanted, sizes)
                return _lists(values(*(w[inside] for w in words)), np.append(np.where(wanted, sizes, 0), 0))

            kinds = group % 5
            columns = {
                "block": pa.array(np.full(len(sizes) + 1, block)),
                "bucket": pa.array(np.append(group // 5, block % buckets).astype(np.int32)),
                "place": _lists(np.append(text, np.arange(texts)).astype(np.int16), np.append(sizes, texts)),
                "n": _lists(times.astype(np.int32), np.append(sizes, 0)),
                "hot": parted(
                    lambda b, w: (hot_at[b] * len(hot_keys) + hot_at[w]).astype(np.int32), kinds == 4, before, word
                ),
                "first_number": parted(number.__getitem__, kinds < 2, before),
                "second_number": parted(number.__getitem__, (kinds == 0) | (kinds == 2), word),
                "first": parted(batch.keys.__getitem__, (kinds == 2) | (kinds == 3), before),
                "second": parted(batch.keys.__getitem__, (kinds == 1) | (kinds == 3), word),
                "doc": _lists(doc, np.append(none, texts)),
            }
            yield pa.RecordBatch.from_arrays([columns[c] for c in types], list(types))

    return rows.mapInArrow(explode, ", ".join(f"{c} {t}" for c, t in types.items()))


def _log(count: Column | str) -> Column:
    # Counts are one or more, so this rounds halves up; ``round`` goes through decimals for every row.
    return F.floor(F.log(count) * SCALE + 0.5)


def lm_scores(
    docs: DataFrame,
    vocabulary: int | None = None,
    min_count: int = 1,
    backoff: float = BACKOFF,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words and score_micros of every row.

    Words are parted by ASCII white space, A-Z lowered. All words and all pairs of the corpus
    count; with a ``vocabulary`` only so many of the most frequent words, ties by their bytes, are
    told apart (the driver and each worker hold them), and pairs of fewer than ``min_count`` step back.
    A null or empty text has no words and the score 0; an empty table gives no rows. Rows that
    share id and text are rows of their own with equal scores, each of which counts in the corpus.

    Among n different words two share a key with a chance of n * n / 2**65.
    """
    spark = docs.sparkSession
    ship(spark)
    text = col(text_col).cast("string")
    rows = docs.select(
        col(id_col).alias("doc_id"), digest(text).alias("digest"), text.cast("binary").alias("text")
    )
    scratch = Scratch(spark)
    known = None
    if vocabulary is not None:
        known = set(most_frequent(scratch.stored(word_counts(rows), "words"), vocabulary))
    shared = spark.sparkContext.broadcast(known)
    words = scratch.stored(_counted_words(rows, shared), "word-counts")
    total = words.agg(F.sum("n")).first()[0] or 1
    log_total, step_back = round(np.log(total) * SCALE), round(np.log(backoff) * SCALE)
    # The words above the least of these marks that so few pass; all hot words are among them.
    marks = sorted({int(2 ** (k / 2)) for k in range(126)} | {total // HOT_SHARE + 1})
    above = words.agg(*(F.count_if(F.col("n") >= m) for m in marks)).first()
    least = min(m for m, n in zip(marks, above, strict=True) if n <= NUMBERED or m > total // HOT_SHARE)
    frequent = words.filter(F.col("n") >= least).toPandas()
    is_hot = (frequent["n"] * HOT_SHARE > total).to_numpy(bool)
    keys, numbers = frequent["word"].to_numpy(np.int64), np.arange(len(frequent), dtype=np.int16)
    by_key = np.argsort(keys)
    numbered = spark.sparkContext.broadcast((keys[by_key], numbers[by_key], is_hot[by_key]))
    follows = frequent["follows"].tolist()
    # At most NUMBERED rows.
    named = spark.createDataFrame(
        list(zip(range(len(keys)), keys.tolist(), frequent["follows"].tolist(), strict=True)),
        "number long, named long, followed_named long",
    )
    # Fewer than HOT_SHARE rows, by what hot means, in the order of their keys.
    hot_rows = frequent.iloc[by_key[is_hot[by_key]]]
    hot_words = F.broadcast(spark.createDataFrame(
        [(k, *row) for k, row in enumerate(hot_rows[["word", "n", "follows"]].to_numpy(np.int64).tolist())],
        "hot_at long, hot_word long, hot_n long, hot_follows long",
    ))
    alone = _log(F.col("n_alone")) - log_total

    # The count table of pairs of hot words: at most HOT_SHARE squared, about half a million rows.
    firsts = hot_words.select(F.col("hot_word").alias("before"), F.col("hot_at").alias("first_at"), "hot_follows")
    seconds = hot_words.select(F.col("hot_word").alias("word"), F.col("hot_at").alias("second_at"), "hot_n")
    hot_pairs = _hot_counts(rows, shared, numbered).join(firsts, "before").join(F.broadcast(seconds), "word").select(
        (F.col("first_at") * len(hot_rows) + F.col("second_at")).cast("int").alias("hot"),
        F.when(F.col("pair") >= min_count, _log(F.col("pair")) - _log(F.col("hot_follows")))
        .otherwise(_log(F.col("hot_n")) - log_total + step_back).alias("hot_gain"),
    )

    # A number of partitions by words, since packed rows do not show their size.
    buckets = total // PARTITION_WORDS + 1
    packed = _block_pairs(rows, shared, numbered, buckets).repartitionById(buckets, "bucket")
    # A text's entry from the row that names its block has a doc and no words or times. Both readings
    # below ask for the same columns, all of which are filled, and so share one shuffle.
    at = ["n", "hot", "first_number", "second_number", "first", "second", "doc"]
    packed = packed.filter("bucket IS NOT NULL")
    listed = F.when(F.expr("block IS NOT NULL AND hot IS NOT NULL AND doc IS NOT NULL"), F.col("place"))
    entries = packed.select("*", F.posexplode(listed).alias("at", "text")).select(
        "block", "bucket", F.col("text").alias("place"), *(F.get(c, "at").alias(c) for c in at)
    )
    # A number serves as the key; a word's own key is one of them with a chance of NUMBERED / 2**64.
    entries = entries.select(
        "block", "bucket", "place", "n", "doc", "hot",
        F.coalesce("first", F.col("first_number").cast("long")).alias("before"),
        F.coalesce("second", F.col("second_number").cast("long")).alias("word"),
    )
    # The count table of all other pairs, with what an occurrence gains, dealt as the pairs are.
    counts = entries.filter("word IS NOT NULL").groupBy("bucket", "before", "word").agg(F.sum("n").alias("pair"))
    counts = counts.join(F.broadcast(named.select(F.col("number").alias("before"), "followed_named")), "before", "left")
    dealt = F.expr(f"cast(shiftrightunsigned(word, 8) % {buckets} as int)")
    by_first = words.select(
        dealt.alias("bucket"), F.col("word").alias("before"), F.col("follows").alias("followed_far")
    ).repartitionById(buckets, "bucket")
    counts = counts.join(by_first.hint("shuffle_hash"), ["bucket", "before"], "left")
    seen = F.when(F.col("pair") >= min_count, _log("pair") - _log(F.coalesce("followed_named", "followed_far")))
    counts = counts.select("bucket", "before", "word", seen.alias("gain"))
    # Pairs differ within a bucket and so many fit into it; ``counts`` is the side that is held.
    joined = entries.join(F.broadcast(hot_pairs), "hot", "left").join(
        counts.hint("shuffle_hash"), ["bucket", "before", "word"], "left"
    )
    joined = joined.withColumn("gain", F.col("n") * F.coalesce("gain", "hot_gain"))
    scored = joined.select("block", "place", "doc", "gain")
    if min_count > 1:
        rare = joined.filter("word IS NOT NULL AND gain IS NULL")
        rare = rare.join(F.broadcast(named.select(F.col("number").alias("word"), "named")), "word", "left")
        found = rare.withColumn("word", F.coalesce("named", "word")).join(
            words.select("word", F.col("n").alias("n_alone")), "word"
        )
        scored = scored.unionByName(
            found.select("block", "place", "doc", (F.col("n") * (alone + step_back)).alias("gain"))
        )
    # Blocks that are copies of each other have one name and gather their texts and gains together.
    sums = {
        "doc_id": F.max("doc.doc_id"), "digest": F.max("doc.digest"), "n_words": F.max("doc.n_words"),
        "head": F.max("doc.head"), "rows": F.count("doc"),
        "gain": F.coalesce(F.sum("gain"), F.lit(0)),
    }
    texts = scored.groupBy("block", "place").agg(
        *(value.alias(name) for name, value in sums.items())
    )
    texts = scratch.stored(texts.drop("block", "place"), "texts")

    texts = texts.join(hot_words, F.col("head") == F.col("hot_word"), "left")
    by_word = words.select(F.col("word").alias("head"), F.col("n").alias("n_alone"))
    columns = ["doc_id", "digest", "n_words", "rows", "gain", "n_alone"]
    texts = texts.filter("hot_n IS NOT NULL OR head IS NULL").withColumnRenamed("hot_n", "n_alone").select(
        columns
    ).unionByName(texts.filter("hot_n IS NULL AND head IS NOT NULL").join(by_word, "head").select(columns))
    gains = texts.withColumn("gain", F.col("gain") + F.col("rows") * F.coalesce(alone, F.lit(0)))
    # Rows that share id and text have gathered their gains together.
    found = gains.groupBy("doc_id", "digest").agg(
        F.max("n_words").alias("n_words"), F.sum("rows").alias("rows"), F.sum("gain").alias("gain")
    )
    out = stored(
        found.select("doc_id", "n_words", F.expr("gain div rows").alias("score_micros"), "rows"), "scores"
    )
    scratch.drop()
    copies = F.sequence(F.lit(1), F.col("rows").cast("int"))
    return out.withColumn("row", F.explode(copies)).select("doc_id", "n_words", "score_micros")
