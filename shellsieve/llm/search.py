"""The best documents for each of a table of items, by the Best Position Algorithm.

Each task holds its documents in blocks and makes impact lists of a block: for every term of the
items, the documents that have it, highest impact first. An item is answered from the lists of its
terms. Reading goes down all lists together; a document met in one list is looked up directly
in all others, which gives its whole score and marks its places there as seen. The best position
of a list is the last place up to which all are seen, whether read or looked up. No document
that is still unseen scores more than the impacts at the best positions together, and reading
stops when that sum is strictly below the score of the k-th document found, so ties
at the k-th place are all found. The k-th score is carried from block to block of a task.

Documents are parted by Spark, never a list by term, so a term that is in every document makes no
list longer than a block. The k best of each task meet in a grouping by item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shellsieve.llm.common import col, ship
from shellsieve.sources.checkpoints import Scratch, stored

BEST = 10
#: Bytes of items that are answered in one pass over the documents.
ITEM_BYTES = 4 << 20
#: A block of documents ends at this many documents or term entries.
BLOCK_DOCS, BLOCK_ENTRIES = 4096, 1 << 19
#: Places of each list that are read before the stop is tested again; doubled each time.
FIRST_PLACES = 8
#: Parts of an item's candidates that are ranked before they meet.
PARTS = 64

#: A-Z lowered, ASCII that is no letter or digit made a blank.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 32
    for b in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """Maximal stretches of letters and digits, all but ASCII counted as letters, A-Z lowered."""
    return (text or b"").translate(_FOLD).split()


class Lists:
    """The impact lists of a block of documents."""

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int):
        """``terms`` and ``impacts`` are entries of documents one after the other, ``sizes`` each."""
        docs = np.repeat(np.arange(len(sizes)), sizes)
        kept = impacts > 0
        docs, self.terms, self.impacts = docs[kept], terms[kept], impacts[kept]
        self.first = np.searchsorted(docs, np.arange(len(sizes) + 1))
        order = np.lexsort((-self.impacts, self.terms))
        self.start = np.searchsorted(self.terms[order], np.arange(n_terms + 1))
        self.list_docs, self.list_impacts = docs[order], self.impacts[order]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.n_docs = len(sizes)
        self.met = np.zeros(self.n_docs, bool)
        self.seen = np.zeros(len(order), bool)

    def next_unseen(self, place: int, end: int) -> int:
        """The first place from ``place`` on that is not known as seen, or ``end``."""
        while place < end:
            part = self.seen[place: min(end, place + 256)]
            first = int(part.argmin())
            if not part[first]:
                return place + first
            place += len(part)
        return end

    def scores(self, docs: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of documents over the wanted terms, and the places of these in the lists."""
        low, sizes = self.first[docs], self.first[docs + 1] - self.first[docs]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - sizes), sizes)
        own = np.repeat(np.arange(len(docs)), sizes)
        mask = wanted[self.terms[at]]
        at, own = at[mask], own[mask]
        sums = np.concatenate([[0], np.cumsum(self.impacts[at])])
        return np.diff(sums[np.searchsorted(own, np.arange(len(docs) + 1))]), self.place[at]


class Best:
    """The k best documents of an item so far, as (-score, no id, id), and their worst score."""

    def __init__(self, k: int):
        self.k, self.rows, self.kth = k, [], 0

    def add(self, scores: np.ndarray, ids: list[Any]) -> None:
        self.rows += [(-int(s), i is None, i) for s, i in zip(scores, ids, strict=True)]
        self.rows.sort(key=lambda row: row[:2] if row[1] else row)
        del self.rows[self.k:]
        if len(self.rows) == self.k:
            self.kth = -self.rows[-1][0]


def answer(lists: Lists, ids: list[Any], terms: np.ndarray, wanted: np.ndarray, best: Best) -> int:
    """Add the documents of a block to an item's best ones; returns how many were looked up.

    ``wanted`` says of every term whether the item has it.
    """
    start, end = lists.start[terms], lists.start[terms + 1]
    start, end = start[start < end], end[start < end]
    if not len(start):
        return 0
    position, step = start.copy(), FIRST_PLACES  # the first place of each list not known as seen
    touched_docs, touched_places = [], []
    # What an unseen document can score: before anything is read, the first impacts together.
    bound = int(lists.list_impacts[start].sum())
    while bound >= max(best.kth, 1):
        read = [lists.list_docs[p: min(p + step, e)] for p, e in zip(position, end, strict=True)]
        new = np.unique(np.concatenate(read))
        new = new[~lists.met[new]]
        if len(new):
            lists.met[new] = True
            scores, places = lists.scores(new, wanted)
            lists.seen[places] = True
            touched_docs.append(new)
            touched_places.append(places)
            good = np.flatnonzero(scores >= max(best.kth, 1))
            if len(good) > best.k:
                kth = np.partition(scores[good], -best.k)[-best.k]
                good = good[scores[good] >= kth]
            best.add(scores[good], [ids[d] for d in new[good]])
        bound = 0
        for i, (p, e) in enumerate(zip(position, end, strict=True)):
            position[i] = p = lists.next_unseen(p, e)
            if p < e:
                # The best position is the place before; nothing after it has more impact.
                bound += int(lists.list_impacts[p - 1])
        step *= 2
    for docs in touched_docs:
        lists.met[docs] = False
    for places in touched_places:
        lists.seen[places] = False
    return sum(map(len, touched_docs))


def _index(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms of the text), terms (numbers in the vocabulary) and times of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for batch in batches:
            sizes, ids, times = [], [], []
            for text in batch.column(1):
                found = terms_of(text.as_py())
                sizes.append(len(found))
                known, n = np.unique(
                    np.array([i for i in map(number, found) if i is not None], np.int32), return_counts=True
                )
                ids.append(known)
                times.append(n.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array(times, pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "terms", "times"],
            )

    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n long, terms array<int>, times array<long>")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, sizes, numbers of terms of the text, terms and times of blocks of documents."""
    held, docs, entries = [], 0, 0
    for batch in batches:
        at = 0
        ends = batch.column(2).offsets.to_numpy()
        while at < batch.num_rows:
            room = int(np.searchsorted(ends, ends[at] + BLOCK_ENTRIES - entries, "right")) - 1
            upto = max(at + 1, min(batch.num_rows, at + BLOCK_DOCS - docs, room))
            held.append(batch.slice(at, upto - at))
            docs, entries = docs + upto - at, entries + int(ends[upto] - ends[at])
            at = upto
            if docs >= BLOCK_DOCS or entries >= BLOCK_ENTRIES:
                yield _block(held)
                held, docs, entries = [], 0, 0
    if held:
        yield _block(held)


def _block(parts: list[pa.RecordBatch]):
    table = pa.Table.from_batches(parts).combine_chunks()
    terms = table["terms"].combine_chunks()
    return (
        table["doc_id"].to_pylist(),
        terms.value_lengths().to_numpy(zero_copy_only=False),
        table["n"].to_numpy(),
        terms.flatten().to_numpy(zero_copy_only=False),
        table["times"].combine_chunks().flatten().to_numpy(zero_copy_only=False),
    )


def _search_block(docs: DataFrame, items: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """Results for ``items`` (item_id, text), which are few enough for the driver."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType
    rows = items.select("item_id", F.col("text").cast("binary")).collect()
    numbers: dict[bytes, int] = {}
    asked = [
        np.array(sorted({numbers.setdefault(t, len(numbers)) for t in terms_of(row.text)}), np.int64)
        for row in rows
    ]
    vocabulary = spark.sparkContext.broadcast(numbers)
    scratch = Scratch(spark)
    index = scratch.stored(_index(docs, vocabulary, id_col, text_col), "search-index")
    n_docs, n_terms = index.agg(
        F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))
    ).first()
    weights = np.zeros(len(numbers), np.int64)
    for term, df in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    shared = spark.sparkContext.broadcast((asked, weights))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights = shared.value
        best = [Best(k) for _ in asked]
        wanted = np.zeros(len(weights), bool)
        type_ = None
        for batch in batches:
            type_ = batch.schema.field(0).type
            for ids, sizes, n, terms, times in _blocks(iter([batch])):
                m = 10 + (90 * n.astype(np.int64) * n_docs) // max(n_terms, 1)
                impacts = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 8 * np.repeat(m, sizes)))
                lists = Lists(sizes, terms, impacts, len(weights))
                for own, found in zip(asked, best, strict=True):
                    wanted[own] = True
                    answer(lists, ids, own, wanted, found)
                    wanted[own] = False
        out = [(item, row[2], -row[0]) for item, found in enumerate(best) for row in found.rows]
        if out:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in out], pa.int32()),
                    pa.array([x[1] for x in out], type_),
                    pa.array([x[2] for x in out], pa.int64()),
                ],
                ["item", "doc_id", "score"],
            )

    id_kind = index.schema["doc_id"].dataType.simpleString()
    found = index.mapInArrow(find, f"item int, doc_id {id_kind}, score long")
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    rank = F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))
    found = found.withColumn("part", part).withColumn("rank", rank).filter(F.col("rank") <= k)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    names = spark.createDataFrame(
        [(i, row.item_id) for i, row in enumerate(rows)], f"item int, item_id {kind.simpleString()}"
    )
    # As many rows as the block of items has, which the driver holds.
    out = stored(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "search-results")
    scratch.drop()
    return out


def best_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = BEST,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id and score of the k highest-scoring documents of each item.

    A document scores, over the different terms of the item that it holds, the weight of
    the term times its frequency, which saturates and counts less in long texts; all in whole
    numbers. Documents that score nothing are left out. Equal scores rank by ascending id, a null
    id last; rows that share their id, or id and text, are documents of their own, and so are
    repeated items. A null or empty text has no terms: such a document is found by no item and does
    not count as one, such an item finds nothing. An empty table of either gives no rows.

    Items are answered in blocks of about ``item_bytes`` of text, a pass over all documents each.
    """
    ship(docs.sparkSession)
    asked = items.select(col(item_id_col).alias("item_id"), col(item_text_col).cast("string").alias("text"))
    size = asked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    n_blocks = -(-size // item_bytes) or 1
    out = None
    for block in range(n_blocks):
        own = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block)
        found = _search_block(docs, own if n_blocks > 1 else asked, k, id_col, text_col)
        out = found if out is None else out.unionByName(found)
    return out
