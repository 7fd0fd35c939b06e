"""Periodic runs of words, found as maximal pairs of equal stretches.

A maximal pair is two places of a text from which the same words follow, where the words
before differ and so do the words after. A stretch of smallest period q that cannot be made
longer shows as the maximal pair of its start and the place q words on, which agree for its
length less q; so the pairs whose distance is at most the number of agreeing words are
exactly the runs, and nothing has to be extended.

The places of a text are sorted by what follows them (ranks of one, two, four, ... words), the
numbers of words that neighbours in this order share (LCP) make a tree of intervals, and the
intervals are closed bottom-up. Each holds its places in order, as a whole and by the word to
their left; when two intervals meet, every place of the smaller one looks at the places of the
larger one that are near enough, and passes over those of its own left word.

A run of at least n words needs agreeing stretches of n / 2 words, so intervals that share
fewer are not looked at, and texts in which no stretch of that size comes twice are left out
at once.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellsieve.llm.common import col, ship

MIN_LENGTH = 12
#: Words whose places are sorted together; a longer text is sorted on its own.
BATCH_WORDS = 1 << 17
#: Places near another one that are looked at one by one; more are passed over in groups.
FEW = 6

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Interval:
    """The places of an LCP interval: all in order, and in order by left word."""

    __slots__ = ("by_left", "places")

    def __init__(self, place: int, left: int):
        self.places = [place]
        self.by_left = {left: [place]}

    def add(self, place: int, left: int) -> None:
        insort(self.places, place)
        same = self.by_left.get(left)
        if same is None:
            self.by_left[left] = [place]
        else:
            insort(same, place)

    def near(self, place: int, left: int, reach: int) -> Iterator[int]:
        """Places at most ``reach`` away whose left word differs."""
        places = self.places
        at, end = bisect_left(places, place - reach), bisect_right(places, place + reach)
        same = self.by_left.get(left)
        if same is None:
            yield from places[at:end]
            return
        while at < end:
            here = places[at]
            k = bisect_left(same, here)
            if k == len(same) or same[k] != here:
                yield here
                at += 1
                continue
            if end - at <= FEW:
                at += 1
                continue
            # From here on places and those of the same left word go together for a while.
            low, high = 1, min(end - at, len(same) - k)
            while low < high:
                middle = (low + high + 1) // 2
                if places[at + middle - 1] == same[k + middle - 1]:
                    low = middle
                else:
                    high = middle - 1
            at += low


def _join(one: Interval, other: Interval, shared: int, lefts, found: list) -> Interval:
    """The union of two parts of an interval that share ``shared`` words; adds their pairs."""
    if len(one.places) < len(other.places):
        one, other = other, one
    for place in other.places:
        for partner in one.near(place, lefts[place], shared):
            found.append((min(place, partner), abs(place - partner), shared))
    for place in other.places:
        one.add(place, lefts[place])
    return one


def _pairs(order: list[int], shared: list[int], lefts) -> list[tuple[int, int, int]]:
    """(first place, distance, words shared) of the maximal pairs of one subtree, near ones only.

    ``order`` holds sorted places, ``shared`` the words that each shares with the one before.
    """
    found: list[tuple[int, int, int]] = []
    open_: list[tuple[int, Interval]] = []
    last = Interval(order[0], lefts[order[0]])
    for place, depth in zip(order[1:], shared[1:], strict=True):
        while open_ and open_[-1][0] > depth:
            own, interval = open_.pop()
            last = _join(interval, last, own, lefts, found)
        if open_ and open_[-1][0] == depth:
            open_[-1] = (depth, _join(open_[-1][1], last, depth, lefts, found))
        else:
            open_.append((depth, last))
        last = Interval(place, lefts[place])
    while open_:
        own, interval = open_.pop()
        last = _join(interval, last, own, lefts, found)
    return found


def _repeating(keys: np.ndarray, width: int) -> np.ndarray:
    """Places from which ``width`` keys follow that also follow another place (or seem to)."""
    n = len(keys) - width + 1
    if n < 2:
        return np.zeros(0, np.int64)
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    value = np.zeros(n, np.uint64)
    for i in range(width):
        value = value * np.uint64(0xBF58476D1CE4E5B9) + mixed[i: i + n]
    order = np.argsort(value, kind="stable")
    same = value[order[1:]] == value[order[:-1]]
    return np.concatenate([order[1:][same], order[:-1][same]])


def _sorted_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by the keys that follow, and how many keys each shares with the one before.

    The last key of each text comes once only, so no two places share keys beyond it.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    new = np.concatenate([[True], keys[order[1:]] != keys[order[:-1]]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks, step = [rank.astype(np.int32 if n < 2**31 else np.int64)], 1
    while True:
        sizes = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(sizes[rank] > 1)
        if not len(open_):
            break
        key = rank[open_] * (n + 1) + rank[open_ + step]
        by_key = np.argsort(key, kind="stable")
        open_, key = open_[by_key], key[by_key]
        own = rank[open_]
        at = np.arange(len(open_))
        group = np.maximum.accumulate(np.where(np.concatenate([[True], own[1:] != own[:-1]]), at, 0))
        part = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), at, 0))
        rank = rank.copy()
        rank[open_] = own + part - group
        ranks.append(rank.astype(ranks[0].dtype))
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        step = (ranks[level][a] == ranks[level][b]).astype(np.int64) << level
        shared[1:] += step
        a += step
        b += step
    return order, shared


def runs_of(texts: list[list[int]], min_length: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text of word numbers, by start and period.

    A run is a stretch of smallest period q of at least ``min_length`` words and two periods
    that no neighbouring word extends.
    """
    least = (max(min_length, 2) + 1) // 2
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    codes = np.concatenate([np.append(np.asarray(t, np.int64) + 1, 0) for t in texts] or [np.zeros(0, np.int64)])
    if not len(codes):
        return out
    owner = np.repeat(np.arange(len(texts)), sizes)
    keys = owner * (codes.max() + 1) + codes
    owners = np.unique(owner[_repeating(keys, least)])
    if not len(owners):
        return out
    chosen = np.isin(owner, owners)
    keys, codes, owner = keys[chosen], codes[chosen], owner[chosen]
    starts = np.concatenate([[0], np.cumsum(sizes[owners])])
    order, shared = _sorted_places(keys)
    lefts = np.concatenate([[0], codes[:-1]])  # before a text is the end of another one
    lefts = lefts.tolist()
    # Maximal parts of the order in which neighbours share enough words.
    deep = np.flatnonzero(shared >= least)
    runs: dict[tuple[int, int], int] = {}
    if len(deep):
        cuts = np.flatnonzero(np.diff(deep) > 1) + 1
        for part in np.split(deep, cuts):
            low, high = part[0] - 1, part[-1] + 1
            for first, distance, depth in _pairs(
                order[low:high].tolist(), shared[low:high].tolist(), lefts
            ):
                if distance <= depth and depth + distance >= min_length:
                    key = (first, depth + distance)
                    runs[key] = min(distance, runs.get(key, distance))
    for (first, length), period in sorted(runs.items(), key=lambda run: (run[0][0], run[1])):
        text = int(np.searchsorted(starts, first, "right")) - 1
        out[owners[text]].append((first - int(starts[text]), length, period))
    return out


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by blanks, without those of a run after its first period."""
    if not runs:
        return b" ".join(words)
    dropped = np.zeros(len(words), bool)
    for start, length, period in runs:
        dropped[start + period: start + length] = True
    return b" ".join(words[i] for i in np.flatnonzero(~dropped))


def _batches(texts: Iterator[bytes]) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for text in texts:
        held.append((text or b"").split())
        size += len(held[-1]) + 1
        if size >= BATCH_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH
) -> DataFrame:
    """doc_id, runs and collapsed of every row.

    Words are parted by ASCII white space and numbered from 0. ``runs`` has start, length and
    period of every run of at least ``min_length`` words, by start, then period; ``collapsed`` is the
    text's words joined by blanks, without those that a run holds after its first period, as
    binary. A null or empty text has no words, no runs and is empty when collapsed. Each row is
    judged alone, so ties, repeated rows and null ids need no rule; an empty table gives no rows.
    A text is worked on as a whole in memory: 16 bytes a word, and 4 more for each doubling of its
    longest repeated stretch.
    """
    ship(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0), 0
            for part in _batches(x.as_py() for x in batch.column(1)):
                numbers: dict[bytes, int] = {}
                coded = [[numbers.setdefault(w, len(numbers)) for w in words] for words in part]
                found = runs_of(coded, min_length)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, len(part)),
                        pa.array(
                            [[{"start": s, "length": n, "period": p} for s, n, p in runs] for runs in found],
                            _RUNS,
                        ),
                        pa.array([without_repeats(w, r) for w, r in zip(part, found, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "runs", "collapsed"],
                )
                at += len(part)

    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    return rows.mapInArrow(find, schema)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a repeated part in every tenth text, chosen by a checksum of the id.

    With h = crc32 of the decimal id and g = h div 10: if h mod 10 is 0 and the text has n > 0
    words, each word i >= a = g mod n becomes word a + (i - a) mod p of the same text, where p is
    1 + (n - a) div (3 + g mod 8). Words are then joined by blanks. A null id changes nothing.
    """
    checksum = F.crc32(col(id_col).cast("string").cast("binary"))
    g = F.floor(checksum / 10)

    def planted(words):
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.transform(words, lambda word, i: F.when(i < a, word).otherwise(F.get(words, a + (i - a) % p)))

    text = col(text_col).cast("string")
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    # Once per row: a lambda's parameter, not the expression, is what its body refers to.
    changed = F.transform(F.array(words), lambda ws: F.array_join(planted(ws), " "))[0]
    chosen = (checksum % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]")
    return docs.withColumn(text_col, F.when(chosen, changed).otherwise(text))
