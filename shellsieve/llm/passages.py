"""Repeated passages, found by automata of the phrases that recur.

Documents are packed in blocks, which are stored. Four steps follow.

1. Each block gives the keys (64-bit hashes) of its windows of words, each once, with the
   smallest document of the block that has it. Keys are dealt by range; a key that more than one
   document has recurs.
2. A block that has a recurring key in a document that is not the first one gets the phrase
   from the block next to it in the order of documents: keys, not texts, travel here, and each
   block is asked for a key at most once, however many blocks have it.
3. The blocks that are asked send the words themselves, neighbouring windows as one passage, with
   the document they stand in.
4. Each block compiles the windows of the passages it got into Aho-Corasick automata over digits of
   word numbers, a bounded number of windows in each, and streams all its documents through them.
   Every place where a window of a smaller document is found loses its words.

What is removed is decided by words: a window goes only if the very same words were sent from a
smaller document. Keys only choose what is sent. Two different windows that share a key could
hide each other's copies; among n different windows two do with a chance of n * n / 2**65.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellsieve.llm.common import col, ship
from shellsieve.sources.checkpoints import stored

WINDOW = 13
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Keys that are sorted together.
PART_KEYS = 2 << 20
#: Windows in one automaton.
AUTOMATON_WINDOWS = 1 << 17

_FACTOR = np.uint64(0xBF58476D1CE4E5B9)
#: What a null id counts as: no document is larger.
NO_ID = (1 << 63) - 1


def _pack(values: np.ndarray) -> bytes:
    """Integers of eight bytes as compressed planes of bytes."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data), dtype=np.uint64)


#: ASCII white space, a random number for each byte, and an odd factor with its inverse.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(13).integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTES[_SPACE] = 0
_STEP = 0x9E3779B97F4A7C15
_STEP_BACK = pow(_STEP, -1, 1 << 64)


def _powers(factor: int, n: int) -> np.ndarray:
    """1, factor, factor ** 2, ... modulo 2 ** 64."""
    out = np.ones(max(n, 1), np.uint64)
    size, power = 1, factor
    while size < n:
        more = min(size, n - size)
        out[size: size + more] = out[:more] * np.uint64(power)
        size, power = size + more, power * power % (1 << 64)
    return out[:n]


class Block:
    """Documents one after the other, in the order of their ids."""

    def __init__(self, blob: bytes):
        table = pa.ipc.open_stream(blob).read_all()
        ids = table["doc_id"].to_pylist()
        texts = table["text"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: NO_ID if ids[i] is None else ids[i])
        self.given_ids = [ids[i] for i in order]
        self.ids = np.array([NO_ID if ids[i] is None else ids[i] for i in order], np.int64)
        self.texts = [texts[i] for i in order]
        self.bytes = b"\n".join([*self.texts, b""])
        self.raw = np.frombuffer(self.bytes, np.uint8)
        space = _SPACE[self.raw]
        before = np.concatenate([[True], space[:-1]])[: len(space)]
        # Where words begin and end, and the numbers of the words at which documents begin and end.
        self.word_starts = np.flatnonzero(before & ~space)
        self.word_ends = np.flatnonzero(~before & space)
        closes = np.cumsum([len(text) + 1 for text in self.texts], dtype=np.int64)
        self.ends = np.searchsorted(self.word_starts, closes)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)

    def hashes(self) -> np.ndarray:
        """Hashes of the words: sums over bytes of random numbers times powers of the place."""
        if not len(self.word_starts):
            return np.zeros(0, np.uint64)
        n = len(self.raw)
        sums = np.add.reduceat(_BYTES[self.raw] * _powers(_STEP, n), self.word_starts)
        value = sums * _powers(_STEP_BACK, n)[self.word_starts]
        value ^= value >> np.uint64(32)
        return value * np.uint64(0xD6E8FEB86659FD93)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Places where a window starts, in order, and the windows' keys."""
        sizes = np.maximum(self.ends - self.starts - WINDOW + 1, 0)
        if not sizes.sum():
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        hashes = self.hashes()
        n = len(hashes) - WINDOW + 1
        value = np.zeros(n, np.uint64)
        for i in range(WINDOW):
            value *= _FACTOR
            value += hashes[i: i + n]
        value ^= value >> np.uint64(32)
        value *= np.uint64(0xD6E8FEB86659FD93)
        value ^= value >> np.uint64(32)
        places = np.repeat(self.starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        return places, value[places]

    def owner(self, places: np.ndarray) -> np.ndarray:
        """The number of the document that each place is in."""
        return np.searchsorted(self.ends, places, "right")

    def first_places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, the first place of each, and whether a larger id has it too."""
        places, keys = self.keys()
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        ids = self.ids[self.owner(places)]
        last = np.concatenate([at[1:], [len(keys)]]) - 1 if len(at) else at
        return keys[at], places[at], ids[last] > ids[at]


def _packed_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """block, n_words and blob (ids and texts) of blocks of documents."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        held, size, number = [], 0, 0

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            sink = pa.BufferOutputStream()
            options = pa.ipc.IpcWriteOptions(compression="zstd")
            with pa.ipc.new_stream(sink, table.schema, options=options) as stream:
                stream.write_table(table)
            words = sum(len(text.split()) for text in table["text"].to_pylist())
            return pa.RecordBatch.from_arrays(
                [pa.array([first + number]), pa.array([words]), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                ["block", "n_words", "blob"],
            )

        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                upto = max(at + 1, int(np.searchsorted(ends, before + BLOCK_BYTES - size, "right")))
                held.append(batch.slice(at, upto - at))
                size += int(ends[upto - 1]) - before
                at = upto
                if size >= BLOCK_BYTES or at < batch.num_rows:
                    yield block()
                    held, size, number = [], 0, number + 1
        if held:
            yield block()

    text = F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(pack, "block long, n_words long, blob binary")


def _asks(blocks: DataFrame, parts: int) -> DataFrame:
    """part, block, keys, ids and more: the windows of every block by ranges of their keys."""
    width = (1 << 64) // parts + 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = Block(blob.as_py())
                keys, places, more = block.first_places()
                ids = block.ids[block.owner(places)]
                bounds = np.array([p * width for p in range(1, parts)], np.uint64)
                cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
                rows = [(p, low, high) for p, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)) if low < high]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p for p, _, _ in rows], pa.int32()),
                        pa.array([number] * len(rows), pa.int64()),
                        pa.array([_pack_sorted(keys[a:b]) for _, a, b in rows], pa.binary()),
                        pa.array([_pack(ids[a:b].view(np.uint64)) for _, a, b in rows], pa.binary()),
                        pa.array([np.packbits(more[a:b]).tobytes() for _, a, b in rows], pa.binary()),
                    ],
                    ["part", "block", "keys", "ids", "more"],
                )

    return blocks.select("block", "blob").mapInArrow(
        ask, "part int, block long, keys binary, ids binary, more binary"
    )


_SENDS = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("to", pa.binary())])


def _sends(asks: pa.Table) -> pa.Table:
    """block, keys and to: which windows of which block go to which blocks, for one part."""
    numbers = asks["block"].to_numpy()
    keys = [_unpack_sorted(x.as_py()) for x in asks["keys"]]
    sizes = [len(k) for k in keys]
    ids = np.concatenate([_unpack(x.as_py()).view(np.int64) for x in asks["ids"]])
    more = np.concatenate([
        np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n).astype(bool)
        for x, n in zip(asks["more"], sizes, strict=True)
    ])
    block, keys = np.repeat(np.arange(len(sizes)), sizes), np.concatenate(keys)
    # A key that is alone needs no order; of the rest each key's blocks go by their first document.
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    alone = ~(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    order = order[~alone | more[order]]
    order = order[np.lexsort((block[order], ids[order], keys[order]))]
    keys, ids, more, block = keys[order], ids[order], more[order], block[order]
    at = np.arange(len(order))
    new = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(at)]
    # The entry before the first one of this key and id has the next smaller id, if any.
    level = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])[: len(at)]
    first = np.maximum.accumulate(np.where(level, at, 0))
    smaller = ~new[first]
    sender = np.where(smaller, first - 1, at)
    wanted = smaller | more
    frm, to, keys = block[sender[wanted]], block[wanted], keys[wanted]
    order = np.lexsort((keys, frm))
    frm, to, keys = frm[order], to[order], keys[order]
    cuts = np.flatnonzero(np.diff(frm)) + 1
    rows = [(part[0], part[-1] + 1) for part in np.split(np.arange(len(frm)), cuts) if len(part)]
    return pa.Table.from_arrays(
        [
            pa.array([int(numbers[frm[a]]) for a, _ in rows], pa.int64()),
            pa.array([_pack_sorted(keys[a:b]) for a, b in rows], pa.binary()),
            pa.array([_pack(numbers[to[a:b]].view(np.uint64)) for a, b in rows], pa.binary()),
        ],
        schema=_SENDS,
    )


_PASSAGES = pa.schema([("block", pa.int64()), ("first", pa.int64()), ("words", pa.binary())])


def _passages(blocks: pa.Table, sends: pa.Table) -> pa.Table:
    """block, first and words: the passages that a block sends, by receiver, with their document."""
    if not sends.num_rows or not blocks.num_rows:
        return _PASSAGES.empty_table()
    block = Block(blocks["blob"][0].as_py())
    keys, places, _ = block.first_places()
    wanted = np.concatenate([_unpack_sorted(x.as_py()) for x in sends["keys"]])
    to = np.concatenate([_unpack(x.as_py()).view(np.int64) for x in sends["to"]])
    place = places[np.searchsorted(keys, wanted)]
    order = np.lexsort((place, to))
    place, to = place[order], to[order]
    owner = block.owner(place)
    cut = (np.diff(place) != 1) | (np.diff(to) != 0) | (np.diff(owner) != 0)
    starts = np.concatenate([[0], np.flatnonzero(cut) + 1])
    ends = np.concatenate([starts[1:], [len(place)]]) - 1
    return pa.Table.from_arrays(
        [
            pa.array(to[starts], pa.int64()),
            pa.array(block.ids[owner[starts]], pa.int64()),
            pa.array(
                [
                    block.bytes[block.word_starts[place[a]]: block.word_ends[place[b] + WINDOW - 1]]
                    for a, b in zip(starts, ends, strict=True)
                ],
                pa.binary(),
            ),
        ],
        schema=_PASSAGES,
    )


def _spelled(codes: np.ndarray, digits: int) -> str:
    """Numbers of words as characters, ``digits`` for each; a negative number is unlike all others.

    Each digit has characters of its own, so phrases match at the start of words only. An automaton
    goes through the children of a node one by one, so few of them a node matter.
    """
    places = np.arange(digits)
    out = (codes[:, None] >> (8 * places)) % 256 + 256 * places + 0x100
    out[codes < 0] = 0x20
    return out.astype("<u4").tobytes().decode("utf-32-le")


def _windows(passages: pa.Table) -> tuple[dict[bytes, int], int, dict[str, int]]:
    """Numbers of the passages' words, digits of a number, and the windows with their smallest document."""
    numbers: dict[bytes, int] = {}
    number = numbers.setdefault
    parted = [
        np.array([number(w, len(numbers)) for w in words.split()], np.int64)
        for words in passages["words"].to_pylist()
    ]
    digits = max(1, -(-len(numbers).bit_length() // 8))
    size = WINDOW * digits
    out: dict[str, int] = {}
    for first, codes in zip(passages["first"].to_pylist(), parted, strict=True):
        text = _spelled(codes, digits)
        for at in range(0, len(text) - size + 1, digits):
            window = text[at: at + size]
            out[window] = min(first, out.get(window, first))
    return numbers, digits, out


def _automata(windows: dict[str, int]) -> Iterator[ahocorasick.Automaton]:
    """Automata that find the windows, a bounded number of windows in each."""
    items = iter(windows.items())
    for _ in range(0, len(windows), AUTOMATON_WINDOWS):
        automaton = ahocorasick.Automaton()
        for window, first in itertools.islice(items, AUTOMATON_WINDOWS):
            automaton.add_word(window, first)
        automaton.make_automaton()
        yield automaton


_KEPT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())]
)


def _kept(blocks: pa.Table, passages: pa.Table) -> pa.Table:
    """The documents of a block without the passages that smaller documents have."""
    if not blocks.num_rows:
        return _KEPT.empty_table()
    block = Block(blocks["blob"][0].as_py())
    parted = [text.split() for text in block.texts]
    removed, gone = np.zeros(len(parted), np.int64), None
    if passages.num_rows:
        numbers, digits, windows = _windows(passages)
        number = numbers.get
        codes = np.array([number(word, -1) for words in parted for word in words], np.int64)
        # A gap after each document, which no phrase crosses.
        text = _spelled(np.insert(codes, block.ends, -1), digits)
        lasts, firsts = [], []
        for automaton in _automata(windows):
            for last, first in automaton.iter(text):
                lasts.append(last)
                firsts.append(first)
        last = (np.array(lasts, np.int64) + 1) // digits - 1
        owner = np.searchsorted(block.ends + np.arange(len(block.ends)), last, "right")
        later = np.array(firsts, np.int64) < block.ids[owner]
        last = (last - owner)[later]
        hit = np.zeros(len(codes) + 1, np.int64)
        np.add.at(hit, last - WINDOW + 1, 1)
        np.add.at(hit, last + 1, -1)
        gone = np.cumsum(hit[:-1]) > 0
        before = np.concatenate([[0], np.cumsum(gone)])
        removed = before[block.ends] - before[block.starts]
    texts = []
    for words, start, end, n in zip(parted, block.starts, block.ends, removed.tolist(), strict=True):
        kept = words if not n else [w for w, out in zip(words, gone[start:end].tolist(), strict=True) if not out]
        texts.append(b" ".join(kept))
    return pa.Table.from_arrays(
        [
            pa.array(block.given_ids, pa.int64()),
            pa.array(block.ends - block.starts, pa.int64()),
            pa.array(removed, pa.int64()),
            pa.array(texts, pa.binary()),
        ],
        schema=_KEPT,
    )


def without_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept of every row.

    Words are parted by ASCII white space and taken as they are; a window is 13 consecutive words
    of one text. A word goes if a window that covers it also starts in a document of smaller id,
    judged on the texts as given; ``kept`` is the other words joined by blanks, as binary. Ids
    are whole numbers; a null id counts as larger than all others. Rows that share their id do not
    remove each other's windows. A null or empty text has no words; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    blocks = stored(_packed_blocks(docs, id_col, text_col), "text-blocks")
    n_blocks, n_words = blocks.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    parts = max(1, -(-n_words // PART_KEYS))
    sends = _asks(blocks, parts).groupBy("part").applyInArrow(
        _sends, "block long, keys binary, to binary"
    )
    # Both steps on blocks read one shuffle of them.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_blocks // 4)
    dealt = blocks.select("block", "blob").repartition(n, "block").groupBy("block")
    passages = dealt.cogroup(sends.repartition(n, "block").groupBy("block")).applyInArrow(
        _passages, "block long, first long, words binary"
    )
    return dealt.cogroup(passages.repartition(n, "block").groupBy("block")).applyInArrow(
        _kept, "doc_id long, n_words long, n_removed long, kept binary"
    )
