"""Files of token ids in directly addressable codes.

The ids of a segment are cut into chunks of eight bits. Level 0 holds the lowest chunk of
every id, level k+1 the next chunk of those ids that level k marks in its continuation
bitmap, in the same order. The place of an id's next chunk is the number of marks before it
(its rank), which a directory gives for every 512 places, so one id is read with a few bytes
of each level it reaches and nothing else is decoded.

A file is: magic; segments; directory; footer.

- segment: number of levels (u32), entries of each level (u32 each), then per level the chunks
  (u8 each), and for all levels but the last the bitmap (bits from the lowest, whole bytes)
  and the ranks (u32 for every 512 entries);
- directory: offset of every segment and of the directory (u64 each), per document its id
  (i64), whether it is null (u8) and its end in the ids of the file (u64);
- footer: documents, ids, segments, ids in a segment, offset of the directory (u64 each), magic.

All numbers are little-endian. Segments have equally many ids (the last may have fewer), so
id ``i`` is in segment ``i // size``; documents may cross segments.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

MAGIC = b"DACTOK01"
SEGMENT_IDS = 1 << 20
RANK_EVERY = 512
FOOTER = struct.Struct("<5Q8s")


def encode_segment(ids: np.ndarray) -> bytes:
    """The levels of up to 2**32 ids of 32 bits."""
    rest, levels = ids.astype("<u4", copy=False), []
    while True:
        chunks, rest = (rest & 0xFF).astype(np.uint8), rest >> 8
        more = rest > 0
        last = not more.any()
        if last:
            levels.append((len(chunks), [chunks.tobytes()]))
            break
        bitmap = np.packbits(more, bitorder="little")
        marks = np.add.reduceat(more, np.arange(0, len(more), RANK_EVERY), dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(marks)[:-1]]).astype("<u4")
        levels.append((len(chunks), [chunks.tobytes(), bitmap.tobytes(), ranks.tobytes()]))
        rest = rest[more]
    head = struct.pack(f"<{1 + len(levels)}I", len(levels), *(n for n, _ in levels))
    return head + b"".join(part for _, parts in levels for part in parts)


def _parts(head: bytes) -> list[tuple[int, int, int, int]]:
    """Of every level: entries, and offsets of chunks, bitmap and ranks within the segment."""
    (levels,) = struct.unpack_from("<I", head)
    counts = struct.unpack_from(f"<{levels}I", head, 4)
    at, out = 4 + 4 * levels, []
    for k, n in enumerate(counts):
        bitmap = at + n
        ranks = bitmap + (n + 7) // 8
        out.append((n, at, bitmap, ranks))
        at = bitmap if k + 1 == levels else ranks + 4 * (-(-n // RANK_EVERY))
    return out


def decode_segment(data: bytes) -> np.ndarray:
    """All ids of a segment."""
    parts = _parts(data)
    value = np.zeros(0, np.uint32)
    for k in range(len(parts) - 1, -1, -1):
        n, chunks, bitmap, _ = parts[k]
        low = np.frombuffer(data, np.uint8, n, chunks).astype(np.uint32)
        if k + 1 < len(parts):
            bits = np.frombuffer(data, np.uint8, (n + 7) // 8, bitmap)
            more = np.unpackbits(bits, count=n, bitorder="little").view(bool)
            low[more] |= value << 8
        value = low
    return value


class Writer:
    """Writes documents, in the order given, to a binary stream."""

    def __init__(self, stream, segment_ids: int = SEGMENT_IDS):
        self.stream, self.segment_ids = stream, segment_ids
        self.offsets, self.at = [], len(MAGIC)
        self.doc_ids, self.nulls, self.ends = [], [], []
        self.held, self.n_held, self.n_ids = [], 0, 0
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """A document; ``ids`` are little-endian unsigned 32-bit integers."""
        self.held.append(ids)
        self.n_held += len(ids) // 4
        self.n_ids += len(ids) // 4
        self.doc_ids.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.ends.append(self.n_ids)
        if self.n_held >= self.segment_ids:
            self._flush(whole=True)

    def _flush(self, whole: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        start = 0
        while len(ids) - start >= (self.segment_ids if whole else 1):
            data = encode_segment(ids[start: start + self.segment_ids])
            self.stream.write(data)
            self.offsets.append(self.at)
            self.at += len(data)
            start += self.segment_ids
        rest = ids[start:]
        self.held, self.n_held = [rest.tobytes()], len(rest)

    def close(self) -> None:
        if self.n_held:
            self._flush(whole=False)
        for values, kind in (
            ([*self.offsets, self.at], "<u8"), (self.doc_ids, "<i8"), (self.nulls, "u1"), (self.ends, "<u8"),
        ):
            self.stream.write(np.array(values, kind).tobytes())
        footer = (len(self.doc_ids), self.n_ids, len(self.offsets), self.segment_ids, self.at)
        self.stream.write(FOOTER.pack(*footer, MAGIC))


class Reader:
    """Reads a file through ``read(offset, size)``."""

    def __init__(self, read, size: int):
        self.read = read
        *counts, magic = FOOTER.unpack(read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        self.n_docs, self.n_ids, n, self.segment_ids, at = counts
        self.offsets = np.frombuffer(read(at, 8 * (n + 1)), "<u8").astype(np.int64)
        at += 8 * (n + 1)
        self.doc_ids = np.frombuffer(read(at, 8 * self.n_docs), "<i8")
        at += 8 * self.n_docs
        self.nulls = np.frombuffer(read(at, self.n_docs), "u1").view(bool)
        at += self.n_docs
        self.ends = np.frombuffer(read(at, 8 * self.n_docs), "<u8").astype(np.int64)

    def token(self, i: int) -> int:
        """The id at place ``i`` of the file."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        base = int(self.offsets[i // self.segment_ids])
        (levels,) = struct.unpack("<I", self.read(base, 4))
        parts = _parts(self.read(base, 4 + 4 * levels))
        at, value = i % self.segment_ids, 0
        for k, (_, chunks, bitmap, ranks) in enumerate(parts):
            value |= self.read(base + chunks + at, 1)[0] << (8 * k)
            if k + 1 == len(parts) or not self.read(base + bitmap + at // 8, 1)[0] >> at % 8 & 1:
                return value
            block = at // RANK_EVERY
            (rank,) = struct.unpack("<I", self.read(base + ranks + 4 * block, 4))
            before = at - block * RANK_EVERY
            bits = self.read(base + bitmap + block * RANK_EVERY // 8, (before + 7) // 8)
            marks = int.from_bytes(bits, "little") & ((1 << before) - 1)
            at = rank + marks.bit_count()
        return value

    def segments(self) -> Iterator[np.ndarray]:
        for start, end in zip(self.offsets, self.offsets[1:], strict=False):
            yield decode_segment(self.read(int(start), int(end - start)))

    def documents(self) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
        """Id, place of its first id and ids, in pieces, of every document."""
        segments, piece, start = self.segments(), np.zeros(0, np.uint32), 0
        for doc_id, null, end in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.ends.tolist(), strict=True):
            want, parts = end - start, []
            while want:
                if not len(piece):
                    piece = next(segments)
                parts.append(piece[:want])
                want -= len(parts[-1])
                piece = piece[len(parts[-1]):]
            yield None if null else doc_id, start, parts
            start = end
