"""Places of many literals in many texts at once, worked out over the bytes of the texts.

The eight bytes that begin at a place are read as one number, for all places of a stretch at once.
A table of 16 slots a part tells the few places where a part of a literal may stand; the part is
compared there, then the rest of the literals filed under it. All of that are operations on arrays:
the cost is a few of them a byte, one a literal's part found, and does not grow with the literals.

Letters are folded first: A to Z, and the two letters that fold to ASCII ones, the long s and
the Kelvin sign. They are two and three bytes long, so places are brought back to the text given.
"""

import re

import numpy as np
import pyarrow as pa

#: Sizes of parts in bytes; a literal has parts of the largest size that it is not shorter than.
SIZES = (8, 4, 3, 2, 1)
#: Places looked at together, which fit a processor's cache; bytes of whole texts; pairs of place and literal.
_CHUNK, _GROUP, _PAIRS = 1 << 15, 4 << 20, 1 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_LONGER = (("\u017f".encode(), b"s"), ("\u212a".encode(), b"k"))


def part_size(length):
    return next(size for size in SIZES if size <= length)


def part_keys(parts):
    """The numbers of byte strings of at most eight bytes."""
    return np.array(parts, dtype="S8").view("<u8").astype(np.uint64)


def folded(data):
    """``data`` with letters folded; if that is shorter, also where in ``data`` each byte of it comes from."""
    low = data.translate(_LOWER)
    if not any(letter in low for letter, _ in _LONGER):
        return low, None
    out, kept = np.frombuffer(low, np.uint8).copy(), np.ones(len(low), bool)
    for letter, short in _LONGER:
        at = np.array([found.start() for found in re.finditer(letter, low)], dtype=np.int64)
        out[at] = short[0]
        for more in range(1, len(letter)):
            kept[at + more] = False
    return out[kept].tobytes(), np.flatnonzero(kept)


def groups_of(array):
    """Texts of an Arrow array, some MB at once: their bytes, and where each begins and the last ends."""
    array = array.cast(pa.large_binary())
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset:array.offset + len(array) + 1]
    first = 0
    while first < len(array):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _GROUP, "right")) - 1)
        begin, end = int(offsets[first]), int(offsets[last])
        yield data[begin:end].to_pybytes() if end > begin else b"", offsets[first:last + 1] - begin
        first = last


def _numbers(data):
    """The eight bytes from each place on as a number; zeros follow the end."""
    return np.ndarray(shape=(len(data),), dtype="<u8", buffer=data + bytes(8), strides=(1,))


class Parts:
    """Different byte strings of one size, by their numbers in ``keys``."""

    def __init__(self, size, keys):
        bits = min(max(12, (16 * len(keys)).bit_length()), 24)
        self.size, self.mask, self.shift = size, np.uint64((1 << 8 * size) - 1), np.uint64(64 - bits)
        slots = self._slots(keys)
        order = np.argsort(slots, kind="stable")
        self.keys, self.ids = keys[order], order
        self.first = np.searchsorted(slots[order], np.arange((1 << bits) + 1))
        held = np.diff(self.first)
        self.held, self.shared = held > 0, held > 1

    def _slots(self, keys):
        slots = keys * _SPREAD
        slots >>= self.shift
        return slots.view(np.int64)

    def found(self, numbers):
        """Where in ``numbers`` parts stand, and which of them."""
        if self.size < 8:
            numbers = numbers & self.mask
        slots = self._slots(numbers)
        places = np.flatnonzero(self.held.take(slots, mode="clip"))
        keys, slots = numbers[places], slots[places]
        entry = self.first[slots]
        hit = self.keys[entry] == keys
        which = self.ids[entry]
        # Another part of the slot may be the one.
        rest = np.flatnonzero(~hit & self.shared[slots])
        entry, end = entry[rest] + 1, self.first[slots[rest] + 1]
        while len(rest):
            same = self.keys[entry] == keys[rest]
            which[rest[same]], hit[rest[same]] = self.ids[entry[same]], True
            entry += 1
            on = ~same & (entry < end)
            rest, entry, end = rest[on], entry[on], end[on]
        return places[hit], which[hit]


class PartCounts:
    """How often each of ``parts``, byte strings, stands in texts."""

    def __init__(self, parts):
        self.parts, self.tables = parts, []
        sizes = np.array([len(part) for part in parts])
        for size in SIZES:
            of_size = np.flatnonzero(sizes == size)
            if len(of_size):
                self.tables.append((of_size, Parts(size, part_keys([parts[i] for i in of_size]))))

    def count(self, arrays):
        """Number of places by part over all texts of the Arrow arrays; a part may reach into the next text."""
        counts = np.zeros(len(self.parts), np.int64)
        for array in arrays:
            for data, _ in groups_of(array):
                numbers = _numbers(folded(data)[0])
                found = [[] for _ in self.tables]
                for start in range(0, len(numbers), _CHUNK):
                    chunk = numbers[start:start + _CHUNK].copy()
                    for which, (_, table) in zip(found, self.tables):
                        which.append(table.found(chunk)[1])
                for which, (of_size, _) in zip(found, self.tables):
                    if which:
                        counts[of_size] += np.bincount(np.concatenate(which), minlength=len(of_size))
        return counts


class Literals:
    """Folded ``literals`` with numbers, each filed under one of its ``parts``.

    ``plain`` holds the text that a literal stands for, letters as they are, ``(?i)`` before it if its case
    does not matter, or None for a literal that is only a part of what is looked for.
    """

    def __init__(self, numbers, parts, literals, plain):
        parts, literals = [part.encode() for part in parts], [literal.encode() for literal in literals]
        plain = [None if text is None else text.encode() for text in plain]
        self.numbers = np.array(numbers, np.int64)
        self.lengths = np.array([len(literal) for literal in literals], np.int64)
        self.at = np.array([literal.index(part) for part, literal in zip(parts, literals)], np.int64)
        self.plain = np.array([text is not None for text in plain], bool)
        self.exact = np.array([text is not None and not text.startswith(b"(?i)") for text in plain], bool)
        # What is left to compare once the part is found; all of it where case matters, in the text as given.
        self.folded_words = _Words([
            [] if exact else [word for word in _words(literal) if word != (at, part)]
            for literal, at, part, exact in zip(literals, self.at.tolist(), parts, self.exact)
        ])
        self.exact_words = _Words([_words(text) if exact else [] for text, exact in zip(plain, self.exact)])
        sizes, keys = np.array([len(part) for part in parts], np.int64), part_keys(parts)
        self.tables = []
        for size in SIZES:
            of_size = np.flatnonzero(sizes == size)
            if len(of_size):
                different, which = np.unique(keys[of_size], return_inverse=True)
                order = np.argsort(which, kind="stable")
                first = np.searchsorted(which[order], np.arange(len(different) + 1))
                self.tables.append((Parts(size, different), of_size[order], first))

    def search(self, array):
        """Array of (number, starts) for each text: the literals it holds, in the order given.

        ``starts`` are line and column, from 1 on, of the places of a plain literal, of overlapping ones
        those that a search from the left finds; NULL for others.
        """
        found = [self._in_group(data, offsets) for data, offsets in groups_of(array)]
        none = (np.zeros(0, np.int64),) * 5
        in_text, rules, n_starts, line, column = (np.concatenate(part) for part in zip(none, *found))
        starts = pa.ListArray.from_arrays(
            pa.array(_offsets(n_starts), pa.int32()),
            pa.StructArray.from_arrays([pa.array(line), pa.array(column)], ["line", "column"]),
            mask=pa.array(~self.plain[rules]),
        )
        hits = pa.StructArray.from_arrays([pa.array(self.numbers[rules]), starts], ["number", "starts"])
        return pa.ListArray.from_arrays(pa.array(_offsets(in_text), pa.int32()), hits)

    def _in_group(self, data, offsets):
        """Literals held by each text; of each pair of text and literal the literal and its number of starts; the starts."""
        low, back = folded(data)
        texts, rules, places = self._places(low, back, data, offsets)
        keys = texts * len(self.numbers) + rules
        order = np.argsort(keys, kind="stable")
        keys, texts, rules, places = keys[order], texts[order], rules[order], places[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        pairs = np.flatnonzero(new)
        counted = self.plain[rules] & _apart(places, new, self.lengths[rules])
        n_starts = np.add.reduceat(counted, pairs, dtype=np.int64) if len(pairs) else np.zeros(0, np.int64)
        places = places[counted] if back is None else back[places[counted]]
        line, column = _lines(data, offsets[texts[counted]], places)
        return np.bincount(texts[pairs], minlength=len(offsets) - 1), rules[pairs], n_starts, line, column

    def _places(self, low, back, data, offsets):
        """Text, literal and place in ``low`` of all that ``data`` holds; places of a literal ascend."""
        ends = offsets if back is None else np.searchsorted(back, offsets)
        numbers, given = _numbers(low), _numbers(data)
        out = [(np.zeros(0, np.int64),) * 3]
        for start in range(0, len(low), _CHUNK):
            chunk = numbers[start:start + _CHUNK].copy()
            for table, filed, first in self.tables:
                at, which = table.found(chunk)
                for at, rules in _pairs(at + start, which, filed, first):
                    at = at - self.at[rules]
                    at, rules = _where((at >= 0) & (at + self.lengths[rules] <= len(low)), at, rules)
                    at, rules = _where(self.folded_words.held(numbers, at, rules), at, rules)
                    as_given = at if back is None else back[at]
                    at, rules = _where(self.exact_words.held(given, as_given, rules), at, rules)
                    texts = np.searchsorted(ends, at, "right") - 1
                    same = at + self.lengths[rules] <= ends[texts + 1]
                    out.append(_where(same, texts, rules, at))
        return (np.concatenate(part) for part in zip(*out))


class _Words:
    """For each literal some words of at most eight bytes, with their places in it."""

    def __init__(self, words):
        self.n = np.array([len(some) for some in words], np.int64)
        self.first = np.cumsum(self.n) - self.n
        self.at = np.array([at for some in words for at, _ in some], np.int64)
        self.keys = part_keys([word for some in words for _, word in some])
        self.masks = np.array([(1 << 8 * len(word)) - 1 for some in words for _, word in some], np.uint64)

    def held(self, numbers, places, literals):
        """Whether the words of each of ``literals`` stand at its place."""
        held, rest, n = np.ones(len(places), bool), np.flatnonzero(self.n[literals]), 0
        while len(rest):
            word = self.first[literals[rest]] + n
            same = (numbers[places[rest] + self.at[word]] & self.masks[word]) == self.keys[word]
            held[rest[~same]] = False
            n += 1
            rest = rest[same]
            rest = rest[self.n[literals[rest]] > n]
        return held


def _words(literal):
    """Words that cover a literal: eight bytes long, or one of all it has."""
    last = max(len(literal) - 8, 0)
    return [(at, literal[at:at + 8]) for at in (*range(0, last, 8), last)]


def _offsets(sizes):
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def _where(kept, *arrays):
    return tuple(array[kept] for array in arrays)


def _pairs(at, which, filed, first):
    """Places and the literals filed under the part that stands there, some at once."""
    begins = first[which]
    sizes = first[which + 1] - begins
    if sizes.max(initial=0) == 1:
        yield at, filed[begins]
        return
    ends = np.cumsum(sizes)
    begin = 0
    while begin < len(at):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + _PAIRS, "right")))
        n = sizes[begin:end]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(at[begin:end], n), filed[np.repeat(begins[begin:end], n) + within]
        begin = end


def _apart(places, new, lengths):
    """Which places a search from the left takes, where ``new`` begins the places of another text or literal."""
    taken = np.ones(len(places), bool)
    close = np.zeros(len(places), bool)
    close[1:] = ~new[1:] & (places[1:] - places[:-1] < lengths[1:])
    last = begin = -1
    for i in np.flatnonzero(close).tolist():
        # The place before the first of some close ones is taken.
        last, begin = i, begin if i == last + 1 else int(places[i - 1])
        if places[i] - begin < lengths[i]:
            taken[i] = False
        else:
            begin = int(places[i])
    return taken


def _lines(data, begins, places):
    """Line and column of places in texts that begin at ``begins``; columns count characters."""
    codes = np.frombuffer(data, np.uint8)
    lines = np.concatenate([[0], np.flatnonzero(codes == 10) + 1])
    line = np.searchsorted(lines, places, "right")
    start = np.maximum(lines[line - 1], begins)
    column = places - start
    if not data.isascii():
        characters = _offsets((codes & 0xC0) != 0x80)
        column = characters[places] - characters[start]
    return line - np.searchsorted(lines, begins, "right") + 1, column + 1
