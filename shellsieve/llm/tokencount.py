"""Numbers of tokens under a unigram vocabulary, without making the tokens.

Of all ways to cut a text into pieces of the vocabulary, a unigram tokenizer takes the one of
the highest sum of scores. An Aho-Corasick automaton gives the pieces that end at each
character; dynamic programming carries the best score and the number of pieces of the way
that has it. Ties go as in the tokenizer: of ways of equal score to a place the one whose last
piece starts first is kept. A character that is no piece costs the least score and a
penalty, and counts as the pieces of its bytes.

Blanks are marks that pieces may begin with but never hold later, and no piece holds a line
break, so a way never crosses from a character to a blank or over a line break. Words are
therefore counted on their own, and a worker remembers them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from shellsieve.llm.common import col, ship

MARK, MARK_BYTES = "▁", "▁".encode()
UNKNOWN_PENALTY = 10.0
#: Words a worker remembers, the longest of them in bytes, and bytes of a text at once.
CACHE_WORDS, CACHE_BYTES, PIECE_BYTES = 1_000_000, 64, 1 << 20

_SEGMENTS = re.compile(rb" *[^ \n]+| +|\n")
_counters: dict[str, Counter] = {}


class Counter:
    """Counts tokens with pieces and scores; bytes are pieces too."""

    def __init__(self, pieces: dict[str, float], least: float | None = None):
        bad = next((p for p in pieces if MARK in p.lstrip(MARK) or "\n" in p or " " in p), None)
        if bad is not None:
            raise ValueError(f"a piece crosses words: {bad!r}")
        self.unknown = (min(pieces.values(), default=0.0) if least is None else least) - UNKNOWN_PENALTY
        self.pieces = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()
        self.known: dict[bytes, int] = {}

    @classmethod
    def load(cls, path: str) -> Counter:
        """Of the ordinary pieces of a model file that has a piece for every byte."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        if sum(map(model.is_byte, ids)) != 256:
            raise ValueError("the vocabulary lacks bytes")
        plain = [
            i for i in ids
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        return cls({model.id_to_piece(i): model.get_score(i) for i in plain})

    @staticmethod
    def of(path: str) -> Counter:
        """The one of this process."""
        if path not in _counters:
            _counters[path] = Counter.load(path)
        return _counters[path]

    def best(self, text: str) -> int:
        """Pieces of the best way through ``text``, in which blanks are marks."""
        ending: list[list[tuple[int, float]]] = [[] for _ in range(len(text) + 1)]
        for end, match in self.pieces.iter(text):
            ending[end + 1].append(match)
        scores, counts = [0.0], [0]
        for end in range(1, len(text) + 1):
            top, count, single = float("-inf"), 0, False
            for length, score in sorted(ending[end], reverse=True):
                score += scores[end - length]
                if score > top:
                    top, count = score, counts[end - length] + 1
                single = single or length == 1
            if not single and scores[end - 1] + self.unknown > top:
                top = scores[end - 1] + self.unknown
                count = counts[end - 1] + len(text[end - 1].encode("utf-8", "replace"))
            scores.append(top)
            counts.append(count)
        return counts[-1]

    def _segment(self, segment: bytes) -> int:
        found = self.known.get(segment)
        if found is None:
            found = self.best(segment.decode("utf-8", "replace").replace(" ", MARK))
            if len(segment) <= CACHE_BYTES:
                if len(self.known) >= CACHE_WORDS:
                    self.known.clear()
                self.known[segment] = found
        return found

    def count(self, text: bytes) -> int:
        """Tokens of a text; a blank is put in front of one that is not empty."""
        if not text:
            return 0
        text, total, start = b" " + text.replace(MARK_BYTES, b" "), 0, 0
        known, segment = self.known, self._segment
        while start < len(text):
            end = start + PIECE_BYTES
            while end < len(text) and not (text[end] == 32 and text[end - 1] != 32):
                end += 1
            for word in _SEGMENTS.findall(text, start, end):
                n = known.get(word)
                total += segment(word) if n is None else n
            start = end
        return total


def token_counts(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row.

    ``model`` is the path of a vocabulary file that every machine can read. A null or empty
    text has no tokens. The whole text counts. An empty table gives no rows.
    """
    ship(docs.sparkSession)

    @F.pandas_udf(LongType())
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter.of(model)
        for texts in batches:
            yield pd.Series([counter.count(x or b"") for x in texts], dtype="int64")

    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    return docs.select(
        col(id_col).alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        tokens(text.cast("binary")).alias("n_tokens"),
    )
