"""Texts to token ids, written as files of directly addressable codes and read back.

Documents are put in order of their id by a range sort; each task encodes its range and
writes one file to the folder that the cluster shares. A manifest, which Spark commits, names the
file of the attempt that succeeded, so repeated and speculative tasks do no harm.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shellsieve.llm import dac
from shellsieve.llm.common import col, ship, stored
from shellsieve.sources.checkpoints import shared_folder

END_ID = 2
#: Words whose ids a worker remembers, and the longest of them; more are forgotten at once.
CACHE_WORDS, CACHE_BYTES = 800_000, 64
#: Rows and bytes of texts that are encoded at once.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20

#: Latin letters (ASCII and U+00C0 to U+00FF but the two signs among them), then ASCII signs.
_RUNS = re.compile(
    rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*)([!-&(-/:-@\[-`{-~]*)"
)
_RUN_CHARACTERS = [chr(c) for c in range(0x100) if _RUNS.fullmatch(chr(c).encode())]

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and no token or normalisation reaches across it, so the
    ids of a text are those of its words between ASCII white space, and the ids of a word
    are worked out once while it is remembered. The tokenizer folds case by itself; folding
    A-Z of words that are ASCII beforehand only makes more of them equal.

    It also parts letters from other characters. Where a word is a run of Latin letters or of
    ASCII signs but the apostrophe, or one after the other, each run is one unit to it and
    nothing but case changes in it, so the lowered run goes straight to the tokenizer's model.

    Tokens added to the vocabulary, like one for the end of a text, are found in the text as it
    is, in the middle of a word too. A word that holds one, in any case of letters, goes to the
    tokenizer as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(t.split() != [t] for t in added):
            raise ValueError("an added token holds white space")
        self.added = re.compile(b"|".join(re.escape(t.encode()) for t in added) or b"(?!)", re.IGNORECASE)
        self.ids: dict[bytes, bytes] = {}
        # The letters that the model spells each character of a run with.
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelt = {ord(c): "".join(x for x, _ in spell(c)) for c in _RUN_CHARACTERS}

    @staticmethod
    def of(path: str) -> Encoder:
        """The one of this process."""
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def _encode_run(self, run: bytes) -> bytes:
        found = self.tokenizer.model.tokenize(run.decode().lower().translate(self.spelt))
        return b"".join(token.id.to_bytes(4, "little") for token in found)

    def _learn(self, words: set[bytes]) -> None:
        """Remember the ids of new words."""
        ids, others = self.ids, []
        for word in words:
            match = _RUNS.fullmatch(word)
            if not match or self.added.search(word):
                others.append(word)
                continue
            found = b""
            for run in filter(None, match.groups()):
                part = ids.get(run)
                if part is None:
                    part = self._encode_run(run)
                    if len(run) <= CACHE_BYTES:
                        ids[run] = part
                found += part
            ids[word] = found
        texts = [word.decode("utf-8", "replace") for word in others]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        for word, x in zip(others, found, strict=True):
            ids[word] = b"".join(i.to_bytes(4, "little") for i in x.ids)

    def _words(self, text: bytes) -> list[bytes]:
        """Words, A-Z lowered where that changes no ids."""
        if self.added.search(text):
            return [w.lower() if w.isascii() and not self.added.search(w) else w for w in text.split()]
        if text.isascii():
            return text.lower().split()
        return [w.lower() if w.isascii() else w for w in text.split()]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        parted = [self._words(text) for text in texts]
        new = set().union(*parted).difference(self.ids)
        if len(self.ids) + len(new) > CACHE_WORDS:
            self.ids.clear()
            new = set().union(*parted)
        self._learn(new)
        out = [b"".join(map(self.ids.__getitem__, words)) for words in parted]
        for word in new:
            if len(word) > CACHE_BYTES:
                del self.ids[word]
        return out


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[list[tuple[int | None, bytes]]]:
    held, size = [], 0
    for frame in frames:
        for doc_id, text in zip(frame["doc_id"].array, frame["text"].array, strict=True):
            held.append((None if pd.isna(doc_id) else int(doc_id), text or b""))
            size += len(held[-1][1])
            if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    """A file system and the folder's path in it."""
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write the ids of all texts in ascending order of the id; returns the manifest, stored.

    The manifest has a row per file: part (files in order), path, n_docs, n_tokens and start
    (ids in the files before). A null text is empty, every document ends with ``end_id``; null
    ids come first; rows of equal id are ordered by a hash of the text. ``tokenizer`` is a path
    every machine can read. An empty table writes no file.
    """
    ship(docs.sparkSession)
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.cast("binary").alias("text")
    )
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    end = end_id.to_bytes(4, "little")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batches = _batches(frames)
        first = next(batches, None)
        if first is None:
            return
        encoder = Encoder.of(tokenizer)
        part = TaskContext.get().partitionId()
        where, base = _place(folder)
        where.create_dir(base, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.dac"
        with where.open_output_stream(f"{base}/{name}") as stream:
            writer, batch = dac.Writer(stream), first
            while batch:
                for (doc_id, _), ids in zip(batch, encoder.encode([t for _, t in batch]), strict=True):
                    writer.add(doc_id, ids + end)
                batch = next(batches, None)
            writer.close()
        yield pd.DataFrame(
            {"part": [part], "path": [f"{folder}/{name}"], "n_docs": [len(writer.ends)], "n_tokens": [writer.n_ids]}
        )

    manifest = stored(
        rows.select("doc_id", "text").mapInPandas(write, "part int, path string, n_docs long, n_tokens long"),
        "token-manifest",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long"))
    return stored(manifest.withColumn("start", start), "token-manifest")


def open_tokens(path: str) -> dac.Reader:
    """A reader for random access to the ids of one file."""
    where, name = _place(path)
    source = where.open_input_file(name)

    def read(offset: int, size: int) -> bytes:
        source.seek(offset)
        return source.read(size)

    return dac.Reader(read, source.size())


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files.

    ``start`` is the number of ids before, over all files; ``ids_crc32`` is over the ids as
    little-endian unsigned 32-bit integers. One task reads one file, a segment at a time.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, base in zip(frame["path"], frame["start"], strict=True):
                rows = []
                for doc_id, start, parts in open_tokens(path).documents():
                    crc, n = 0, 0
                    for part in parts:
                        crc, n = zlib.crc32(part.astype("<u4", copy=False).tobytes(), crc), n + len(part)
                    rows.append((doc_id, int(base) + start, n, crc))
                    if len(rows) >= 10_000:
                        yield _frame(rows)
                        rows = []
                if rows:
                    yield _frame(rows)

    ship(manifest.sparkSession)
    files = manifest.select("path", "start").repartition(max(1, manifest.count()))
    return files.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    return out.astype({"doc_id": "Int64"})


def token_files(
    docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents of files written below the shared folder; see ``read_tokens``."""
    spark: SparkSession = docs.sparkSession
    folder = shared_folder(spark, "tokens")
    return read_tokens(write_tokens(docs, tokenizer, folder, end_id, id_col, text_col))
