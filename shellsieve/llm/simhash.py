"""Near duplicates by SimHash, found through an index over bytes of the fingerprint.

Fingerprints of at most two differing bits agree in at least six of their eight bytes. The
index is keyed by four bytes at given positions: bytes 0-1, 2-3, 4-5 and 6-7 are four units,
a key holds two of them, and of the four units at least two are free of differing bits, so
each linked pair meets under at least one of the six keys. Pairs that meet are counted: those
which share six positional bytes or more go on to the count of differing bits.

A key that many different fingerprints share is not paired up. There each fingerprint is put
under itself and under every fingerprint one bit away in the four free bytes, and linked with
the smallest under the same entry: two fingerprints are at most two bits apart exactly if
such entries coincide. That keeps all connections with 33 rows a fingerprint.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from shellsieve.llm.common import col, digest, join_back, ship, stored
from shellsieve.llm.components import components
from shellsieve.sources.checkpoints import Scratch

SHINGLE_WORDS = 3
MAX_BITS = 2
MIN_SHARED_BYTES = 8 - MAX_BITS
#: Different fingerprints under one key that are still compared pair by pair.
PAIRED_UP_TO = 48
#: Bytes and shingles of a text that are worked on at once.
PIECE_BYTES, PIECE_SHINGLES = 1 << 20, 1 << 16

_hash = partial(xxhash.xxh64_intdigest, seed=42)
SPACE = b" \t\n\r\x0b\x0c"


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lowered, in lists of bounded size."""
    start, size = 0, len(text)
    while start < size:
        end = min(start + PIECE_BYTES, size)
        while end < size and text[end] not in SPACE:
            end += 1
        yield text[start:end].lower().split()
        start = end


def _shingles(text: bytes, width: int) -> Iterator[bytes]:
    head: list[bytes] = []
    any_yet = False
    for words in _words(text):
        words = head + words
        if len(words) >= width:
            any_yet = True
            yield from map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
            head = words[len(words) - width + 1:] if width > 1 else []
        else:
            head = words
    if head and not any_yet:
        yield b" ".join(head)


def fingerprint(text: bytes | None, width: int = SHINGLE_WORDS) -> int:
    """The SimHash of a text: a bit is set if it is set in over half the shingles' XXH64."""
    ones, n = np.zeros(64, np.int64), 0
    hashes = map(_hash, _shingles(text or b"", width))
    while len(part := np.fromiter(itertools.islice(hashes, PIECE_SHINGLES), np.uint64)):
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(part)
    packed = np.packbits(2 * ones > n, bitorder="little")
    return int(packed.view(np.int64)[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS
) -> DataFrame:
    """doc_id, digest of the text and fp (the fingerprint as a long) of every row."""

    ship(docs.sparkSession)

    @F.pandas_udf(LongType())
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(x, width) for x in texts], dtype="int64")

    return docs.select(
        col(id_col).alias("doc_id"),
        digest(col(text_col)).alias("digest"),
        simhash(col(text_col).cast("string").cast("binary")).alias("fp"),
    )


def _byte(fp, position: int):
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def links(prints: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Pairs (a, b) of different fingerprints that connect all at most two bits apart.

    ``prints`` has distinct values ``fp``. Every pair is a true link; where a key is shared by
    more than ``PAIRED_UP_TO`` fingerprints, some links that others imply are left out.
    """
    stored = (scratch or Scratch(prints.sparkSession)).stored
    free = {}
    keys = []
    for number, units in enumerate(itertools.combinations(range(4), 2)):
        mask = sum(0xFFFF << (16 * u) for u in units)
        free[number] = [bit for u in range(4) if u not in units for bit in range(16 * u, 16 * u + 16)]
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(
            F.struct(
                F.lit(number).alias("units"),
                F.col("fp").bitwiseAND(F.lit(signed)).alias("bytes"),
            )
        )
    index = prints.select("fp", F.explode(F.array(*keys)).alias("key")).select("key.*", "fp")
    sizes = stored(index.groupBy("units", "bytes").count().filter("count > 1"), "posting-sizes")
    index = stored(index.join(sizes, ["units", "bytes"]), "postings")

    few = index.filter(F.col("count") <= PAIRED_UP_TO).drop("count")
    a, b = few.withColumnRenamed("fp", "a"), few.withColumnRenamed("fp", "b")
    shared = sum(
        (_byte(F.col("a"), p) == _byte(F.col("b"), p)).cast("int") for p in range(8)
    )
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = (
        a.join(b, ["units", "bytes"])
        .filter(F.col("a") < F.col("b"))
        .filter(shared >= MIN_SHARED_BYTES)
        .filter(apart <= MAX_BITS)
        .select("a", "b")
    )

    many = index.filter(F.col("count") > PAIRED_UP_TO)
    flips = [
        F.when(
            F.col("units") == number,
            F.array(
                F.col("fp"),
                *(
                    F.col("fp").bitwiseXOR(F.lit((1 << bit) - (1 << 64) * (bit == 63)))
                    for bit in bits
                ),
            ),
        )
        for number, bits in free.items()
    ]
    near = many.select("units", "bytes", "fp", F.explode(F.coalesce(*flips)).alias("entry"))
    # At most 33 different fingerprints are under an entry.
    stars = near.groupBy("units", "bytes", "entry").agg(
        F.min("fp").alias("a"), F.collect_set("fp").alias("all")
    )
    stars = stars.filter(F.size("all") > 1).select("a", F.explode("all").alias("b"))
    return pairs.unionByName(stars.filter(F.col("a") < F.col("b"))).distinct()


def _classes(rows: DataFrame) -> DataFrame:
    """fp, root of its component and component_id of every distinct fingerprint of stored ``rows``."""
    scratch = Scratch(rows.sparkSession)
    prints = scratch.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = components(links(prints.select("fp"), scratch))
    prints = scratch.stored(
        prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "least", F.coalesce("root", "fp").alias("root")
        ),
        "prints-rooted",
    )
    least = scratch.stored(prints.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    out = stored(prints.join(least, "root").select("fp", "root", "component_id"), "classes")
    scratch.drop()
    return out


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Words are parted by ASCII white space, A-Z lowered; fewer words than a shingle are one
    shingle; a text without words, null included, has the fingerprint zero and links like any
    other. Rows of equal fingerprint link. ``component_id`` is the smallest id that links
    reach, nulls left out (null if there are only nulls). An empty table gives no rows.
    """
    rows = stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    return rows.join(_classes(rows), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the row of the smallest id, nulls last, of each root of ``members``.

    ``members`` has doc_id, digest and root of every row. Of rows that share id and text one stays.
    """
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("digest"))).alias("one")
    keep = stored(
        members.groupBy("root").agg(first).select("one.doc_id", "one.digest").distinct(), "kept"
    )
    out = join_back(docs, keep, id_col, text_col, "left_semi")
    again = members.join(keep.withColumnRenamed("doc_id", "id"), "digest").filter(
        F.col("doc_id").eqNullSafe(F.col("id"))
    )
    if again.groupBy("doc_id", "digest").count().filter("count > 1").isEmpty():
        return out
    return out.dropDuplicates([id_col, text_col])


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS
) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, nulls last.

    Of rows that share id and text one stays.
    """
    rows = stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes = _classes(rows)
    return one_of_each(docs, rows.join(classes, "fp"), id_col, text_col)
