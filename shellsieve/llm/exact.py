"""Exact duplicates by block naming.

Every text, A-Z lowered, is cut into blocks of a fixed number of bytes. The distinct blocks
are dealt by hash and sorted; the place in that order is the integer name of a block. Adjacent
names are paired, distinct pairs are sorted and named the same way, and so on until each text
is one name. Texts that need the same number of rounds are equal exactly if their last names
are; no hash decides it.

Blocks cross the network once, when they are sorted, distinct per task. Names get back to
the texts through a short key of the block, and the sorted blocks prove that no two of them share
a key; if two do, the work is done again with a wider key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellsieve.llm.common import col, lower_ascii, stored
from shellsieve.sources.checkpoints import Scratch

BLOCK_BYTES = 4096

#: Keys of a block, tried in turn.
KEYS: tuple[Callable[[Column], Column], ...] = (
    lambda block: F.xxhash64(block),
    lambda block: F.sha2(block, 256),
)


def _blocks(text: Column, block_bytes: int) -> Column:
    """The bytes of a text in pieces; the empty text is one empty block."""
    data = text.cast("binary")
    last = F.greatest(F.ceil(F.octet_length(text) / F.lit(block_bytes)), F.lit(1)) - 1
    starts = F.sequence(F.lit(0), last.cast("int"))
    return F.transform(
        starts, lambda i: F.substring(data, i * F.lit(block_bytes) + 1, F.lit(block_bytes))
    )


def _named(distinct: DataFrame, *by: str) -> DataFrame:
    """Integer names for distinct rows: their place in the sorted partitions."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _first_names(docs: DataFrame, block_bytes: int, keys, stored) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, text_sha256, keys) and block names (key, name), both stored."""
    for key in keys:
        blocks = docs.select("doc_id", "text", _blocks(F.col("text"), block_bytes).alias("blocks"))
        names = stored(
            _named(
                blocks.select(F.explode("blocks").alias("block")).distinct(), "block"
            ).select(key(F.col("block")).alias("key"), "name"),
            "block-names",
        )
        if names.groupBy("key").count().filter("count > 1").isEmpty():
            rows = stored(
                blocks.select(
                    F.monotonically_increasing_id().alias("row"),
                    "doc_id",
                    F.sha2("text", 256).alias("text_sha256"),
                    F.transform("blocks", key).alias("keys"),
                ),
                "block-rows",
            )
            return rows, names
    raise ValueError("two different blocks share every key")


def block_identities(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    keys=KEYS,
) -> DataFrame:
    """One row per document: row, doc_id, text_sha256, level and name; stored.

    ``level`` is the number of pairing rounds and ``name`` the name in the last of them.
    A null text counts as empty.
    """
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    base = docs.select(col(id_col).alias("doc_id"), lower_ascii(text).alias("text"))
    scratch = Scratch(docs.sparkSession)
    rows, names = _first_names(base, block_bytes, keys, scratch.stored)
    at = rows.select("row", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "key"))
    at = scratch.stored(at.join(names, "key").select("row", "n", "pos", "name"), "level-0")
    most = rows.agg(F.max(F.size("keys"))).first()[0] or 1
    ended, level = [at.filter("n = 1").select("row", F.lit(0).alias("level"), "name")], 0
    while most > 1:
        level, most = level + 1, (most + 1) // 2
        even = F.col("pos") % 2 == 0
        pairs = at.filter("n > 1").groupBy("row", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.first("n").alias("n"),
            F.max(F.when(even, F.col("name"))).alias("left"),
            # The last name of an odd row has no right neighbour.
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"),
        )
        pairs = scratch.stored(pairs, f"pairs-{level}")
        names = scratch.stored(
            _named(pairs.select("left", "right").distinct(), "left", "right"), f"pair-names-{level}"
        )
        half = F.expr("(n + 1) div 2").cast("int").alias("n")
        at = pairs.join(names, ["left", "right"]).select("row", half, "pos", "name")
        at = scratch.stored(at, f"level-{level}")
        ended.append(at.filter("n = 1").select("row", F.lit(level).alias("level"), "name"))
    idents = ended[0]
    for more in ended[1:]:
        idents = idents.unionByName(more)
    out = stored(rows.drop("keys").join(idents, "row"), "identities")
    scratch.drop()
    return out


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    keys=KEYS,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    Texts are equal if identical after lowering A-Z; a null text is empty. Of equal texts the
    row with the largest id stays, a null id being the smallest; exactly one of rows that also
    share their id. Every input row gives one row, an empty table none; columns other than id
    and text are not looked at.
    """
    rows = block_identities(docs, id_col, text_col, block_bytes, keys)
    groups = stored(
        rows.groupBy("level", "name").agg(
            F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size")
        ),
        "identity-groups",
    )
    return rows.join(groups, ["level", "name"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
    )
