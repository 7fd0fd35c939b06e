"""What the operators share: columns by name, folding, words, stored tables, sizes."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shellsieve.sources.checkpoints import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A table is broadcast only if its measured size is below this many bytes.
BROADCAST_BYTES = 32 << 20


def col(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def lower_ascii(text: Column) -> Column:
    """A-Z lowered, all else kept. Texts of one byte a character take the fast function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names that no column of ``df`` has, in any case."""
    taken = {name.lower() for name in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def sized_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for a broadcast if its rows, counted, take less than ``limit`` bytes."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def join_back(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """``docs`` joined with ``keys`` (doc_id, digest, more) by id and digest of the text.

    Two rows of equal id and equal text get the same partner; a null id is an id.
    """
    left, right = fresh(docs, "key_id", "key_digest")
    keys = keys.withColumnRenamed("doc_id", left).withColumnRenamed("digest", right)
    on = col(id_col).eqNullSafe(col(left)) & (digest(col(text_col)) == col(right))
    out = docs.join(keys, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(left, right)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, whose machines need not have it."""
    root = Path(__file__).resolve().parents[1]
    files = sorted(root.rglob("*.py"))
    content = hashlib.sha256(b"".join(f.read_bytes() for f in files)).hexdigest()[:16]
    name = f"{root.name}-{content}.zip"
    if name in spark.sparkContext._python_includes:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), name)
    with zipfile.ZipFile(archive, "w") as out:
        for file in files:
            out.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)


def digest(text: Column) -> Column:
    """Together with the id it stands for a row in narrow tables; null has a value of its own."""
    return F.xxhash64(text.cast("string"), text.isNull())


__all__ = [
    "BROADCAST_BYTES", "col", "digest", "fresh", "join_back", "lower_ascii", "ship",
    "sized_broadcast", "stored",
]
