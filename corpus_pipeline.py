"""From raw documents to token files: each stage works on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shellsieve.llm.decontaminate import drop_contaminated
from shellsieve.llm.langid import drop_undetermined
from shellsieve.llm.mix import mixed
from shellsieve.llm.queries import table, tokenizer_path
from shellsieve.llm.simhash import drop_near_duplicates
from shellsieve.llm.tokens import token_files
from shellsieve.sources.checkpoints import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of undetermined language: no letter, or a score that no known text has."""
    return drop_undetermined(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that fingerprints of two bits' difference at most connect."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a passage of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; a row per document with its place, length and checksum, read back."""
    return token_files(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: SQL expresses neither the trained network nor the fingerprints' hash.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.stored(stage(spark, docs, sf_dir), f"stage-{name}")
        scratch.drop(keep=[docs])
    # The token files are written by the time this returns.
    out = STAGES[-1][1](spark, docs, sf_dir)
    scratch.drop()
    return out
