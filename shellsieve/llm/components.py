"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellsieve.sources.checkpoints import Scratch


def _state(edges: DataFrame):
    return edges.agg(
        F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))
    ).first()


def components(links: DataFrame) -> DataFrame:
    """node and root (smallest node of its component) of every node that has a link.

    Each round links a node's larger neighbours to its smallest one, then the smaller ones.
    A round is a grouping and a join on the node; least neighbours are stored before the join,
    so that both sides are shuffled and a node with very many links can be split.
    """
    scratch = Scratch(links.sparkSession)
    stored = scratch.stored
    a, b = F.col(links.columns[0]), F.col(links.columns[1])
    edges = stored(
        links.filter(a != b)
        .select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"))
        .distinct(),
        "links",
    )
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("high").alias("node"), F.col("low").alias("other")).unionByName(
            edges.select(F.col("low").alias("node"), F.col("high").alias("other"))
        )
        least = stored(
            both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least")), "least"
        )
        edges = stored(
            both.filter(F.col("other") > F.col("node"))
            .join(least, "node")
            .select(F.col("other").alias("high"), F.col("least").alias("low"))
            .distinct(),
            "large-star",
        )
        least = stored(edges.groupBy("high").agg(F.min("low").alias("least")), "least")
        lower = edges.join(least, "high").filter(F.col("low") != F.col("least")).select(
            F.col("low").alias("high"), F.col("least").alias("low")
        )
        edges = stored(
            lower.unionByName(least.select("high", F.col("least").alias("low"))).distinct(),
            "small-star",
        )
        scratch.drop(keep=[edges])
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root"))
