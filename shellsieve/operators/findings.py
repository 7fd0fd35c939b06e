"""Filtering, counting, ordering and numbering of findings."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from shellsieve.functions.levels import rank_of
from shellsieve.schemas import RISK_LEVELS
from shellsieve.sources.checkpoints import stored

# Order in which a scan meets its findings: scripts by path, then the passes.
DISCOVERY = ("file_path", "phase", "rule_no", "line", "column", "rule_id")


def at_least(findings, level):
    """Findings of ``level`` or above; ``None`` keeps all."""
    return findings if level is None else findings.where(F.col("risk_rank") >= rank_of(level))


def level_counts(rank="risk_rank"):
    """Four count columns, critical to low, zero where nothing was found."""
    return [
        F.count_if(F.col(rank) == rank_of(level)).cast("long").alias(level.lower())
        for level in reversed(RISK_LEVELS)
    ]


def counts_by_level(findings, *keys):
    """Totals per level, for all findings or per ``keys``."""
    totals = [F.count(F.lit(1)).cast("long").alias("total_findings"), *level_counts()]
    return findings.groupBy(*keys).agg(*totals) if keys else findings.agg(*totals)


def counts_by(findings, *keys):
    return findings.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias("findings"))


def totals(scripts, counted):
    """One row: scripts (readable or not), findings and findings per level.

    ``counted`` is a one-row table of ``counts_by_level`` or ``level_totals``.
    """
    scripts = scripts.agg(F.count(F.lit(1)).cast("long").alias("total_scripts"))
    both = scripts.unionByName(counted, allowMissingColumns=True)
    return both.agg(*[F.max(name).alias(name) for name in both.columns])


def by_severity():
    """Most severe first; equal levels stay in discovery order."""
    return [F.col("risk_rank").desc(), *[F.col(name).asc() for name in DISCOVERY]]


def by_level_text():
    """Levels as text in descending order, the order of the legacy HTML report."""
    return [F.col("risk_level").desc(), *[F.col(name).asc() for name in DISCOVERY]]


def by_discovery():
    return [F.col(name).asc() for name in DISCOVERY]


def numbered(findings, order, name="finding_no", costly=True, store=stored):
    """``findings`` with their position 1..n in ``order``, computed in parallel.

    Rows are range-partitioned and sorted, so a row's number is its place in its partition
    plus the size of the partitions before it. The sorted rows are stored, because counting
    and numbering must see the same bounds. ``costly`` rows are stored before sorting too,
    so that sampling the bounds does not scan the texts a second time. ``store`` writes a
    table for a purpose and reads it back; that of a ``Scratch`` can delete it afterwards.
    """
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = store(findings, "findings") if costly else findings
    ranged = store(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("__part"), local.alias("__local")),
        "sorted",
    )
    # One row per partition of the sort, so the window over all of them is small.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__size")).select(
        "__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before")
    )
    return (
        ranged.join(F.broadcast(parts), "__part")
        .withColumn(name, F.col("__before") + F.col("__local") + 1)
        .drop("__part", "__local", "__before")
    )
