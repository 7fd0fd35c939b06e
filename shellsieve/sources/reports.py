"""Saved reports and findings tables."""

from pyspark.sql import functions as F

from shellsieve.schemas import FINDINGS, REPORT, REPORT_FINDING


def read_report_findings(spark, path):
    """Findings of a JSON report written by ``write_report``, read line by line in parallel.

    A line that such a report does not have, and a finding that does not parse, are errors.
    """
    line = F.col("value")
    finding = line.rlike(r"\A  [ ,] \{")
    other = line.rlike(r'\A(?:\{\z|\}\z|  "|  \]|  [ ,] ")')
    problem = F.raise_error(F.concat(F.lit("no line of a JSON report: "), line))
    body = F.when(finding, F.expr("substring(value, 5)")).when(~other, problem.cast("string"))
    return (
        spark.read.text(path)
        .select(body.alias("body"))
        .where(F.col("body").isNotNull())
        .select(F.from_json("body", REPORT_FINDING, {"mode": "FAILFAST"}).alias("finding"))
        .select("finding.*")
    )


def read_reports(spark, path):
    """Whole JSON reports, one file each, as one row per report."""
    return spark.read.schema(REPORT).option("multiLine", "true").json(path)


def read_findings(spark, path):
    """Findings written as JSON lines."""
    return spark.read.schema(FINDINGS).json(path)


def read_findings_table(spark, path):
    return spark.read.schema(FINDINGS).parquet(path)


def write_findings_json(findings, path):
    findings.write.mode("overwrite").json(path)


def write_findings_table(findings, path):
    """A table partitioned by level, for queries that need only some levels."""
    findings.write.mode("overwrite").partitionBy("risk_level").parquet(path)
