"""Custom and ignored rules from files."""

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shellsieve.catalog import (
    add_rules, check_fields, check_pattern, ignore_rules, rules_from_rows,
)
from shellsieve.schemas import RULES


def read_rules(spark, path):
    """Rules of JSON-lines files in the ``RULES`` schema, checked.

    Rules are configuration: they are read to the driver and compiled into the plan.
    """
    rows = spark.read.schema(RULES).json(path).orderBy("phase", "rule_no", "rule_id")
    rules = rules_from_rows(rows.collect())
    check_rules(spark, rules)
    return rules


def check_rules(spark, rules):
    """Raise ValueError for a rule that does not compile or matches the empty text."""
    for rule in rules:
        check_fields(rule)
        check_pattern(rule)
    patterns = [rule for rule in rules if rule.kind == "regex"]
    try:
        hits = _match_empty(spark, patterns)
    except PySparkException:
        # Some pattern does not compile; one by one they tell which.
        for rule in patterns:
            try:
                _match_empty(spark, [rule])
            except PySparkException as error:
                raise ValueError(f"{rule.rule_id}: pattern does not compile: {error}") from None
        raise
    for rule, hit in zip(patterns, hits, strict=True):
        if hit:
            raise ValueError(f"{rule.rule_id}: pattern matches the empty text")


def _match_empty(spark, rules):
    tests = [F.lit("").rlike(rule.java_pattern) for rule in rules]
    return spark.range(1).select(F.array(*tests)).first()[0] if tests else []


def configured_rules(spark, rules, custom_rules_path=None, ignored=()):
    """``rules`` plus the custom ones minus the ignored ones."""
    if custom_rules_path:
        rules = add_rules(rules, read_rules(spark, custom_rules_path))
    return ignore_rules(rules, ignored)
