"""Counts of matches without their positions.

A count per text and rule comes out of the text's own row, so what is shuffled is one small
row per text and rule, however many matches there are.
"""

from pyspark.sql import functions as F

from shellsieve.catalog import active_rules, builtin_rules, rules_table
from shellsieve.functions.positions import MARK, let
from shellsieve.operators.scan import (
    HITS, TEXT, clean_text, command_names, if_commands_possible, if_possible, marked_by_rule,
    prepared,
)
from shellsieve.schemas import RISK_LEVELS


def rule_counts(texts, rules=None, min_risk=None, text_col="content", keep=()):
    """One row per text and rule with matches: ``keep`` columns, rule_id, findings."""
    keep = list(keep)
    active = active_rules(builtin_rules() if rules is None else rules, min_risk)
    return (
        prepared(texts, active, text_col, keep)
        .select(*keep, _counts(active).alias(HITS))
        .select(*keep, F.explode_outer(HITS).alias(HITS))
        .where(F.col(HITS).isNotNull())
        .select(*keep, f"{HITS}.*")
    )


def totals_by_rule(counts, rules=None, *keys):
    """Findings per rule (and ``keys``) with the rule's type and level."""
    table = rules_table(counts.sparkSession, builtin_rules() if rules is None else rules)
    summed = counts.groupBy(*keys, "rule_id").agg(F.sum("findings").cast("long").alias("findings"))
    return summed.join(
        F.broadcast(table.select("rule_id", "finding_type", "risk_level")), "rule_id"
    )


def level_totals(counts, rules=None, *keys):
    """Total and per level, zero where nothing was found; one row, or one per ``keys``."""
    table = rules_table(counts.sparkSession, builtin_rules() if rules is None else rules)
    described = counts.join(F.broadcast(table.select("rule_id", "risk_level")), "rule_id")

    def summed(condition, name):
        counted = F.sum(F.when(condition, F.col("findings")).otherwise(0))
        return F.coalesce(counted, F.lit(0)).cast("long").alias(name)

    columns = [summed(F.lit(True), "total_findings")] + [
        summed(F.col("risk_level") == level, level.lower()) for level in reversed(RISK_LEVELS)
    ]
    return described.groupBy(*keys).agg(*columns) if keys else described.agg(*columns)


def _counts(rules):
    text = F.col(TEXT)
    entries = [_regex_count(text, rule) for rule in rules if rule.kind == "regex"]
    counted = F.array(*entries) if entries else F.array().cast(_COUNTS)
    commands = {rule.command_name: rule.rule_id for rule in rules if rule.kind == "command"}
    if commands:
        names = list(commands)
        by_name = let(
            command_names(names),
            lambda found: F.array(*[
                _entry(rule_id, F.size(F.filter(found, lambda name: name == F.lit(command))))
                for command, rule_id in commands.items()
            ]),
        )
        held = F.coalesce(if_commands_possible(by_name), F.array().cast(_COUNTS))
        counted = F.concat(held, counted)
    return F.filter(counted, lambda entry: entry["findings"] > 0)


_COUNTS = "array<struct<rule_id:string,findings:bigint>>"


def _regex_count(text, rule):
    clean = clean_text(text)
    if rule.by_line:
        longer = F.octet_length(marked_by_rule(clean, rule)) - F.octet_length(clean)
        counted = (longer / len(MARK.encode())).cast("int")
    else:
        counted = F.regexp_count(clean, F.lit(rule.java_pattern))
    return _entry(rule.rule_id, if_possible(rule, counted))


def _entry(rule_id, number):
    return F.struct(F.lit(rule_id).alias("rule_id"), number.cast("long").alias("findings"))
