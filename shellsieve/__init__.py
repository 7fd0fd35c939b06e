"""Security scanning of scripts and other text on Spark."""

from shellsieve.api import Analysis, analyze
from shellsieve.catalog import add_rules, builtin_rules, ignore_rules, regex_rule
from shellsieve.operators.counts import level_totals, rule_counts, totals_by_rule
from shellsieve.operators.findings import at_least, counts_by, counts_by_level, numbered, totals
from shellsieve.operators.scan import scan
from shellsieve.plans.report import report, write_report
from shellsieve.sources.files import read_scripts, table_scripts

__all__ = [
    "Analysis", "add_rules", "analyze", "at_least", "builtin_rules", "counts_by",
    "counts_by_level", "ignore_rules", "level_totals", "numbered", "read_scripts", "regex_rule", "report",
    "rule_counts", "scan", "table_scripts", "totals", "totals_by_rule", "write_report",
]
