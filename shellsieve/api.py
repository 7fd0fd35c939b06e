"""Analysing a path, as one call."""

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from shellsieve.catalog import builtin_rules
from shellsieve.operators.findings import counts_by_level, totals
from shellsieve.operators.scan import scan
from shellsieve.plans.report import report, write_report
from shellsieve.sources.checkpoints import Scratch
from shellsieve.sources.files import read_scripts, unreadable_scripts
from shellsieve.sources.rules import configured_rules


@dataclass
class Analysis:
    scripts: DataFrame
    findings: DataFrame
    started: datetime

    def totals(self):
        return totals(self.scripts, counts_by_level(self.findings))

    def unreadable(self):
        """Paths of the scripts that count but could not be read."""
        return unreadable_scripts(self.scripts)

    def report(self, form="text", **options):
        return report(form, self.scripts, self.findings, self.started, **options)

    def write_report(self, path, form="text", **options):
        scratch = Scratch(self.findings.sparkSession)
        write_report(self.report(form, store=scratch.stored, **options), path)
        scratch.drop()


def analyze(spark, path, recursive=False, min_risk=None, custom_rules_path=None, ignored=()):
    """Scripts below ``path`` and their findings of ``min_risk`` or above."""
    started = datetime.now()
    rules = configured_rules(spark, builtin_rules(), custom_rules_path, ignored)
    scripts = read_scripts(spark, path, recursive)
    return Analysis(scripts, scan(scripts, rules, min_risk), started)
