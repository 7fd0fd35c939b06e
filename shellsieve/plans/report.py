"""Reports as ordered tables of text, one row per finding.

A report is a table ``(section, item, report_line)``. Its rows are made in parallel and
``write_report`` sorts them by range, so the part files read one after the other are the
document, however many findings there are.
"""

from datetime import datetime

from pyspark.sql import functions as F

from shellsieve.functions.levels import risk_level_code, risk_level_name
from shellsieve.functions.text import escape_html
from shellsieve.operators.findings import (
    by_discovery, by_level_text, by_severity, counts_by_level, numbered, totals,
)
from shellsieve.schemas import REPORT_FINDING
from shellsieve.sources.checkpoints import stored

FORMATS = ("text", "json", "html")
TIME_FORMAT = "%Y-%m-%d %H:%M:%S"

_STYLE = (
    "body{font:16px sans-serif;margin:2em auto;max-width:70em}"
    ".card{border:1px solid #ccc;border-left-width:6px;margin:1em 0;padding:1em}"
    ".critical{border-left-color:#b00020}.high{border-left-color:#e65100}"
    ".medium{border-left-color:#f9a825}.low{border-left-color:#2e7d32}"
    "pre{background:#f4f4f4;overflow-x:auto;padding:.5em}"
)


def report(form, scripts, findings, started=None, ended=None, language="en",
           legacy_html_order=False, store=stored):
    """Report of ``findings`` in ``form``: text (default of the tools), json or html.

    ``legacy_html_order`` sorts an HTML report by level name in descending text order
    instead of by severity. ``store`` as in ``numbered``: the report reads what it stored
    until it is written.
    """
    if form not in FORMATS:
        raise ValueError(f"unknown report format {form!r}, expected one of {FORMATS}")
    started = started or datetime.now()
    order = by_level_text() if form == "html" and legacy_html_order else by_severity()
    # Numbering stores the findings, so the scan is over when the end is taken.
    if form == "json":
        listed = numbered(findings, by_discovery(), "item", store=store)
    else:
        listed = numbered(findings, order, store=store)
    ended = ended or datetime.now()
    clock = {
        "start_time": started.strftime(TIME_FORMAT),
        "end_time": ended.strftime(TIME_FORMAT),
        "duration_seconds": (ended - started).total_seconds(),
    }
    if form == "json":
        return _json_report(scripts, listed, clock, store)
    summary = totals(scripts, counts_by_level(listed))
    level = risk_level_name(F.col("risk_level"), language)
    if form == "html":
        return _rows(0, _html_head(summary, clock, language)).unionAll(
            listed.select(F.lit(1), "finding_no", _html_card(level))
        ).unionAll(_rows(2, summary.select(F.lit("</body>\n</html>").alias("tail"))))
    return _rows(0, _text_head(summary, clock, language)).unionAll(
        listed.select(F.lit(1), "finding_no", _text_block(level))
    )


def write_report(report_rows, path):
    """Write a report as text; the part files in name order are the document."""
    report_rows.orderBy("section", "item").select("report_line").write.mode("overwrite").text(path)


def _rows(section, lines):
    return lines.select(
        F.lit(section).alias("section"),
        F.lit(0).cast("long").alias("item"),
        F.col(lines.columns[0]).alias("report_line"),
    )


def _text_head(summary, clock, language):
    def level(name):
        return F.concat(F.lit("  "), risk_level_name(F.lit(name), language), F.lit(": "),
                        F.col(name.lower()).cast("string"))

    return summary.select(F.concat_ws(
        "\n",
        F.lit("Script security report"),
        F.lit(f"Started: {clock['start_time']}"),
        F.lit(f"Ended: {clock['end_time']}"),
        F.lit(f"Seconds: {clock['duration_seconds']:.2f}"),
        F.concat(F.lit("Scripts: "), F.col("total_scripts").cast("string")),
        F.concat(F.lit("Findings: "), F.col("total_findings").cast("string")),
        F.lit("By level:"),
        *[level(name) for name in ("Critical", "High", "Medium", "Low")],
    ).alias("head"))


def _score():
    # Half-even, as the reports' "one decimal" is; format_string alone rounds half up.
    return F.format_string("%.1f", F.bround(F.col("risk_score").cast("double"), 1))


def _text_block(level):
    return F.concat(
        F.lit("Finding "), F.col("finding_no").cast("string"),
        F.lit("\n  File: "), F.col("file_path"),
        F.lit("\n  Line: "), F.col("line").cast("string"),
        F.lit("\n  Level: "), level,
        F.lit("\n  Score: "), _score(),
        F.lit("\n  Problem: "), F.col("description"),
        F.when(F.col("recommendation").isNotNull(),
               F.concat(F.lit("\n  Advice: "), F.col("recommendation"))).otherwise(F.lit("")),
        F.lit("\n  Code:\n"), F.col("code_snippet"),
    )


def _html_head(summary, clock, language):
    def badge(name):
        return F.concat(F.lit(f'<li class="{name.lower()}">'),
                        risk_level_name(F.lit(name), language), F.lit(": "),
                        F.col(name.lower()).cast("string"), F.lit("</li>"))

    return summary.select(F.concat_ws(
        "\n",
        F.lit(f'<!DOCTYPE html>\n<html lang="{language}">\n<head><meta charset="utf-8">'),
        F.lit(f"<title>Script security report</title><style>{_STYLE}</style></head>\n<body>"),
        F.lit("<h1>Script security report</h1>"),
        F.lit(f"<p>{clock['start_time']} to {clock['end_time']},"
              f" {clock['duration_seconds']:.2f} seconds</p>"),
        F.concat(F.lit("<p>Scripts: "), F.col("total_scripts").cast("string"),
                 F.lit(", findings: "), F.col("total_findings").cast("string"), F.lit("</p>")),
        F.concat(F.lit("<ul>"), *[badge(n) for n in ("Critical", "High", "Medium", "Low")],
                 F.lit("</ul>")),
    ).alias("head"))


def _html_card(level):
    def safe(name):
        return escape_html(F.col(name))

    return F.concat(
        F.lit('<div class="card '), risk_level_code(F.col("risk_level")), F.lit('">'),
        F.lit("<h2>"), F.col("finding_no").cast("string"), F.lit(". "), level,
        F.lit(" "), _score(), F.lit("</h2>"),
        F.lit("<p>"), safe("file_path"), F.lit(":"), F.col("line").cast("string"), F.lit("</p>"),
        F.lit("<p>"), safe("description"), F.lit("</p>"),
        F.when(F.col("recommendation").isNotNull(),
               F.concat(F.lit("<p>"), safe("recommendation"), F.lit("</p>"))).otherwise(F.lit("")),
        F.lit("<pre>"), safe("code_snippet"), F.lit("</pre></div>"),
    )


def _json_report(scripts, listed, clock, store):
    """One JSON document with one file and one finding per line."""
    keep_nulls = {"ignoreNullFields": "false"}
    by_path = [F.col("path").asc()]
    files = numbered(scripts.select("path"), by_path, "item", costly=False, store=store)
    counts = counts_by_level(listed)

    def element(value):
        first = F.col("item") == 1
        return F.concat(F.when(first, "    ").otherwise("  , "), value)

    path = F.to_json(F.array("path"))
    file_rows = files.select(
        F.lit(1), "item", element(F.substring(path, F.lit(2), F.length(path) - 2))
    )
    finding = F.to_json(F.struct(*REPORT_FINDING.fieldNames()), keep_nulls)
    finding_rows = listed.select(F.lit(3), "item", element(finding))
    middle = scripts.agg(F.count(F.lit(1)).alias("n")).select(F.concat(
        F.lit('  ],\n  "total_scripts": '), F.col("n").cast("string"), F.lit(',\n  "findings": [')
    ).alias("middle"))
    level_struct = F.to_json(F.struct("critical", "high", "medium", "low"))
    tail = counts.select(F.concat(
        F.lit('  ],\n  "total_findings": '), F.col("total_findings").cast("string"),
        F.lit(',\n  "findings_by_risk_level": '), level_struct,
        F.lit(f',\n  "start_time": "{clock["start_time"]}",\n  "end_time": "{clock["end_time"]}"'
              f',\n  "duration_seconds": {clock["duration_seconds"]}\n}}'),
    ).alias("tail"))
    head = counts.select(F.lit('{\n  "analyzed_files": [').alias("head"))
    return (
        _rows(0, head).unionAll(file_rows).unionAll(_rows(2, middle))
        .unionAll(finding_rows).unionAll(_rows(4, tail))
    )
