"""Queries over the given tables, one per operator of the engine."""

from datetime import datetime
from functools import partial

from pyspark.sql import functions as F

from shellsieve.catalog import (
    active_rules, add_rules, builtin_rules, ignore_rules, regex_rule, rules_table,
)
from shellsieve.functions import levels, text
from shellsieve.operators.commands import commands
from shellsieve.operators import findings
from shellsieve.operators.counts import level_totals, rule_counts, totals_by_rule
from shellsieve.operators.findings import (
    at_least, by_level_text, by_severity, counts_by, numbered,
)
from shellsieve.operators.processes import calls_per_tree
from shellsieve.operators.rule_index import scan_rule_table
from shellsieve.operators.scan import matches, scan
from shellsieve.operators.tracelog import parse_trace, trace_calls, trace_summary
from shellsieve.plans.report import report, write_report
from shellsieve.plans.sample_scripts import line_sql, nesting_sql, sample_scripts, scripts_with_paths
from shellsieve.schemas import EVENTS
from shellsieve.sources.checkpoints import shared_folder
from shellsieve.sources.files import (
    delete_files,
    is_script,
    read_scripts,
    table_scripts,
    with_readable,
    write_files,
)
from shellsieve.sources.reports import (
    read_findings_table, read_report_findings, write_findings_table,
)
from shellsieve.sources.rules import read_rules
from shellsieve.streaming.scans import (
    latest_windows, level_windows, scan_stream, write_window_updates,
)

TOKEN_RULE = regex_rule(
    "TOK01", r"""(?i)token\s*=\s*['"]([0-9a-f]{40})['"]""", "Critical",
    description="An access token is written in the text.", needs=(("token",), ("=",)),
)
IGNORED = ("SEC01", "NET01", "CMD_RM")
REPORT_TIME = datetime(2024, 1, 1, 12, 0, 0)

# Line of a trace log by event; {text} is the name of the string type.
TRACE_TEMPLATES = [
    "concat(' openat(AT_FDCWD, \"/etc/f', CAST(event_id AS {text}), '\", O_RDONLY) = 3')",
    "' execve(\"/bin/ls\", [\"ls\", \"-la\"], 0x7ffd /* 20 vars */) = 0'",
    "' connect(3, {{sa_family=AF_INET, sin_port=htons(443)}}, 16) = -1 ECONNREFUSED"
    " (Connection refused)'",
    "' stat(\"/nope\", 0x7ffe) = -1 ENOENT (No such file or directory)'",
    "' --- SIGCHLD {{si_signo=SIGCHLD, si_code=CLD_EXITED}} ---'",
    "' wait4(-1, <unfinished ...>'",
    "' <... wait4 resumed>[{{WIFEXITED(s) && WEXITSTATUS(s) == 0}}], 0, NULL) = 77'",
    "' +++ exited with 0 +++'",
]


def trace_line_sql(text_type):
    cases = " ".join(
        f"WHEN {i} THEN {template.format(text=text_type)}"
        for i, template in enumerate(TRACE_TEMPLATES)
    )
    count = len(TRACE_TEMPLATES)
    return f"concat(CAST(user_id AS {text_type}), CASE event_id % {count} {cases} END)"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _findings(spark, sf_dir, **options):
    return scan(sample_scripts(spark, sf_dir), **options)


def _matches(spark, sf_dir, rules=None, **options):
    rules = active_rules(builtin_rules() if rules is None else rules)
    return matches(sample_scripts(spark, sf_dir), rules, keep=["path"], **options)


def _regex_rules():
    return [rule for rule in builtin_rules() if rule.kind == "regex"]


def _command_rules():
    return [rule for rule in active_rules(builtin_rules()) if rule.kind == "command"]


def _without_texts(findings):
    return findings.drop("description", "recommendation")


def rule_matches(rule_id, spark, sf_dir):
    rules = [rule for rule in builtin_rules() if rule.rule_id == rule_id]
    return _matches(spark, sf_dir, rules)


def regex_findings_all(spark, sf_dir):
    return _matches(spark, sf_dir, _regex_rules())


def dangerous_commands(spark, sf_dir):
    return _matches(spark, sf_dir, _command_rules())


def command_counts(spark, sf_dir):
    counts = rule_counts(sample_scripts(spark, sf_dir), _command_rules())
    names = rules_table(spark, _command_rules()).select("rule_id", "command_name", "risk_level")
    summed = counts.groupBy("rule_id").agg(F.sum("findings").cast("long").alias("findings"))
    return summed.join(F.broadcast(names), "rule_id").drop("rule_id")


def command_args(spark, sf_dir):
    names = [rule.command_name for rule in _command_rules()]
    return commands(sample_scripts(spark, sf_dir), names).withColumn(
        "args", F.array_join("args", " ")
    )


def nested_commands(spark, sf_dir):
    """Commands of texts in which quotes, substitutions, here-documents and case arms nest."""
    events = _table(spark, sf_dir, "events").select(
        "event_id", F.expr(nesting_sql("STRING")).alias("content")
    )
    names = [rule.command_name for rule in active_rules(_command_rules())]
    return commands(events, names, "event_id").select("event_id", "command_name", "line", "column")


def findings_all(spark, sf_dir):
    return _findings(spark, sf_dir)


def findings_min_high(spark, sf_dir):
    return _without_texts(_findings(spark, sf_dir, min_risk="High"))


def findings_filtered_high(spark, sf_dir):
    return _without_texts(at_least(_findings(spark, sf_dir), "High"))


def counts_by_level(spark, sf_dir):
    return level_totals(rule_counts(sample_scripts(spark, sf_dir)))


def counts_by_level_per_script(spark, sf_dir):
    scripts = sample_scripts(spark, sf_dir).withColumnRenamed("path", "file_path")
    return level_totals(rule_counts(scripts, keep=["file_path"]), None, "file_path")


def counts_by_rule(spark, sf_dir):
    return totals_by_rule(rule_counts(sample_scripts(spark, sf_dir))).drop("risk_level")


def finding_type_levels(spark, sf_dir):
    """Counted from full findings rather than from counts per text."""
    return findings.counts_by_level(_findings(spark, sf_dir, snippet=False), "finding_type")


def _files_with_invalid_bytes(spark, sf_dir):
    broken = F.col("script_id") % 5 == 0
    return sample_scripts(spark, sf_dir).select(
        "path",
        F.when(broken, F.concat(F.unhex(F.lit("FFFE")), F.col("content").cast("binary")))
        .otherwise(F.col("content").cast("binary"))
        .alias("content"),
    )


def scan_totals(spark, sf_dir):
    scripts = with_readable(_files_with_invalid_bytes(spark, sf_dir))
    return findings.totals(scripts, level_totals(rule_counts(scripts)))


def utf8_gate(spark, sf_dir):
    scripts = with_readable(_files_with_invalid_bytes(spark, sf_dir))
    return scripts.select(
        "path", "readable", F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("chars")
    )


def classify_scripts(spark, sf_dir):
    scripts = scripts_with_paths(spark, sf_dir)
    return scripts.select(
        "script_id", "path",
        text.extension_of(F.col("path")).alias("extension"),
        text.has_extension(F.col("path"), "sh").alias("is_sh"),
        is_script(F.col("path"), F.col("content")).alias("is_script"),
    )


def _narrow_findings(spark, sf_dir):
    """What numbering needs, without texts, since numbering stores its rows."""
    return _findings(spark, sf_dir, snippet=False).select(
        "risk_level", "risk_rank", *findings.DISCOVERY
    )


def findings_ranked(spark, sf_dir):
    found = numbered(_narrow_findings(spark, sf_dir), by_severity())
    return found.select("finding_no", "risk_level", "rule_id", "file_path", "line", "column")


def findings_html_order(spark, sf_dir):
    found = numbered(_narrow_findings(spark, sf_dir), by_level_text())
    return found.select("finding_no", "risk_level", "rule_id", "file_path", "line", "column")


def finding_snippets(spark, sf_dir):
    return _findings(spark, sf_dir).select("rule_id", "file_path", "line", "column", "code_snippet")


def risk_score_band(spark, sf_dir):
    found = _findings(spark, sf_dir, snippet=False)
    band = levels.score_band(F.col("risk_level"))
    in_band = (F.col("risk_score") >= F.col("lo")) & (F.col("risk_score") < F.col("hi"))
    return (
        found.withColumn("band", band).select("rule_id", "risk_score", "band.*")
        .groupBy("rule_id", "lo", "hi")
        .agg(F.count_if(in_band).cast("long").alias("in_band"),
             F.count(F.lit(1)).cast("long").alias("findings"))
    )


def level_names(spark, sf_dir):
    level = F.col("risk_level")
    return counts_by(
        _findings(spark, sf_dir, snippet=False).select(
            "risk_level",
            levels.risk_level_name(level, "en").alias("name_en"),
            levels.risk_level_name(level, "tr").alias("name_tr"),
            levels.risk_level_code(level).alias("code"),
            levels.risk_rank(level).cast("long").alias("rank"),
        ),
        "risk_level", "name_en", "name_tr", "code", "rank",
    )


def parse_levels(spark, sf_dir):
    level = F.col("risk_level")
    spelled = (
        F.when(F.col("line") % 3 == 0, F.upper(level))
        .when(F.col("line") % 3 == 1, levels.risk_level_name(level, "tr"))
        .otherwise(F.concat(level, F.lit("?")))
    )
    found = _findings(spark, sf_dir, snippet=False).select(spelled.alias("spelled"))
    return counts_by(
        found.withColumn("parsed", levels.parse_risk_level(F.col("spelled"))), "spelled", "parsed"
    )


def text_line_stats(spark, sf_dir):
    body = F.concat("text", F.expr("repeat('\n', cast(doc_id % 4 as int))"))
    return _table(spark, sf_dir, "documents").select("doc_id", body.alias("body")).select(
        "doc_id",
        text.count_lines(F.col("body")).alias("lines"),
        F.size(text.lines_of(F.col("body"))).cast("long").alias("split_lines"),
        text.count_trailing_newlines(F.col("body")).alias("trailing_newlines"),
    )


def line_of_offset(spark, sf_dir):
    middle = F.expr("octet_length(left(text, cast(length(text) / 2 as int)))").cast("long")
    end = F.octet_length("text").cast("long") + 5
    return _table(spark, sf_dir, "documents").select(
        "doc_id",
        middle.alias("middle_offset"),
        text.get_line_number(F.col("text"), middle).alias("middle_line"),
        text.get_line_number(F.col("text"), end).alias("line_past_end"),
    )


def offset_of_line(spark, sf_dir):
    body = F.col("text")
    last = text.newline_count(body) + 1
    return _table(spark, sf_dir, "documents").select(
        "doc_id",
        text.get_line_start_offset(body, F.lit(0)).alias("line_0"),
        text.get_line_start_offset(body, F.lit(1)).alias("line_1"),
        text.get_line_start_offset(body, F.lit(2)).alias("line_2"),
        text.get_line_start_offset(body, last).alias("last_line"),
        text.get_line_start_offset(body, last + 1).alias("missing_line"),
    )


def html_escape_pages(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select(
        "page_id", text.escape_html(F.col("html")).alias("escaped")
    )


def strip_quotes_values(spark, sf_dir):
    rules = [rule for rule in builtin_rules() if rule.rule_id in ("SEC01", "SEC02", "SEC03", "SEC04")]
    value = F.col("value")
    return _matches(spark, sf_dir, rules, value=True).select(
        "rule_id", "path", "match_no", "value",
        text.strip_quotes(F.concat(F.lit(' "'), value, F.lit('"\t'))).alias("double_quoted"),
        text.strip_quotes(F.concat(F.lit("'"), value, F.lit("'"))).alias("single_quoted"),
        text.strip_quotes(F.concat(F.lit(" '"), value, F.lit('"'))).alias("unpaired"),
    )


def custom_rule_tokens(spark, sf_dir):
    return matches(_table(spark, sf_dir, "documents"), [TOKEN_RULE], "text", ["doc_id"],
                   value=True)


def tokens_by_lang_source(spark, sf_dir):
    # One row per document already, so one small shuffle is left.
    counts = rule_counts(_table(spark, sf_dir, "documents"), [TOKEN_RULE], text_col="text",
                         keep=["lang", "source"])
    return counts.groupBy("lang", "source").agg(
        F.count(F.lit(1)).cast("long").alias("documents"),
        F.sum("findings").cast("long").alias("findings"),
    )


def rule_table_scan(spark, sf_dir):
    """Every pair of neighbouring words of the benchmark as a rule, found in the documents."""
    words = _table(spark, sf_dir, "benchmark").select(
        F.expr("regexp_extract_all(text, '[A-Za-z]+', 0)").alias("words")
    ).where("size(words) > 1")
    pairs = words.select(F.explode(F.expr(
        "transform(slice(words, 1, size(words) - 1), (word, i) -> concat(word, ' ', words[i + 1]))"
    )).alias("pair")).distinct()
    caseless = F.when(F.length("pair") % 2 == 0, F.lit("(?i)")).otherwise("")
    rules = pairs.select(F.col("pair").alias("rule_id"), F.concat(caseless, "pair").alias("pattern"))
    found = scan_rule_table(_table(spark, sf_dir, "documents"), rules, "doc_id", "text")
    return found.groupBy("doc_id", "rule_id").agg(F.count("*").cast("long").alias("findings"))


def ignored_rules(spark, sf_dir):
    rules = add_rules(ignore_rules(builtin_rules(), IGNORED), [TOKEN_RULE])
    counts = rule_counts(sample_scripts(spark, sf_dir), rules)
    return totals_by_rule(counts, rules).select("rule_id", "findings")


def text_tables_counts(spark, sf_dir):
    parts = []
    for table, id_col, text_col in (
        ("documents", "doc_id", "text"), ("pages", "page_id", "html"),
        ("conversations", "conv_id", "text"), ("benchmark", "item_id", "text"),
    ):
        texts = table_scripts(_table(spark, sf_dir, table), id_col, text_col)
        rules = [*_regex_rules(), TOKEN_RULE]
        counted = level_totals(rule_counts(texts, rules), rules)
        parts.append(
            findings.totals(texts, counted).select(F.lit(table).alias("table_name"), "*")
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _report(form, spark, sf_dir, **options):
    scripts = sample_scripts(spark, sf_dir)
    return report(form, scripts, scan(scripts), REPORT_TIME, REPORT_TIME, **options)


def report_text(spark, sf_dir):
    return _report("text", spark, sf_dir)


def report_html(spark, sf_dir):
    return _report("html", spark, sf_dir, language="tr", legacy_html_order=True)


def report_json(spark, sf_dir):
    return _report("json", spark, sf_dir)


def report_json_roundtrip(spark, sf_dir):
    folder = shared_folder(spark, "report")
    write_report(_report("json", spark, sf_dir), folder)
    return read_report_findings(spark, folder)


def _script_files(spark, sf_dir, name):
    """The sample scripts as rows (script_id, name, value) of files."""
    return sample_scripts(spark, sf_dir).select(
        "script_id", name.alias("name"), F.concat(F.lit("#!/bin/bash\n"), "content", F.lit("\n")).alias("value")
    )


def file_source_scan(spark, sf_dir):
    """The sample scripts as files of a tree, found by their first line."""
    folder = shared_folder(spark, "scripts")
    name = F.format_string("script_id=%d/part-0.txt", "script_id")
    write_files(_script_files(spark, sf_dir, name), folder)
    scripts = read_scripts(spark, folder, recursive=True)
    script_id = F.regexp_extract("file_path", "script_id=([0-9]+)/", 1).cast("long")
    return scan(scripts).select(
        script_id.alias("script_id"), "rule_id", "line", "column", "code_snippet"
    )


def scan_lost_files(spark, sf_dir):
    """The sample scripts as files, of which each with a number ending in 3 is lost after the listing."""
    folder = shared_folder(spark, "scripts")
    is_lost = F.col("script_id") % 10 == 3
    file = F.when(is_lost, "job.sh").otherwise("part-0.txt")
    files = _script_files(spark, sf_dir, F.format_string("script_id=%d/%s", "script_id", file))
    write_files(files, folder)
    scripts = read_scripts(spark, folder, recursive=True)
    delete_files(files.where(is_lost), folder)
    found = scan(scripts).groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("findings"))
    return scripts.join(found, "path", "left").select(
        F.regexp_extract("path", "script_id=([0-9]+)/", 1).cast("long").alias("script_id"),
        "readable", F.coalesce("findings", F.lit(0)).cast("long").alias("findings"),
    )


def file_source_direct(spark, sf_dir):
    """The sample scripts as files of one folder, next to a folder that is not looked into."""
    folder = shared_folder(spark, "scripts")
    files = _script_files(spark, sf_dir, F.format_string("part-%d.txt", "script_id"))
    for place in (folder, f"{folder}/nested"):
        write_files(files, place)
    scripts = read_scripts(spark, f"{folder}/./nested/..//")
    return scan(scripts).select("rule_id", "line", "column", "code_snippet")


def findings_partitioned(spark, sf_dir):
    """Findings as a table partitioned by level, of which one level is read back."""
    folder = shared_folder(spark, "table")
    write_findings_table(_without_texts(_findings(spark, sf_dir)), folder)
    return read_findings_table(spark, folder).where(F.col("risk_level") == "Critical").select(
        "risk_level", "rule_id", "file_path", "line", "column", "code_snippet"
    )


def custom_rules_from_file(spark, sf_dir):
    """Rules written as JSON lines, read back, checked and applied to the documents."""
    folder = shared_folder(spark, "rules")
    rules_table(spark, [TOKEN_RULE]).write.json(folder)
    counts = rule_counts(_table(spark, sf_dir, "documents"), read_rules(spark, folder),
                         text_col="text", keep=["doc_id"])
    return counts.select("doc_id", "rule_id", "findings")


def _event_stream(spark, sf_dir):
    events = (
        spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("event/"), F.col("event_id").cast("string")).alias("path"),
        F.expr(line_sql("STRING")).alias("content"),
    )


def stream_scan(spark, sf_dir):
    folder = shared_folder(spark, "stream")
    scan_stream(_event_stream(spark, sf_dir), f"{folder}/out", f"{folder}/state").awaitTermination()
    return _without_texts(spark.read.parquet(f"{folder}/out"))


def stream_level_windows(spark, sf_dir):
    folder = shared_folder(spark, "stream")
    windows = level_windows(_event_stream(spark, sf_dir), "ts")
    write_window_updates(windows, f"{folder}/out", f"{folder}/state").awaitTermination()
    return latest_windows(spark, f"{folder}/out").select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("window_end").cast("timestamp_ntz").alias("window_end"),
        "risk_level", "findings",
    )


def _trace(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return events.select("event_id", F.expr(trace_line_sql("STRING")).alias("line"))


def trace_log_events(spark, sf_dir):
    return parse_trace(_trace(spark, sf_dir), keep=["event_id"])


def trace_log_summary(spark, sf_dir):
    return trace_summary(parse_trace(_trace(spark, sf_dir)))


def trace_whole_calls(spark, sf_dir):
    return trace_calls(parse_trace(_trace(spark, sf_dir), keep=["event_id"]), "event_id")


# Line of a trace of processes that start each other; pids come again and again.
PROCESS_TEMPLATES = [
    "concat(' clone(child_stack=NULL, flags=SIGCHLD) = ', CAST(1000 + event_id * 17 % 97 AS {text}))",
    "concat(' openat(AT_FDCWD, \"/f\", O_RDONLY) = ', CAST(event_id % 9 AS {text}))",
    "' connect(3, {sa_family=AF_INET}, 16) = -1 ECONNREFUSED (Connection refused)'",
    "' execve(\"/bin/ls\", [\"ls\"], 0x7ffd /* 20 vars */) = 0'",
    "' fork() = -1 EAGAIN (Resource temporarily unavailable)'",
    "' stat(\"/nope\", 0x7ffe) = -1 ENOENT (No such file or directory)'",
]


def process_line_sql(text_type):
    cases = " ".join(
        f"WHEN {i} THEN {template.replace('{text}', text_type)}" for i, template in enumerate(PROCESS_TEMPLATES)
    )
    pid = f"CAST(1000 + (event_id * 31 + user_id) % 97 AS {text_type})"
    return f"concat({pid}, CASE event_id % {len(PROCESS_TEMPLATES)} {cases} END)"


def trace_process_trees(spark, sf_dir):
    """Calls of every tree of processes, counted for the one that all others come from."""
    events = _table(spark, sf_dir, "events").select("event_id", F.expr(process_line_sql("STRING")).alias("line"))
    return calls_per_tree(trace_calls(parse_trace(events, keep=["event_id"]), "event_id"))


def all_queries():
    found = {
        f"rule_{rule.rule_id.lower()}": partial(rule_matches, rule.rule_id)
        for rule in _regex_rules()
    }
    for query in (
        regex_findings_all, dangerous_commands, command_counts, command_args, findings_all,
        nested_commands, rule_table_scan, findings_min_high, findings_filtered_high, counts_by_rule, scan_totals, utf8_gate,
        classify_scripts, findings_ranked, findings_html_order, finding_snippets, risk_score_band,
        level_names, parse_levels, text_line_stats, line_of_offset, offset_of_line,
        html_escape_pages, strip_quotes_values, custom_rule_tokens, tokens_by_lang_source,
        text_tables_counts, report_text, report_html, report_json, report_json_roundtrip,
        counts_by_level, counts_by_level_per_script, finding_type_levels,
        file_source_scan, scan_lost_files, file_source_direct, findings_partitioned, custom_rules_from_file,
        stream_scan, stream_level_windows, trace_log_events, trace_log_summary,
        trace_whole_calls, trace_process_trees,
    ):
        found[query.__name__] = query
    found["ignore_rules_antijoin"] = ignored_rules
    return found
