"""The registered queries once more, as SQL over the same tables.

Written independently of the column expressions: RE2 does the matching, positions come
from the text before a match, commands from the form of the sample lines.
"""

from shellsieve.catalog import TEXT_PATTERNS, active_rules, builtin_rules
from shellsieve.plans.queries import IGNORED, TOKEN_RULE, process_line_sql, trace_line_sql
from shellsieve.plans.report import _STYLE
from shellsieve.plans.sample_scripts import EVENTS_PER_SCRIPT, line_sql, nesting_sql

_SPACE = (
    r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
_MARK = "chr(64976)"

SCRIPTS = f"""scripts AS (
  SELECT script_id, concat('jobs/', script_id, '.sh') AS path, content FROM (
    SELECT event_id // {EVENTS_PER_SCRIPT} AS script_id,
           string_agg({line_sql("VARCHAR")}, chr(10) ORDER BY user_id, event_id) AS content
    FROM events GROUP BY 1)
)"""
EVENT_SCRIPTS = f"""scripts AS (
  SELECT event_id AS script_id, concat('event/', event_id) AS path,
         {line_sql("VARCHAR")} AS content, ts
  FROM events
)"""


def literal(text):
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def re2(pattern):
    return (
        pattern.replace(r"[^\s]", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
        .replace(".*", r"[^\n]*")
    )


def _regex_hits(patterns, text="content", source="scripts", keys="script_id, path, content"):
    branches = [
        f"SELECT {keys}, {literal(rule_id)} AS rule_id, string_split(regexp_replace({text},"
        f" {literal(re2(pattern))}, concat({_MARK}, '\\0'), 'g'), {_MARK}) AS pieces FROM {source}"
        for rule_id, pattern in patterns
    ]
    return f"""regex_hits AS (
  SELECT {keys}, rule_id, i AS match_no,
         array_to_string(pieces[1:i], '') AS prefix
  FROM ({" UNION ALL ".join(branches)}) AS marked, unnest(range(1, len(pieces))) AS t(i)
), regex_matches AS (
  SELECT {keys}, rule_id, match_no,
         (1 + length(prefix) - length(replace(prefix, chr(10), '')))::BIGINT AS line,
         (1 + length(list_extract(string_split(prefix, chr(10)), -1)))::BIGINT AS "column"
  FROM regex_hits
)"""


_NAMES = "eval|source|exec|sudo|chmod|curl|wget|rm|base64"
COMMANDS = rf"""lines AS (
  SELECT script_id, path, content, i AS line, line_list[i] AS text
  FROM (SELECT *, string_split(content, chr(10)) AS line_list FROM scripts) AS cut,
       unnest(range(1, len(line_list) + 1)) AS t(i)
), found AS (
  SELECT *, regexp_extract(text, '^(|.*(?:\| |; ))({_NAMES})(?: |$)', 1) AS before,
         regexp_extract(text, '^(?:|.*(?:\| |; ))({_NAMES})(?: |$)', 1) AS command_name
  FROM lines
), command_matches AS (
  SELECT script_id, path, content, concat('CMD_', upper(command_name)) AS rule_id,
         row_number() OVER (PARTITION BY path ORDER BY line) AS match_no,
         line::BIGINT AS line, (strlen(before) + 1)::BIGINT AS "column", command_name,
         substr(text, length(before) + length(command_name) + 1) AS rest
  FROM found WHERE command_name <> ''
)"""
_MATCH_COLUMNS = 'script_id, path, content, rule_id, match_no, line, "column"'

PATTERNS = [(rule_id, pattern) for rule_id, _, _, pattern in TEXT_PATTERNS]


# Levels of the built-in rules, said once more apart from the catalogue.
_LEVELS = {
    "Critical": "SEC01 SEC02 SEC03 SEC04 INJ01 FIL01",
    "High": "CMD_EVAL CMD_EXEC SEC05 INJ02 INJ03 FIL02 FIL03 NET01 NET02",
    "Medium": "CMD_SOURCE CMD_SUDO CMD_CHMOD CMD_CURL CMD_WGET CMD_RM NET03",
    "Low": "CMD_REDIRECT CMD_BASE64",
}
_LEVEL_OF = {rule_id: level for level, ids in _LEVELS.items() for rule_id in ids.split()}
_RANK_OF = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1}
_PHASE_OF = {"CMD": 0, "SEC": 1, "INJ": 2, "FIL": 3, "NET": 4}


def _rules():
    rows = ",\n  ".join(
        "(" + ", ".join((
            literal(rule.rule_id), literal(rule.finding_type), literal(_LEVEL_OF[rule.rule_id]),
            str(_RANK_OF[_LEVEL_OF[rule.rule_id]]), literal(rule.description),
            literal(rule.recommendation), str(_PHASE_OF[rule.rule_id[:3]]),
            "0" if rule.rule_id.startswith("CMD") else rule.rule_id[3:].lstrip("0"),
        )) + ")"
        for rule in active_rules(builtin_rules())
    )
    return f"""rules(rule_id, finding_type, risk_level, risk_rank, description, recommendation,
  phase, rule_no) AS (VALUES
  {rows}
), bands(risk_level, lo, hi) AS (VALUES
  ('Critical', 9.0::DOUBLE, 10.0::DOUBLE), ('High', 7.0::DOUBLE, 9.0::DOUBLE),
  ('Medium', 4.0::DOUBLE, 7.0::DOUBLE), ('Low', 1.0::DOUBLE, 4.0::DOUBLE)
)"""


FINDINGS = rf"""matches AS (
  SELECT {_MATCH_COLUMNS} FROM command_matches UNION ALL
  SELECT {_MATCH_COLUMNS} FROM regex_matches
), with_lines AS (
  SELECT *, CASE WHEN content = '' THEN [] ELSE
    string_split_regex(regexp_replace(content, '\r?\n$', ''), '\r?\n') END AS l
  FROM matches
), findings AS (
  SELECT finding_type, risk_level, path AS file_path, line, "column",
         list_aggregate([
           CASE WHEN line > 1 THEN l[line - 1] END, l[line], l[line + 1], l[line + 2]
         ], 'string_agg', chr(10)) AS code_snippet,
         description, recommendation,
         (lo + ('0x' || substr(md5(concat_ws('|', path, line, "column", rule_id)), 1, 5))::BIGINT
           / 1048576.0::DOUBLE * (hi - lo))::FLOAT AS risk_score,
         rule_id, risk_rank::INTEGER AS risk_rank, phase::INTEGER AS phase,
         rule_no::INTEGER AS rule_no
  FROM with_lines JOIN rules USING (rule_id) JOIN bands USING (risk_level)
)"""
_ALL = f"{SCRIPTS}, {_regex_hits(PATTERNS)}, {COMMANDS}, {_rules()}, {FINDINGS}"
_COUNTS = """count(*)::BIGINT AS total_findings,
  count(*) FILTER (risk_level = 'Critical')::BIGINT AS critical,
  count(*) FILTER (risk_level = 'High')::BIGINT AS high,
  count(*) FILTER (risk_level = 'Medium')::BIGINT AS medium,
  count(*) FILTER (risk_level = 'Low')::BIGINT AS low"""
_TURKISH = (
    "CASE risk_level WHEN 'Critical' THEN 'Kritik' WHEN 'High' THEN 'Yüksek'"
    " WHEN 'Medium' THEN 'Orta' ELSE 'Düşük' END"
)
_DISCOVERY = 'file_path, phase, rule_no, line, "column"'
_NO_TEXTS = "* EXCLUDE (description, recommendation)"
_DOC_BODY = "concat(text, repeat(chr(10), (doc_id % 4)::INT))"
_DOC_BREAKS = "(strlen(text) - strlen(replace(text, chr(10), '')))"


def _with(ctes, select):
    return f"WITH {ctes}\n{select}"


def _line_start(line):
    return (
        f"CASE WHEN {line} = 1 THEN 0 WHEN {line} > 1 AND {_DOC_BREAKS} >= {line} - 1 THEN"
        f" strlen(array_to_string(string_split(text, chr(10))[1:({line} - 1)], chr(10))) + 1"
        " END::BIGINT"
    )


def _numbered(order):
    return _with(_ALL, f"""SELECT row_number() OVER (ORDER BY {order})::BIGINT AS finding_no,
  risk_level, rule_id, file_path, line, "column" FROM findings""")


def _text_report():
    return _with(_ALL, f"""SELECT 0::INTEGER AS section, 0::BIGINT AS item, concat(
    'Script security report', chr(10), 'Started: 2024-01-01 12:00:00', chr(10),
    'Ended: 2024-01-01 12:00:00', chr(10), 'Seconds: 0.00', chr(10),
    'Scripts: ', (SELECT count(*) FROM scripts), chr(10), 'Findings: ', total_findings, chr(10),
    'By level:', chr(10), '  Critical: ', critical, chr(10), '  High: ', high, chr(10),
    '  Medium: ', medium, chr(10), '  Low: ', low) AS report_line
  FROM (SELECT {_COUNTS} FROM findings)
UNION ALL SELECT 1, n, concat('Finding ', n, chr(10), '  File: ', file_path, chr(10),
    '  Line: ', line, chr(10), '  Level: ', risk_level, chr(10), '  Score: ',
    printf('%.1f', risk_score::DOUBLE), chr(10), '  Problem: ', description, chr(10),
    '  Advice: ', recommendation, chr(10), '  Code:', chr(10), code_snippet)
  FROM (SELECT *, row_number() OVER (ORDER BY risk_rank DESC, {_DISCOVERY}) AS n FROM findings)""")


def _escaped(name):
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"),
                      ("'", "&#39;")):
        name = f"replace({name}, {literal(raw)}, {literal(safe)})"
    return name


def _html_report():
    return _with(_ALL, f"""SELECT 0::INTEGER AS section, 0::BIGINT AS item, concat(
    '<!DOCTYPE html>', chr(10), '<html lang="tr">', chr(10), '<head><meta charset="utf-8">',
    chr(10), {literal('<title>Script security report</title><style>' + _STYLE)},
    '</style></head>', chr(10), '<body>', chr(10), '<h1>Script security report</h1>', chr(10),
    '<p>2024-01-01 12:00:00 to 2024-01-01 12:00:00, 0.00 seconds</p>', chr(10),
    '<p>Scripts: ', (SELECT count(*) FROM scripts), ', findings: ', total_findings, '</p>',
    chr(10), '<ul><li class="critical">Kritik: ', critical, '</li><li class="high">Yüksek: ', high,
    '</li><li class="medium">Orta: ', medium, '</li><li class="low">Düşük: ', low, '</li></ul>'
    ) AS report_line
  FROM (SELECT {_COUNTS} FROM findings)
UNION ALL SELECT 1, n, concat('<div class="card ', lower(risk_level), '"><h2>', n, '. ',
    {_TURKISH}, ' ', printf('%.1f', risk_score::DOUBLE), '</h2><p>', {_escaped("file_path")}, ':',
    line, '</p><p>', {_escaped("description")}, '</p><p>', {_escaped("recommendation")},
    '</p><pre>', {_escaped("code_snippet")}, '</pre></div>')
  FROM (SELECT *, row_number() OVER (ORDER BY risk_level DESC, {_DISCOVERY}) AS n FROM findings)
UNION ALL SELECT 2, 0, concat('</body>', chr(10), '</html>')""")


def _json_report():
    """The lines of the document, its parts numbered as they follow one another."""
    # The score is put in as text, since to_json would widen it.
    finding = """replace(to_json({'finding_type': finding_type, 'risk_level': risk_level,
    'file_path': file_path, 'line': line, 'column': "column", 'code_snippet': code_snippet,
    'description': description, 'recommendation': recommendation, 'risk_score': 0})::VARCHAR,
    '"risk_score":0}', concat('"risk_score":', risk_score::VARCHAR, chr(125)))"""
    first = "CASE WHEN n = 1 THEN '    ' ELSE '  , ' END"
    quoted = "chr(10), '  \"{}\": '"
    return _with(_ALL, f"""SELECT 0::INTEGER AS section, 0::BIGINT AS item,
  concat(chr(123), chr(10), '  "analyzed_files": [') AS report_line
UNION ALL SELECT 1, n, concat({first}, to_json(path))
  FROM (SELECT path, row_number() OVER (ORDER BY path) AS n FROM scripts)
UNION ALL SELECT 2, 0, concat('  ],', {quoted.format("total_scripts")},
  (SELECT count(*) FROM scripts), ',', {quoted.format("findings")}, '[')
UNION ALL SELECT 3, n, concat({first}, {finding})
  FROM (SELECT *, row_number() OVER (ORDER BY {_DISCOVERY}) AS n FROM findings)
UNION ALL SELECT 4, 0, concat('  ],', {quoted.format("total_findings")}, total_findings, ',',
  {quoted.format("findings_by_risk_level")},
  to_json({{'critical': critical, 'high': high, 'medium': medium, 'low': low}}), ',',
  {quoted.format("start_time")}, '"2024-01-01 12:00:00",',
  {quoted.format("end_time")}, '"2024-01-01 12:00:00",',
  {quoted.format("duration_seconds")}, '0.0', chr(10), chr(125))
  FROM (SELECT {_COUNTS} FROM findings)""")


def _text_tables():
    counted = [(level, pattern) for _, _, level, pattern in TEXT_PATTERNS]
    counted.append(("Critical", TOKEN_RULE.pattern))
    parts = []
    for table, text in (("documents", "text"), ("pages", "html"), ("conversations", "text"),
                        ("benchmark", "text")):
        counts = {
            level: " + ".join(
                f"coalesce(sum(len(regexp_extract_all({text}, {literal(re2(pattern))}))), 0)"
                for rule_level, pattern in counted if rule_level == level
            )
            for level in ("Critical", "High", "Medium")
        }
        parts.append(
            f"SELECT '{table}' AS table_name, count(*)::BIGINT AS total_scripts,"
            f" ({' + '.join(counts.values())})::BIGINT AS total_findings,"
            f" ({counts['Critical']})::BIGINT AS critical, ({counts['High']})::BIGINT AS high,"
            f" ({counts['Medium']})::BIGINT AS medium, 0::BIGINT AS low FROM {table}"
        )
    return " UNION ALL ".join(parts)


_TRACE = rf"""trace AS (
  SELECT event_id, {trace_line_sql("VARCHAR")} AS line FROM events
), cut AS (
  SELECT event_id, line, regexp_extract(line, '^(\d+) ', 1)::BIGINT AS pid,
    substr(line, strpos(line, ' ') + 1) AS body FROM trace
), parsed AS (
  SELECT event_id, pid,
    CASE WHEN body LIKE '%<unfinished ...>' THEN 'unfinished'
         WHEN body LIKE '<... %' THEN 'resumed' WHEN body LIKE '--- %' THEN 'signal'
         WHEN body LIKE '+++ %' THEN 'exit' ELSE 'call' END AS kind,
    CASE WHEN body LIKE '<... %' THEN split_part(body, ' ', 2)
         WHEN body LIKE '%(%' AND body NOT LIKE '--- %' THEN split_part(body, '(', 1) END
      AS syscall,
    CASE WHEN body LIKE '<... %' THEN regexp_extract(body, 'resumed>(.*)\) += ', 1)
         WHEN body LIKE '%<unfinished ...>' THEN regexp_extract(body, '\((.*), <unfin', 1)
         WHEN body LIKE '%(%' AND body NOT LIKE '--- %' THEN
           regexp_extract(body, '^\w+\((.*)\) += ', 1) END AS args,
    nullif(regexp_extract(body, ' = (-?\d+)( E|$)', 1), '') AS result,
    nullif(regexp_extract(body, ' = -1 (E[A-Z]+) ', 1), '') AS error
  FROM cut
), classed AS (
  SELECT event_id, pid, kind, syscall, args, result, error,
    CASE WHEN syscall IN ('execve', 'wait4') THEN 'process' WHEN syscall = 'connect' THEN 'network'
         WHEN syscall IN ('openat', 'stat') THEN 'file' END AS class
  FROM parsed
)"""


def all_oracles():
    sql = {
        f"rule_{rule_id.lower()}": _with(
            f"{SCRIPTS}, {_regex_hits([(rule_id, pattern)])}",
            'SELECT path, rule_id, match_no, line, "column" FROM regex_matches',
        )
        for rule_id, pattern in PATTERNS
    }
    matched = 'SELECT path, rule_id, match_no, line, "column" FROM '
    sql["regex_findings_all"] = _with(
        f"{SCRIPTS}, {_regex_hits(PATTERNS)}", matched + "regex_matches"
    )
    sql["dangerous_commands"] = _with(f"{SCRIPTS}, {COMMANDS}", matched + "command_matches")
    sql["command_counts"] = _with(
        f"{SCRIPTS}, {COMMANDS}, {_rules()}",
        "SELECT command_name, risk_level, count(*)::BIGINT AS findings"
        " FROM command_matches JOIN rules USING (rule_id) GROUP BY ALL",
    )
    sql["command_args"] = _with(f"{SCRIPTS}, {COMMANDS}", r"""SELECT path, command_name, line,
  "column", array_to_string([x for x in string_split(rest, ' ')
    if regexp_matches(x, '^[^"''$`\\]+$') OR regexp_matches(x, '^"[^"]*"$')], ' ') AS args
FROM command_matches""")
    sql["findings_all"] = _with(_ALL, "SELECT * FROM findings")
    high = _with(_ALL, f"SELECT {_NO_TEXTS} FROM findings WHERE risk_level IN ('High', 'Critical')")
    sql["findings_min_high"] = high
    sql["findings_filtered_high"] = high
    sql["counts_by_level"] = _with(_ALL, f"SELECT {_COUNTS} FROM findings")
    sql["counts_by_level_per_script"] = _with(
        _ALL, f"SELECT file_path, {_COUNTS} FROM findings GROUP BY file_path"
    )
    sql["counts_by_rule"] = _with(
        _ALL,
        "SELECT finding_type, rule_id, count(*)::BIGINT AS findings FROM findings GROUP BY ALL",
    )
    sql["finding_type_levels"] = _with(
        _ALL, f"SELECT finding_type, {_COUNTS} FROM findings GROUP BY finding_type"
    )
    sql["scan_totals"] = _with(_ALL, f"""SELECT (SELECT count(*) FROM scripts)::BIGINT AS
  total_scripts, {_COUNTS} FROM findings
WHERE regexp_extract(file_path, '\\d+')::BIGINT % 5 <> 0""".replace("\\\\", "\\"))
    sql["utf8_gate"] = _with(SCRIPTS, """SELECT path, script_id % 5 <> 0 AS readable,
  CASE WHEN script_id % 5 <> 0 THEN length(content) ELSE 0 END::BIGINT AS chars FROM scripts""")
    sql["classify_scripts"] = _with(SCRIPTS, """SELECT script_id,
  CASE script_id % 6 WHEN 0 THEN concat('a/', script_id, '.sh')
    WHEN 1 THEN concat('a/', script_id, '.bash') WHEN 2 THEN concat('a/', script_id, '.SH')
    WHEN 3 THEN concat('a/', script_id, '.txt') WHEN 4 THEN 'a/.sh'
    ELSE concat('a.sh/', script_id) END AS path,
  CASE script_id % 6 WHEN 0 THEN 'sh' WHEN 1 THEN 'bash' WHEN 2 THEN 'SH' WHEN 3 THEN 'txt'
    ELSE '' END AS extension,
  script_id % 6 = 0 AS is_sh, script_id % 6 IN (0, 1, 2) AS is_script FROM scripts""")
    sql["findings_ranked"] = _numbered(f"risk_rank DESC, {_DISCOVERY}")
    sql["findings_html_order"] = _numbered(f"risk_level DESC, {_DISCOVERY}")
    sql["finding_snippets"] = _with(
        _ALL, 'SELECT rule_id, file_path, line, "column", code_snippet FROM findings'
    )
    sql["risk_score_band"] = _with(_ALL, """SELECT rule_id, lo, hi,
  count(*) FILTER (risk_score >= lo AND risk_score < hi)::BIGINT AS in_band,
  count(*)::BIGINT AS findings
FROM findings JOIN bands USING (risk_level) GROUP BY rule_id, lo, hi""")
    sql["level_names"] = _with(_ALL, f"""SELECT risk_level, risk_level AS name_en,
  {_TURKISH} AS name_tr, lower(risk_level) AS code, risk_rank::BIGINT AS rank,
  count(*)::BIGINT AS findings FROM findings GROUP BY ALL""")
    sql["parse_levels"] = _with(_ALL, f"""SELECT
  CASE line % 3 WHEN 0 THEN upper(risk_level) WHEN 1 THEN {_TURKISH}
    ELSE concat(risk_level, '?') END AS spelled,
  CASE WHEN line % 3 < 2 THEN risk_level END AS parsed, count(*)::BIGINT AS findings
FROM findings GROUP BY ALL""")
    sql["text_line_stats"] = f"""SELECT doc_id, lines, lines AS split_lines, trailing_newlines FROM (
  SELECT doc_id, (strlen(body) - strlen(replace(body, chr(10), ''))
      + CASE WHEN body = '' OR ends_with(body, chr(10)) THEN 0 ELSE 1 END)::BIGINT AS lines,
    (length(body) - length(rtrim(body, chr(10))))::BIGINT AS trailing_newlines
  FROM (SELECT doc_id, {_DOC_BODY} AS body FROM documents))"""
    sql["line_of_offset"] = f"""SELECT doc_id, strlen(head)::BIGINT AS middle_offset,
  (CASE WHEN strlen(head) >= strlen(text) THEN all_lines
    ELSE strlen(head) - strlen(replace(head, chr(10), '')) + 1 END)::BIGINT AS middle_line,
  all_lines::BIGINT AS line_past_end
FROM (SELECT doc_id, text, left(text, length(text) // 2) AS head, {_DOC_BREAKS}
    + CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 0 ELSE 1 END AS all_lines
  FROM documents)"""
    sql["offset_of_line"] = f"""SELECT doc_id, {_line_start("0")} AS line_0,
  {_line_start("1")} AS line_1, {_line_start("2")} AS line_2,
  {_line_start(f"({_DOC_BREAKS} + 1)")} AS last_line,
  {_line_start(f"({_DOC_BREAKS} + 2)")} AS missing_line FROM documents"""
    sql["html_escape_pages"] = f"SELECT page_id, {_escaped('html')} AS escaped FROM pages"
    secrets = [(rule_id, p) for rule_id, p in PATTERNS if rule_id in
               ("SEC01", "SEC02", "SEC03", "SEC04")]
    sql["strip_quotes_values"] = _with(
        SCRIPTS,
        "SELECT rule_id, path, match_no, value, value AS double_quoted, value AS single_quoted,"
        " concat(chr(39), value, '\"') AS unpaired FROM ("
        + " UNION ALL ".join(
            f"SELECT '{rule_id}' AS rule_id, path, i AS match_no, v[i] AS value FROM (SELECT path,"
            f" regexp_extract_all(content, {literal(re2(p))}, 1) AS v FROM scripts) AS m,"
            " unnest(range(1, len(v) + 1)) AS t(i)"
            for rule_id, p in secrets
        ) + ")",
    )
    tokens = _regex_hits([("TOK01", TOKEN_RULE.pattern)], "text", "documents",
                         "doc_id, lang, source, text")
    sql["custom_rule_tokens"] = _with(tokens, f"""SELECT doc_id, rule_id, match_no, line, "column",
  regexp_extract_all(text, {literal(re2(TOKEN_RULE.pattern))}, 1)[match_no] AS value
FROM regex_matches""")
    sql["tokens_by_lang_source"] = _with(tokens, """SELECT lang, source,
  count(DISTINCT doc_id)::BIGINT AS documents, count(*)::BIGINT AS findings
FROM regex_matches GROUP BY lang, source""")
    ignored = ", ".join(f"'{rule_id}'" for rule_id in IGNORED)
    sql["ignore_rules_antijoin"] = _with(_ALL, f"""SELECT rule_id, count(*)::BIGINT AS findings
FROM findings WHERE rule_id NOT IN ({ignored}) GROUP BY rule_id""")
    sql["text_tables_counts"] = _text_tables()
    sql["report_text"] = _text_report()
    sql["report_html"] = _html_report()
    sql["report_json"] = _json_report()
    sql["findings_partitioned"] = _with(_ALL, """SELECT risk_level, rule_id, file_path, line,
  "column", code_snippet FROM findings WHERE risk_level = 'Critical'""")
    sql["custom_rules_from_file"] = _with(tokens, """SELECT doc_id, rule_id,
  count(*)::BIGINT AS findings FROM regex_matches GROUP BY ALL""")
    sql["report_json_roundtrip"] = _with(_ALL, """SELECT finding_type, risk_level, file_path, line,
  "column", code_snippet, description, recommendation, risk_score FROM findings""")
    from_files = _ALL.replace(
        ", content FROM (",
        ", concat('#!/bin/bash', chr(10), content, chr(10)) AS content FROM (", 1,
    )
    sql["file_source_direct"] = _with(
        from_files, 'SELECT rule_id, line, "column", code_snippet FROM findings'
    )
    sql["file_source_scan"] = _with(
        from_files,
        """SELECT regexp_extract(file_path, '[0-9]+')::BIGINT AS script_id, rule_id,
  line, "column", code_snippet FROM findings""",
    )
    nesting = f"scripts AS (SELECT event_id, {nesting_sql('VARCHAR')} AS content FROM events)"
    hits = [(name, f"{name} hit") for name in _NAMES.split("|")]
    nesting = f"{nesting}, {_regex_hits(hits, keys='event_id')}"
    sql["nested_commands"] = _with(
        nesting, 'SELECT event_id, rule_id AS command_name, line, "column" FROM regex_matches'
    )
    sql["rule_table_scan"] = """WITH pairs AS (
  SELECT DISTINCT concat(words[i], ' ', words[i + 1]) AS pair
  FROM (SELECT words, unnest(range(1, len(words))) AS i
        FROM (SELECT regexp_extract_all(text, '[A-Za-z]+') AS words FROM benchmark))),
forms AS (
  SELECT pair, length(pair) % 2 = 0 AS caseless, CASE WHEN length(pair) % 2 = 0 THEN lower(pair) ELSE pair END AS form
  FROM pairs),
texts AS (SELECT doc_id, false AS caseless, text FROM documents UNION ALL SELECT doc_id, true, lower(text) FROM documents)
SELECT doc_id, pair AS rule_id,
       ((length(text) - length(replace(text, form, ''))) // length(form))::BIGINT AS findings
FROM texts JOIN forms ON texts.caseless = forms.caseless AND contains(text, form)"""
    sql["scan_lost_files"] = _with(_ALL, """SELECT script_id, script_id % 10 <> 3 AS readable,
  CASE WHEN script_id % 10 <> 3 THEN coalesce(n, 0) ELSE 0 END::BIGINT AS findings
FROM scripts LEFT JOIN (SELECT file_path AS path, count(*) AS n FROM findings GROUP BY 1) USING (path)""")
    events = f"{EVENT_SCRIPTS}, {_regex_hits(PATTERNS)}, {COMMANDS}, {_rules()}, {FINDINGS}"
    sql["stream_scan"] = _with(events, f"SELECT {_NO_TEXTS} FROM findings")
    sql["stream_level_windows"] = _with(events, """SELECT date_trunc('hour', ts) AS window_start,
  date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, risk_level, count(*)::BIGINT AS findings
FROM findings JOIN scripts ON file_path = path GROUP BY ALL""")
    sql["trace_log_events"] = _with(_TRACE, "SELECT * FROM classed")
    sql["trace_log_summary"] = _with(_TRACE, """SELECT pid, class, count(*)::BIGINT AS calls,
  count(error)::BIGINT AS failed FROM classed WHERE kind IN ('call', 'resumed')
GROUP BY pid, class""")
    sql["trace_whole_calls"] = _with(_TRACE, """SELECT pid, event_id AS first_place,
  event_id AS last_place, syscall, class, args, result, error, 'whole' AS state
FROM classed WHERE kind = 'call'
UNION ALL
SELECT pid, CASE WHEN before = 'unfinished' AND kind = 'resumed' THEN before_id ELSE event_id END, event_id,
  syscall, class,
  CASE WHEN before = 'unfinished' AND kind = 'resumed' THEN concat(before_args, ', ', args) ELSE args END,
  result, error, CASE WHEN before = 'unfinished' AND kind = 'resumed' THEN 'joined' ELSE kind END
FROM (SELECT *, lag(kind) OVER w AS before, lag(event_id) OVER w AS before_id, lag(args) OVER w AS before_args,
        lead(kind) OVER w AS after FROM classed WHERE kind IN ('unfinished', 'resumed')
      WINDOW w AS (PARTITION BY pid, syscall ORDER BY event_id))
WHERE kind = 'resumed' OR after IS DISTINCT FROM 'resumed'""")
    processes = _TRACE.replace(trace_line_sql("VARCHAR"), process_line_sql("VARCHAR")).replace(
        "IN ('execve', 'wait4')", "IN ('execve', 'clone', 'fork')"
    )
    sql["trace_process_trees"] = f"""WITH RECURSIVE {processes}, births AS (
  SELECT event_id, pid AS parent, result::BIGINT AS child FROM classed
  WHERE syscall IN ('clone', 'fork') AND result::BIGINT > 0),
lines AS (
  SELECT event_id, pid, 0 AS birth FROM classed UNION ALL SELECT event_id, child, 1 FROM births),
numbered AS (
  SELECT *, sum(birth) OVER (PARTITION BY pid ORDER BY event_id, birth ROWS UNBOUNDED PRECEDING)::BIGINT AS process
  FROM lines),
links AS (
  SELECT c.pid, c.process, p.pid AS parent_pid, p.process AS parent_process
  FROM numbered c JOIN numbered p USING (event_id) WHERE c.birth = 1 AND p.birth = 0),
tree AS (
  SELECT DISTINCT pid, process, pid AS root_pid, process AS root_process FROM numbered
  WHERE birth = 0 AND process = 0
  UNION ALL
  SELECT l.pid, l.process, t.root_pid, t.root_process FROM tree t
  JOIN links l ON l.parent_pid = t.pid AND l.parent_process = t.process)
SELECT root_pid, root_process, class, count(*)::BIGINT AS calls, count(error)::BIGINT AS failed
FROM classed JOIN numbered USING (event_id, pid) JOIN tree USING (pid, process)
WHERE birth = 0 GROUP BY ALL"""
    return sql
