import json
import time
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shellsieve import analyze, builtin_rules, report, scan, write_report
from shellsieve.catalog import Rule, add_rules, ignore_rules, regex_rule
from shellsieve.operators.counts import level_totals, rule_counts
from shellsieve.operators.findings import by_severity, counts_by_level, numbered, totals
from shellsieve.plans.report import FORMATS
from shellsieve.sources import reports
from shellsieve.sources.checkpoints import checkpoint_root
from shellsieve.plans.queries import file_source_direct, file_source_scan, scan_lost_files
from shellsieve.sources.files import delete_files, read_scripts, table_scripts, write_files
from shellsieve.sources.rules import check_rules, configured_rules, read_rules

NOW = datetime(2024, 5, 6, 7, 8, 9)


@pytest.fixture()
def tree(tmp_path):
    files = {
        "a.sh": b"rm x\n", "b.bash": b"eval y", "c.SH": b"#!/bin/shfoo\ncurl -k z",
        "d.txt": b"rm x", "e": b"#!/usr/bin/env bash\nrm x", "f": b"#!/bin/bash\nsudo x",
        "bad.sh": b"\xff\xfe rm x", "bad": b"#!/bin/sh\n\xff", "sub/g.sh": b"wget x",
        "k=1/h.sh": b"exec x",
    }
    for name, data in files.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(tmp_path / "tree")


def names(df):
    return sorted(row.path.split("/tree/")[1] for row in df.collect())


def test_files(spark, tree):
    direct = read_scripts(spark, tree)
    assert names(direct) == ["a.sh", "b.bash", "bad.sh", "c.SH", "f"]
    assert names(direct.where("readable")) == ["a.sh", "b.bash", "c.SH", "f"]
    everything = read_scripts(spark, tree, recursive=True)
    assert names(everything) == ["a.sh", "b.bash", "bad.sh", "c.SH", "f", "k=1/h.sh", "sub/g.sh"]
    assert names(read_scripts(spark, f"{tree}/f")) == ["f"]
    assert names(read_scripts(spark, f"{tree}/d.txt")) == []
    assert names(read_scripts(spark, f"{tree}/nothing")) == []
    counted = totals(everything, level_totals(rule_counts(everything))).first().asDict()
    assert counted == {"total_scripts": 7, "total_findings": 7, "critical": 0, "high": 3,
                       "medium": 4, "low": 0}


def test_written_files(spark, tmp_path):
    """Files appear whole under their names, and a task that runs again leaves them as they are."""
    folder = str(tmp_path / "a b" / "tree")
    rows = [(f"k={i}/{'job.sh' if i % 2 else 'part'}", "#!/bin/bash\nrm ü\n") for i in range(40)]
    files = spark.createDataFrame(rows, "name string, value string").repartition(7)
    for again in (files, files):
        write_files(again, folder)
    assert {p.relative_to(folder).as_posix(): p.read_text() for p in Path(folder).rglob("*") if p.is_file()} == dict(rows)
    delete_files(files.where("name LIKE '%.sh'"), f"file:{folder}")
    delete_files(files.where("name LIKE '%1/job.sh'"), folder)
    assert names(read_scripts(spark, folder, recursive=True)) == sorted(n for n, _ in rows if n.endswith("part"))


def test_files_of_queries_start_no_process(spark):
    """Hadoop starts processes to set a file's mode; the queries write a file per script and start none."""
    def started():
        return int(next(x.split()[1] for x in Path("/proc/stat").read_text().splitlines() if x.startswith("processes")))

    for query in (file_source_scan, scan_lost_files, file_source_direct):
        query(spark, "/root/testdata/sf0.001").count()
        before = started()
        assert query(spark, "/root/testdata/sf0.01").count() > 0
        # 157 scripts took over 900, threads of the JVM and Python workers included.
        assert started() - before < 600, query.__name__


def test_spellings_of_a_path(spark, tree, monkeypatch):
    expected = names(read_scripts(spark, tree))
    for folder in (f"file:{tree}", f"file://{tree}", f"{tree}/", f"{tree}//", f"{tree}/./", f"{tree}/sub/..",
                   tree.replace("/tree", "//tree"), tree.replace("/tree", "/./tree")):
        assert names(read_scripts(spark, folder)) == expected, folder
    for file in (f"{tree}/a.sh", f"file:{tree}/a.sh", f"file://{tree}/./a.sh", f"{tree}//a.sh"):
        assert names(read_scripts(spark, file)) == ["a.sh"], file
    assert names(read_scripts(spark, f"{tree}/sub")) == ["sub/g.sh"]


BAD_CHECKSUM = b"crc\x00\x00\x00\x02\x00\x00\x00\x00\x00"


def test_files_that_cannot_be_read_end_no_scan(spark, tmp_path):
    """One file fails when it is read, one is gone by then; the others give all their findings."""
    (tmp_path / "sub").mkdir()
    texts = {f"{name}.sh": f"rm {name}\nsudo id" for name in ("a", "gone", "bad", "sub/b", "sub/gone")}
    texts |= {"plain": "#!/bin/sh\nrm x", "badplain": "#!/bin/sh\nrm x", "latin.bash": "rm x"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "latin.bash").write_bytes(b"rm x\xff")
    analysis = analyze(spark, str(tmp_path), recursive=True)
    for name in ("gone.sh", "sub/gone.sh"):
        (tmp_path / name).unlink()
    for name in ("bad.sh", "badplain"):
        (tmp_path / f".{name}.crc").write_bytes(BAD_CHECKSUM)
    name = lambda path: path.split(f"{tmp_path}/")[1]
    found = sorted((name(r.file_path), r.line, r.rule_id) for r in analysis.findings.collect())
    assert found == [
        ("a.sh", 1, "CMD_RM"), ("a.sh", 2, "CMD_SUDO"), ("plain", 2, "CMD_RM"),
        ("sub/b.sh", 1, "CMD_RM"), ("sub/b.sh", 2, "CMD_SUDO"),
    ]
    # What only its first line would make a script is none if that cannot be read.
    assert sorted(name(r.path) for r in analysis.unreadable().collect()) == [
        "bad.sh", "gone.sh", "latin.bash", "sub/gone.sh",
    ]
    totals = analysis.totals().first()
    assert (totals.total_scripts, totals.total_findings) == (7, 5)
    assert '"total_scripts": 7' in "\n".join(r[0] for r in analysis.report("json").select("report_line").collect())


def test_a_scan_reads_every_file_once(spark, tmp_path):
    (tmp_path / "a.sh").write_text("rm x")
    analysis = analyze(spark, str(tmp_path))
    plan = analysis.findings._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan binaryFile") == 1 and "Join LeftAnti" not in plan


def test_two_custom_rules_at_one_place_keep_their_order(spark):
    rules = [regex_rule("B", "ab", "Low"), regex_rule("A", "a", "Low")]
    df = spark.createDataFrame([(f"p{i}", "ab") for i in range(20)], "path string, content string")
    order = lambda: [
        (r.file_path, r.rule_id) for r in numbered(scan(df.repartition(3), rules), by_severity())
        .orderBy("finding_no").collect()
    ]
    assert order() == order() == [(p, r) for p in sorted(f"p{i}" for i in range(20)) for r in "AB"]


def test_line_separators_in_findings_survive(spark, tmp_path):
    rows = [(f"s{i}", f"pwd='x{c}y'") for i, c in enumerate("\u2028\u2029\u0085\x0b\r")]
    scripts = spark.createDataFrame(rows, "path string, content string")
    write_report(report("json", scripts, scan(scripts), NOW, NOW), str(tmp_path / "r"))
    found = reports.read_report_findings(spark, str(tmp_path / "r"))
    assert sorted(r.code_snippet for r in found.collect()) == sorted(r.code_snippet for r in scan(scripts).collect())
    (tmp_path / "other.json").write_text(json.dumps({"findings": [{"line": 1}]}, indent=2))
    with pytest.raises(Exception, match="no line of a JSON report|MALFORMED_RECORD"):
        reports.read_report_findings(spark, str(tmp_path / "other.json")).collect()


def test_the_reported_time_covers_the_scan(spark, scanned):
    scripts, findings = scanned
    slow = F.udf(lambda text: time.sleep(0.05) or text)
    found = findings.withColumn("code_snippet", slow("code_snippet"))
    started = time.perf_counter()
    head = report("text", scripts, found, datetime.now()).orderBy("section").first().report_line
    seconds = float(head.split("Seconds: ")[1].split("\n")[0])
    assert 160 * 0.05 / 8 <= seconds <= time.perf_counter() - started


def stored_folders(spark):
    root = Path(checkpoint_root(spark).removeprefix("file://"))
    return {path.name for path in root.glob("*-*")}


def test_analyze(spark, tree, tmp_path):
    analysis = analyze(spark, tree, recursive=True, min_risk="High", ignored=["CMD_EXEC"])
    assert analysis.totals().first().total_findings == 2
    before = stored_folders(spark)
    for form in FORMATS:
        analysis.write_report(str(tmp_path / form), form)
    assert stored_folders(spark) == before
    analysis.write_report(str(tmp_path / "out"), "text")
    text = document(tmp_path / "out")
    assert "Scripts: 7\nFindings: 2\n" in text and "Finding 2\n" in text


def test_table_source(spark):
    df = spark.createDataFrame([(1, "sudo x"), (2, None)], "id long, body string")
    scripts = table_scripts(df, "id", "body")
    assert totals(scripts, counts_by_level(scan(scripts))).first().total_scripts == 2


def document(folder):
    return "".join(path.read_text() for path in sorted(folder.glob("part-*")))


@pytest.fixture()
def scanned(spark):
    rows = [(f"s{i:03}.sh", f"rm -rf /\necho '<b>&\"' | base64\npwd=\"{i}\"") for i in range(40)]
    scripts = spark.createDataFrame(rows, "path string, content string").repartition(5)
    return scripts, scan(scripts)


def test_json_report(spark, scanned, tmp_path):
    scripts, findings = scanned
    write_report(report("json", scripts, findings, NOW, NOW), str(tmp_path / "r"))
    loaded = json.loads(document(tmp_path / "r"))
    assert list(loaded) == [
        "analyzed_files", "total_scripts", "findings", "total_findings", "findings_by_risk_level",
        "start_time", "end_time", "duration_seconds",
    ]
    assert loaded["analyzed_files"] == [f"s{i:03}.sh" for i in range(40)]
    assert loaded["total_scripts"] == 40 and loaded["total_findings"] == 160
    assert loaded["findings_by_risk_level"] == {"critical": 80, "high": 0, "medium": 40, "low": 40}
    assert [f["finding_type"] for f in loaded["findings"][:4]] == [
        "DangerousCommand", "DangerousCommand", "HardcodedSecret", "FilePermissionIssue"]
    assert loaded["start_time"] == "2024-05-06 07:08:09"
    columns = ["file_path", "line", "column", "risk_score", "code_snippet"]
    wanted = sorted(findings.select(*columns).collect())
    assert sorted(reports.read_report_findings(spark, str(tmp_path / "r"))
                  .select(*columns).collect()) == wanted
    (tmp_path / "whole.json").write_text(json.dumps(loaded, indent=2))
    whole = reports.read_reports(spark, str(tmp_path / "whole.json"))
    assert sorted(whole.select(F.inline("findings")).select(*columns).collect()) == wanted


def test_empty_reports(spark, scanned, tmp_path):
    scripts, findings = scanned
    for form in FORMATS:
        write_report(report(form, scripts.limit(0), findings.limit(0), NOW, NOW),
                     str(tmp_path / form))
    loaded = json.loads(document(tmp_path / "json"))
    assert loaded["findings"] == [] and loaded["findings_by_risk_level"]["low"] == 0
    with pytest.raises(ValueError):
        report("pdf", scripts, findings)


def test_text_and_html_reports(spark, scanned, tmp_path):
    scripts, findings = scanned
    write_report(report("text", scripts, findings, NOW, NOW), str(tmp_path / "t"))
    text = document(tmp_path / "t")
    found = [int(line.split()[1]) for line in text.splitlines() if line.startswith("Finding ")]
    assert found == list(range(1, 161))
    order = [line.split()[1] for line in text.splitlines() if line.startswith("  Level:")]
    assert order == ["Critical"] * 80 + ["Medium"] * 40 + ["Low"] * 40
    write_report(report("html", scripts, findings, NOW, NOW, legacy_html_order=True),
                 str(tmp_path / "h"))
    html = document(tmp_path / "h")
    assert html.rstrip().endswith("</html>") and "&lt;b&gt;&amp;&quot;" in html
    cards = [part.split('"')[0] for part in html.split('<div class="card ')[1:]]
    assert cards == ["medium"] * 40 + ["low"] * 40 + ["critical"] * 80


def test_numbering_is_one_to_n_in_order(spark, scanned):
    _, findings = scanned
    skewed = findings.unionByName(findings.limit(0)).repartition(7)
    rows = numbered(skewed, by_severity()).orderBy("finding_no").collect()
    assert [row.finding_no for row in rows] == list(range(1, 161))
    keys = [(-r.risk_rank, r.file_path, r.phase, r.rule_no, r.line, r.column) for r in rows]
    assert keys == sorted(keys)


def test_findings_tables(spark, scanned, tmp_path):
    _, findings = scanned
    reports.write_findings_json(findings, str(tmp_path / "j"))
    reports.write_findings_table(findings, str(tmp_path / "p"))
    wanted = sorted(findings.collect())
    columns = findings.columns
    assert sorted(reports.read_findings(spark, str(tmp_path / "j")).select(columns).collect()) == wanted
    table = reports.read_findings_table(spark, str(tmp_path / "p"))
    assert sorted(table.select(columns).collect()) == wanted
    plan = table.where("risk_level = 'Low'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(risk_level" in plan


def test_custom_and_ignored_rules(spark, tmp_path):
    lines = [
        {"rule_id": "TOK01", "kind": "regex", "finding_type": "HardcodedSecret",
         "risk_level": "Critical", "pattern": r"(?i)token\s*=", "enabled": True, "rule_no": 1},
        {"rule_id": "CMD_NC", "kind": "command", "finding_type": "InsecureNetworkAccess",
         "risk_level": "High", "command_name": "nc", "enabled": True, "phase": 0},
        {"rule_id": "OFF", "kind": "regex", "finding_type": "OtherSecurityRisk",
         "risk_level": "Low", "pattern": "x", "enabled": False},
    ]
    path = tmp_path / "rules.json"
    path.write_text("\n".join(json.dumps(line) for line in lines))
    rules = configured_rules(spark, builtin_rules(), str(path), ["CMD_RM"])
    df = spark.createDataFrame([("p", "TOKEN = x\nnc -l 1 | rm y")], "path string, content string")
    found = {row.rule_id for row in scan(df, rules).collect()}
    assert found == {"TOK01", "CMD_NC"}
    assert {row.rule_id for row in scan(df, read_rules(spark, str(path))).collect()} == found


def test_bad_rules_are_rejected(spark):
    good = regex_rule("X", "x", "Low")
    for bad in (
        regex_rule("X", "x*", "Low"), regex_rule("X", "(", "Low"),
        regex_rule("X", "x", "Huge"), regex_rule("X", "x", "Low", finding_type="Odd"),
        Rule("X", "regex", "OtherSecurityRisk", "Low"), Rule("X", "glob", "OtherSecurityRisk", "Low"),
        Rule("X", "command", "OtherSecurityRisk", "Low"),
    ):
        with pytest.raises(ValueError):
            check_rules(spark, [bad])
    check_rules(spark, [good])
    with pytest.raises(ValueError):
        add_rules([good], [good])
    with pytest.raises(ValueError):
        add_rules(builtin_rules(), [Rule("C2", "command", "DangerousCommand", "Low",
                                         command_name="rm")])
    assert ignore_rules([good], ["X"]) == []
