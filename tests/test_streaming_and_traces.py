import random
from datetime import datetime, timedelta

from shellsieve.operators.processes import numbered_processes, process_roots
from shellsieve.operators.scan import scan
from shellsieve.operators.tracelog import (
    parse_trace, read_trace, trace_calls, trace_calls_stream, trace_summary,
)
from shellsieve.streaming.scans import (
    latest_windows, level_windows, scan_stream, write_window_updates,
)

SCHEMA = "ts timestamp, path string, content string"
START = datetime(2024, 1, 1)


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_stream_findings_equal_batch_findings(spark, tmp_path):
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    first = [(START, f"p{i}", "rm x\npwd='a' PWD='b'") for i in range(5)]
    second = [(START, f"q{i}", "case x in\n a) sudo y;;\nesac") for i in range(5)]
    for rows in (first, second):
        put(spark, source, rows)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        scan_stream(stream, out, state).awaitTermination()
    batch = scan(spark.read.schema(SCHEMA).parquet(source))
    assert sorted(spark.read.parquet(out).select(batch.columns).collect()) == sorted(batch.collect())
    # Nothing new: nothing is written twice.
    scan_stream(stream, out, state).awaitTermination()
    assert spark.read.parquet(out).count() == batch.count() == 20


def test_windows_drop_late_rows(spark, tmp_path):
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))

    def run():
        windows = level_windows(spark.readStream.schema(SCHEMA).parquet(source), "ts")
        write_window_updates(windows, out, state).awaitTermination()

    put(spark, source, [(START + timedelta(minutes=5), "a", "rm x"),
                        (START + timedelta(minutes=59), "b", "eval x\nrm y")])
    run()
    put(spark, source, [(START + timedelta(hours=3), "c", "rm x")])
    run()
    # The first window ended more than ten minutes before the newest row.
    put(spark, source, [(START + timedelta(minutes=6), "late", "rm x"),
                        (START + timedelta(hours=2, minutes=55), "in time", "rm x")])
    run()
    got = sorted((row.window_start.hour, row.risk_level, row.findings)
                 for row in latest_windows(spark, out).collect())
    assert got == [(0, "High", 1), (0, "Medium", 2), (2, "Medium", 1), (3, "Medium", 1)]
    batch = level_windows(spark.read.schema(SCHEMA).parquet(source), "ts").collect()
    assert (0, "Medium", 3) in {(r.window_start.hour, r.risk_level, r.findings) for r in batch}


TRACE = r'''
10 execve("/bin/bash", ["bash", "x.sh"], 0x7ff /* 9 vars */) = 0
10 openat(AT_FDCWD, "/etc/a) = 1", O_RDONLY|O_CLOEXEC) = 3
10 stat("/nope", 0x7ff) = -1 ENOENT (No such file or directory)
10 clone(child_stack=NULL, flags=CLONE_CHILD_CLEARTID) = 11
11 connect(3, {sa_family=AF_INET, sin_port=htons(80)}, 16 <unfinished ...>
10 wait4(-1,  <unfinished ...>
11 <... connect resumed>) = -1 ECONNREFUSED (Connection refused)
11 futex(0x1, FUTEX_WAIT) = ?
11 +++ exited with 1 +++
10 <... wait4 resumed>[{WIFEXITED(s)}], 0, NULL) = 11
10 --- SIGCHLD {si_signo=SIGCHLD} ---
not a trace line
'''.strip()


def test_trace_log(spark, tmp_path):
    (tmp_path / "trace.log").write_text(TRACE)
    parsed = parse_trace(read_trace(spark, str(tmp_path / "trace.log")))
    rows = [tuple(row) for row in parsed.select(
        "pid", "kind", "syscall", "result", "error", "class").collect()]
    assert rows == [
        (10, "call", "execve", "0", None, "process"),
        (10, "call", "openat", "3", None, "file"),
        (10, "call", "stat", "-1", "ENOENT", "file"),
        (10, "call", "clone", "11", None, "process"),
        (11, "unfinished", "connect", None, None, "network"),
        (10, "unfinished", "wait4", None, None, "process"),
        (11, "resumed", "connect", "-1", "ECONNREFUSED", "network"),
        (11, "call", "futex", "?", None, "other"),
        (11, "exit", None, None, None, None),
        (10, "resumed", "wait4", "11", None, "process"),
        (10, "signal", None, None, None, None),
        (None, "other", None, None, None, None),
    ]
    assert parsed.where("syscall = 'openat'").first().args == (
        'AT_FDCWD, "/etc/a) = 1", O_RDONLY|O_CLOEXEC')
    summary = {(r.pid, r["class"]): (r.calls, r.failed) for r in trace_summary(parsed).collect()}
    assert summary == {(10, "process"): (3, 0), (10, "file"): (2, 1), (11, "network"): (1, 1),
                       (11, "other"): (1, 0)}


def half_lines(rng, n):
    """(place, line) of calls of some processes, one of which has most; halves may be missing."""
    out = []
    for place in range(n):
        pid = 7 if rng.random() < 0.6 else rng.randint(1, 5)
        call = rng.choice(["read", "wait4"])
        out.append((place, rng.choice([
            f"{pid} {call}({place}, <unfinished ...>", f"{pid} <... {call} resumed>x{place}, 2) = {place}",
            f"{pid} <... {call} resumed>) = -1 EINTR (Interrupted)", f"{pid} open({place}) = 3", f"{pid} --- SIGCHLD {{}} ---",
        ])))
    return out


def plain_calls(lines):
    """Calls put together by going through the log."""
    waiting, out = {}, []
    for place, line in lines:
        pid, rest = line.split(" ", 1)
        pid = int(pid)
        if rest.startswith("--- "):
            continue
        if rest.startswith("<... "):
            call = rest.split()[1]
            args, result = rest.split("resumed>")[1].rsplit(") = ", 1)
            error = "EINTR" if "EINTR" in result else None
            first = waiting.pop((pid, call), None)
            args = ", ".join(filter(None, [first and first[1], args])) or None
            out.append((pid, first[0] if first else place, place, call, args, result.split()[0], error, "joined" if first else "resumed"))
        elif rest.endswith("<unfinished ...>"):
            call = rest.split("(")[0]
            if (pid, call) in waiting:
                old = waiting[pid, call]
                out.append((pid, old[0], old[0], call, old[1], None, None, "unfinished"))
            waiting[pid, call] = (place, rest.split("(")[1].split(", <")[0])
        else:
            out.append((pid, place, place, "open", str(place), "3", None, "whole"))
    rest = [(pid, place, place, call, args, None, None, "unfinished") for (pid, call), (place, args) in waiting.items()]
    return sorted(out, key=repr), sorted(rest, key=repr)


CALL = ("pid", "first_place", "last_place", "syscall", "args", "result", "error", "state")


def calls(df):
    return sorted((tuple(row) for row in df.select(*CALL).collect()), key=repr)


def test_halves_of_calls(spark):
    for seed, at_once in ((1, 1), (2, 3), (3, 40), (4, 100_000)):
        lines = half_lines(random.Random(seed), 400)
        df = spark.createDataFrame(lines, "place long, line string").repartition(5)
        found = calls(trace_calls(parse_trace(df, keep=["place"]), "place", places_at_once=at_once))
        done, rest = plain_calls(lines)
        assert found == sorted(done + rest, key=repr)
    assert calls(trace_calls(parse_trace(df.limit(0), keep=["place"]), "place")) == []


def test_halves_of_calls_in_a_stream(spark, tmp_path):
    lines = half_lines(random.Random(9), 300)
    done, _ = plain_calls(lines)
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    for low, high in ((0, 10), (10, 150), (150, 151), (151, 300)):
        part = spark.createDataFrame(lines[low:high], "place long, line string")
        part.repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema("place long, line string").parquet(source)
        found = trace_calls_stream(parse_trace(stream, keep=["place"]), "place")
        # One batch: while halves may still time out, a query that takes all that is there goes on.
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(
            once=True
        ).start().awaitTermination(120)
    assert calls(spark.read.parquet(out)) == done


def test_processes_and_their_roots(spark):
    """Against a walk through the log; pids come again, a parent may have its child's old pid."""
    rng = random.Random(4)
    lines, parent, number, expected = [], {}, {}, []
    for place in range(600):
        pid = 1 if rng.random() < 0.5 else rng.randint(2, 9)
        me = (pid, number.get(pid, 0))
        child = rng.randint(2, 12) if rng.random() < 0.2 else None
        lines.append((place, f"{pid} clone() = {child}" if child else f"{pid} open({place}) = 3"))
        expected.append((place, me))
        if child:
            number[child] = number.get(child, 0) + 1
            parent[child, number[child]] = me

    def root(process):
        while process in parent:
            process = parent[process]
        return process

    df = spark.createDataFrame(lines, "place long, line string").repartition(4)
    calls = trace_calls(parse_trace(df, keep=["place"]), "place")
    for at_once in (7, 100_000):
        found = process_roots(calls, places_at_once=at_once).collect()
        assert sorted((r.first_place, (r.pid, r.process), (r.root_pid, r.root_process)) for r in found) == [
            (place, me, root(me)) for place, me in expected
        ]
    assert process_roots(calls.limit(0)).collect() == []


def test_processes_are_not_sent_to_the_driver(spark):
    """Tables of processes grow with the log; a broadcast of one passes through the driver."""
    calls = spark.createDataFrame(
        [(1, 10, "clone", "11"), (2, 11, "fork", "12"), (3, 12, "stat", "0"), (4, 10, "stat", "0")],
        "first_place long, pid long, syscall string, result string",
    )
    rooted = process_roots(calls)
    for table in (rooted, numbered_processes(calls)):
        assert "Broadcast" not in table._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.first_place, r.root_pid, r.root_process) for r in rooted.collect()) == [
        (1, 10, 0), (2, 10, 0), (3, 10, 0), (4, 10, 0)
    ]
