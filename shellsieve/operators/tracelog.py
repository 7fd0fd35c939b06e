"""System-call traces (follow-forks format, one event per line) as tables."""

from functools import partial

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from shellsieve.sources.workers import ship

# Names of the traced system calls by class.
PROCESS_CALLS = (
    "clone", "clone3", "execve", "execveat", "exit", "exit_group", "fork", "kill", "vfork",
    "wait4", "waitid",
)
NETWORK_CALLS = (
    "accept", "accept4", "bind", "connect", "getpeername", "getsockname", "getsockopt", "listen",
    "recvfrom", "recvmmsg", "recvmsg", "sendmmsg", "sendmsg", "sendto", "setsockopt", "shutdown",
    "socket", "socketpair",
)
FILE_CALLS = (
    "access", "chdir", "chmod", "chown", "chroot", "creat", "faccessat", "faccessat2", "fchmodat",
    "fchownat", "getcwd", "lchown", "link", "linkat", "lstat", "mkdir", "mkdirat", "mount",
    "newfstatat", "open", "openat", "openat2", "readlink", "readlinkat", "rename", "renameat",
    "renameat2", "rmdir", "stat", "statfs", "statx", "symlink", "symlinkat", "truncate", "umount2",
    "unlink", "unlinkat", "utimensat",
)

_CALL = r"^(\d+)\s+(\w+)\((.*?)\)?\s+= (-?\w+|\?)(?: (E[A-Z0-9]+) .*)?$"
_UNFINISHED = r"^(\d+)\s+(\w+)\((.*?),? ?<unfinished \.\.\.>$"
_RESUMED = r"^(\d+)\s+<\.\.\. (\w+) resumed>,? ?(.*?)\)?\s+= (-?\w+|\?)(?: (E[A-Z0-9]+) .*)?$"


def read_trace(spark, path):
    """Trace logs as (line, log)."""
    return spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("log")
    )


def parse_trace(traces, line_col="line", keep=()):
    """pid, kind, syscall, class, args, result and error of every line.

    ``kind`` is call, unfinished, resumed, signal, exit or other.
    """
    line = F.col(line_col)
    kind = (
        F.when(F.endswith(line, F.lit("<unfinished ...>")) & line.rlike(_UNFINISHED), "unfinished")
        .when(F.contains(line, F.lit(" resumed>")) & line.rlike(_RESUMED), "resumed")
        .when(F.endswith(line, F.lit(" ---")) & line.rlike(r"^\d+\s+--- .* ---$"), "signal")
        .when(F.endswith(line, F.lit(" +++")) & line.rlike(r"^\d+\s+\+\+\+ .* \+\+\+$"), "exit")
        .when(line.rlike(_CALL), "call")
        .otherwise("other")
    )

    def part(group):
        text = (
            F.when(F.col("kind") == "call", F.regexp_extract(line, _CALL, group))
            .when(F.col("kind") == "resumed", F.regexp_extract(line, _RESUMED, group))
        )
        if group < 4:
            text = text.when(
                F.col("kind") == "unfinished", F.regexp_extract(line, _UNFINISHED, group)
            )
        return F.nullif(text, F.lit(""))

    parsed = traces.select(*keep, line_col, kind.alias("kind")).select(
        *keep,
        F.expr(f"try_cast(regexp_extract({line_col}, '^([0-9]+) ', 1) AS BIGINT)").alias("pid"),
        "kind",
        part(2).alias("syscall"),
        part(3).alias("args"),
        part(4).alias("result"),
        part(5).alias("error"),
    )
    return parsed.withColumn("class", syscall_class(F.col("syscall")))


def syscall_class(name):
    return (
        F.when(name.isin(*PROCESS_CALLS), "process")
        .when(name.isin(*NETWORK_CALLS), "network")
        .when(name.isin(*FILE_CALLS), "file")
        .when(name.isNotNull(), "other")
    )


def trace_summary(parsed, *keys):
    """Finished calls and failures per key, process by default."""
    finished = parsed.where(F.col("kind").isin("call", "resumed"))
    return finished.groupBy(*(keys or ("pid", "class"))).agg(
        F.count(F.lit(1)).cast("long").alias("calls"),
        F.count("error").cast("long").alias("failed"),
    )


#: Places in the log whose halves are put together first.
PLACES_AT_ONCE = 100_000


def trace_calls(parsed, order_col, keys=("pid",), places_at_once=PLACES_AT_ONCE):
    """One row per call with whole arguments, result and error.

    Columns are ``keys``, first_place, last_place, syscall, class, args, result, error and state. A
    call that was interrupted is written in two halves; halves of the same keys and call belong
    together if the second is the next one after the first, by ``order_col`` (a whole number).
    ``state`` is whole, joined, unfinished (no second half) or resumed (no first half).

    Halves meet within stretches of the log first, and then only the outermost of each stretch, so
    a process with very many calls is not one group.
    """
    place, group = F.col(order_col), [*keys, "syscall"]
    halves = parsed.where(F.col("kind").isin("unfinished", "resumed")).select(
        *group, place.alias("place"), "kind", "args", "result", "error"
    )
    inside = Window.partitionBy(*group, F.col("place") - F.pmod("place", F.lit(places_at_once))).orderBy("place")
    before, after = F.struct("kind", "place", "args"), F.col("kind")
    halves = halves.withColumns({
        "before": F.lag(before).over(inside), "after": F.lead(after).over(inside),
    })
    outermost = F.col("before").isNull() | F.col("after").isNull()
    across = Window.partitionBy(*group).orderBy("place")
    edges = halves.where(outermost).withColumns({
        "before": F.coalesce("before", F.lag(before).over(across)),
        "after": F.coalesce("after", F.lead(after).over(across)),
    })
    halves = halves.where(~outermost).unionByName(edges)
    joined = (F.col("kind") == "resumed") & (F.col("before.kind") == "unfinished")
    first_half_of_other = (F.col("kind") == "unfinished") & (F.coalesce("after", F.lit("")) == "resumed")
    first = F.when(joined, F.col("before"))
    found = halves.where(~first_half_of_other).select(
        *keys,
        F.coalesce(first["place"], "place").alias("first_place"),
        F.col("place").alias("last_place"),
        "syscall",
        F.when(joined, joined_args(first["args"], F.col("args"))).otherwise(F.col("args")).alias("args"),
        "result", "error",
        F.when(F.coalesce(joined, F.lit(False)), "joined").otherwise(F.col("kind")).alias("state"),
    )
    return _classed(_whole_calls(parsed, order_col, keys).unionByName(found), keys)


def joined_args(first, second):
    return F.nullif(F.concat_ws(", ", first, second), F.lit(""))


def _whole_calls(parsed, order_col, keys):
    place = F.col(order_col)
    return parsed.where(F.col("kind") == "call").select(
        *keys, place.alias("first_place"), place.alias("last_place"), "syscall", "args", "result",
        "error", F.lit("whole").alias("state"),
    )


def _classed(calls, keys):
    return calls.select(
        *keys, "first_place", "last_place", "syscall", syscall_class(F.col("syscall")).alias("class"),
        "args", "result", "error", "state",
    )


def trace_calls_stream(parsed, order_col, keys=("pid",), timeout_ms=600_000):
    """As ``trace_calls`` for a stream whose batches follow the log.

    A first half waits in the state of its keys and call. It is given up, with the state unfinished,
    when another first half follows or after ``timeout_ms`` of processing time.
    """
    ship(parsed.sparkSession)
    halves = parsed.where(F.col("kind").isin("unfinished", "resumed")).select(
        *keys, "syscall", F.col(order_col).cast("long").alias("place"), "kind", "args", "result", "error"
    )
    types = {field.name: field.dataType.simpleString() for field in halves.schema}
    group = ", ".join(f"`{key}` {types[key]}" for key in keys)
    schema = (
        f"{group}, first_place long, last_place long, syscall string, args string, result string,"
        " error string, state string"
    )
    found = halves.groupBy(*keys, "syscall").applyInPandasWithState(
        partial(_paired, keys, timeout_ms), schema, "place long, args string", "append",
        GroupStateTimeout.ProcessingTimeTimeout,
    )
    whole = _whole_calls(parsed, order_col, keys).withColumns({
        name: F.col(name).cast("long") for name in ("first_place", "last_place")
    })
    return _classed(whole.unionByName(found), keys)


def _paired(names, timeout_ms, key, frames, state):
    """Calls that the halves of one process and call complete, in the order of the log."""
    *keys, syscall = key
    out = []

    def give(first, last, args, result, error, kind):
        out.append((*keys, first, last, syscall, args, result, error, kind))

    waiting = tuple(state.get) if state.exists else None
    if state.hasTimedOut:
        give(waiting[0], waiting[0], waiting[1], None, None, "unfinished")
        state.remove()
    else:
        rows = pd.concat(list(frames)).sort_values("place", kind="stable")
        rows = rows.astype(object).where(rows.notna(), None)
        for place, kind, args, result, error in rows[["place", "kind", "args", "result", "error"]].itertuples(index=False):
            if kind == "unfinished":
                if waiting:
                    give(waiting[0], waiting[0], waiting[1], None, None, "unfinished")
                waiting = (int(place), args)
            elif waiting:
                give(waiting[0], place, ", ".join(filter(None, (waiting[1], args))) or None, result, error, "joined")
                waiting = None
            else:
                give(place, place, args, result, error, "resumed")
        if waiting:
            state.update(waiting)
            state.setTimeoutDuration(timeout_ms)
        elif state.exists:
            state.remove()
    columns = [*names, "first_place", "last_place", "syscall", "args", "result", "error", "state"]
    yield pd.DataFrame(out, columns=columns).astype({"first_place": "int64", "last_place": "int64"})
