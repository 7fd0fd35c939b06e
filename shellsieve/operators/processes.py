"""Processes of a trace and the scripts that started them.

A process is a pid from one birth to the next: pids are used again, and what a line belongs to
depends on the births before it. A birth is the result of a fork or clone; it counts from
where that call began, since the child may run before its parent hears of it. Processes that
were there at the start have number 0.

Tables of processes grow with the log, so they are joined by merging: a broadcast would send them
to the driver, in each step of the way up.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from shellsieve.sources.checkpoints import Scratch

# Calls that return the pid of a new process.
BIRTH_CALLS = ("clone", "clone3", "fork", "vfork")
#: Places in the log whose births are counted together first.
PLACES_AT_ONCE = 100_000


def numbered_processes(calls, keys=(), places_at_once=PLACES_AT_ONCE):
    """``calls`` (see ``trace_calls``) with process, the number of births of its pid before it.

    Births are counted within stretches of the log, and then over the stretches of a pid, so a pid
    with very many calls is not one group.
    """
    columns = calls.columns
    born = _births(calls, keys).select(*keys, F.col("child").alias("pid"), "first_place", F.lit(1).alias("birth"))
    both = calls.withColumn("birth", F.lit(0)).unionByName(born, allowMissingColumns=True).withColumn(
        "stretch", F.col("first_place") - F.pmod("first_place", F.lit(places_at_once))
    )
    # The line that tells of a birth is the parent's, who may have the same pid.
    inside = Window.partitionBy(*keys, "pid", "stretch").orderBy("first_place", "birth").rowsBetween(
        Window.unboundedPreceding, 0
    )
    before = Window.partitionBy(*keys, "pid").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = both.groupBy(*keys, "pid", "stretch").agg(F.sum("birth").alias("births")).select(
        *keys, "pid", "stretch", F.coalesce(F.sum("births").over(before), F.lit(0)).alias("earlier")
    )
    counted = both.withColumn("births", F.sum("birth").over(inside)).join(stretches.hint("merge"), [*keys, "pid", "stretch"])
    return counted.select(
        *columns, "birth", (F.col("earlier") + F.col("births")).cast("long").alias("process")
    )


def _births(calls, keys):
    child = F.expr("try_cast(result AS BIGINT)")
    return calls.where(F.col("syscall").isin(*BIRTH_CALLS) & (child > 0)).select(
        *keys, "pid", "first_place", child.alias("child")
    )


def process_roots(calls, keys=(), places_at_once=PLACES_AT_ONCE):
    """``calls`` with process, root_pid and root_process: the process at the top of its tree.

    Parents are followed by doubling, so a chain of n processes takes log n joins.
    """
    scratch = Scratch(calls.sparkSession)
    columns = calls.columns
    found = scratch.stored(numbered_processes(calls, keys, places_at_once), "processes")
    children = found.where("birth = 1").select(*keys, "first_place", F.col("pid").alias("child"), F.col("process").alias("child_process"))
    # A line tells of one birth, so its place names the parent's call.
    parents = _births(found.where("birth = 0"), keys).join(
        found.where("birth = 0").select(*keys, "pid", "first_place", "process").hint("merge"),
        [*keys, "pid", "first_place"],
    )
    up = children.join(parents.hint("merge"), [*keys, "first_place", "child"]).select(
        *keys, F.col("child").alias("pid"), F.col("child_process").alias("process"),
        F.col("pid").alias("root_pid"), F.col("process").alias("root_process"),
    )
    up = scratch.stored(up, "parents")
    while True:
        above = up.select(
            *keys, F.col("pid").alias("root_pid"), F.col("process").alias("root_process"),
            F.col("root_pid").alias("above_pid"), F.col("root_process").alias("above_process"),
        )
        joined = scratch.stored(up.join(above.hint("merge"), [*keys, "root_pid", "root_process"], "left"), "ancestors")
        ended = joined.where("above_pid IS NOT NULL").isEmpty()
        up = scratch.stored(
            joined.select(
                *keys, "pid", "process", F.coalesce("above_pid", "root_pid").alias("root_pid"),
                F.coalesce("above_process", "root_process").alias("root_process"),
            ),
            "parents",
        )
        scratch.drop(keep=[found, up])
        if ended:
            break
    return found.where("birth = 0").join(up.hint("merge"), [*keys, "pid", "process"], "left").select(
        *columns, "process", F.coalesce("root_pid", "pid").alias("root_pid"),
        F.coalesce("root_process", F.when(F.col("root_pid").isNull(), F.col("process"))).alias("root_process"),
    )


def calls_per_tree(calls, keys=(), places_at_once=PLACES_AT_ONCE):
    """Finished calls and failures per class and process at the top of a tree."""
    rooted = process_roots(calls.where(F.col("state").isin("whole", "joined", "resumed")), keys, places_at_once)
    return rooted.groupBy(*keys, "root_pid", "root_process", "class").agg(
        F.count("*").cast("long").alias("calls"), F.count("error").cast("long").alias("failed")
    )
