"""Scans of arriving scripts, and findings per level in time windows."""

from pyspark.sql import functions as F

from shellsieve.catalog import active_rules, builtin_rules, rules_table
from shellsieve.operators.scan import matches, scan


def scan_stream(scripts, out, checkpoint, trigger=None, **scan_options):
    """Append the findings of a stream of scripts to a table; returns the started query.

    The scan keeps no state, and the file sink commits every batch exactly once.
    """
    return (
        scan(scripts, **scan_options)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def level_windows(scripts, time_col, text_col="content", window="1 hour", late="10 minutes",
                  rules=None, min_risk=None):
    """Findings per tumbling window and level; works on streams and on tables.

    On a stream, texts later than ``late`` behind the newest one no longer count.
    """
    active = active_rules(builtin_rules() if rules is None else rules, min_risk)
    levels = rules_table(scripts.sparkSession, active).select("rule_id", "risk_level")
    timed = scripts.withWatermark(time_col, late) if scripts.isStreaming else scripts
    found = matches(timed, active, text_col, [time_col]).join(F.broadcast(levels), "rule_id")
    return (
        found.groupBy(F.window(time_col, window).alias("window"), "risk_level")
        .agg(F.count(F.lit(1)).cast("long").alias("findings"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "risk_level",
            "findings",
        )
    )


def write_window_updates(windows, out, checkpoint, trigger=None):
    """Write the changed windows of every batch below ``out``; returns the started query.

    A batch overwrites its own folder, so a repeated batch leaves the same files.
    """

    def write(changed, batch_id):
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        windows.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def latest_windows(spark, out):
    """The last count of every window and level written by ``write_window_updates``."""
    return (
        spark.read.parquet(out)
        .groupBy("window_start", "window_end", "risk_level")
        .agg(F.max_by("findings", "batch").alias("findings"))
    )
