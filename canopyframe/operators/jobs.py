"""Processing jobs as a table of status events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_status(events: DataFrame) -> DataFrame:
    """Current state of every job: first and last event time, last status and parameters."""
    newest = F.struct("ts", "event_id")
    return events.groupBy("job_id").agg(F.min("ts").alias("created"), F.max("ts").alias("updated"),
                                        F.max_by("status", newest).alias("status"), F.max_by("params", newest).alias("params"))


def after_restart(status: Column) -> Column:
    """Jobs that were running when the worker stopped go back to the queue."""
    return F.when(status == "running", "queued").otherwise(status)


def recent_jobs(status: DataFrame, limit: int = 50) -> DataFrame:
    return status.orderBy(F.col("created").desc(), "job_id").limit(limit)


def open_jobs(status: DataFrame) -> DataFrame:
    """Queued jobs, oldest first."""
    return status.where(F.col("status") == "queued").orderBy("created", "job_id")


def job_log(events: DataFrame, line: Column, tail: int = 8) -> DataFrame:
    """Last lines of each job's log, oldest first.

    The tail is taken per slice of a job first, so a chatty job never meets in one task.
    """
    rows = events.select("job_id", "ts", "event_id", line.alias("line"), F.pmod(F.xxhash64("event_id"), F.lit(32)).alias("_s"))
    newest = (F.col("ts").desc(), F.col("event_id").desc())
    part = rows.withColumn("_n", F.row_number().over(Window.partitionBy("job_id", "_s").orderBy(*newest))).where(F.col("_n") <= tail)
    last = part.withColumn("_n", F.row_number().over(Window.partitionBy("job_id").orderBy(*newest))).where(F.col("_n") <= tail)
    return last.groupBy("job_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ts", "event_id", "line"))), lambda e: e["line"]), "\n").alias("log_tail"))
