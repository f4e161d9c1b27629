"""What scans and streams do: which are due, when next and what holds them back, and their triggers as rows of a table."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = "id string, run string, event string, batch long, at timestamp, rows long, millis long, error string"
#: Events of a query in the order in which they can share an instant.
EVENTS = ("started", "progress", "idle", "terminated")


def scans(jobs: DataFrame, schedules: DataFrame, now: Column, guards: Mapping[str, Column] | None = None) -> DataFrame:
    """A row a schedule: its last job, last_triggered_at, next_due_at, and reason, the first thing that holds it back (null: it is due).

    schedules: root_path, enabled, interval_seconds (null: not enabled, no interval) and whatever guards need.
    Reasons, in this order: disabled, scan_running, waiting_for_interval, and the guards, conditions on the
    schedule's own columns by the reason they give; a guard that is null holds back. A job that is an error
    without a start never began: it is the last job, with its message, but moves no due time. Jobs of a root
    are counted before they meet their schedule, so a root with many jobs is no hot key. A schedule that
    was never run is due at once and has no next_due_at.
    """
    began = ~((F.col("status") == "error") & F.col("started_at").isNull())
    each = jobs.groupBy(F.col("root_path").alias("__root")).agg(
        F.max(F.when(began, F.col("started_at"))).alias("last_triggered_at"), F.coalesce(F.max(F.col("status") == "running"), F.lit(False)).alias("__running"),
        F.max_by(F.struct(F.col("id").alias("last_job"), F.col("status").alias("last_status"), F.col("message").alias("last_message")), "id").alias("__last"),
    )
    out = schedules.join(each, F.col("root_path") == F.col("__root"), "left")
    out = out.withColumn("next_due_at", F.col("last_triggered_at") + F.make_dt_interval(secs=F.coalesce("interval_seconds", F.lit(0))))
    reason = F.when(~F.coalesce("enabled", F.lit(False)), "disabled").when(F.col("__running"), "scan_running").when(now < F.col("next_due_at"), "waiting_for_interval")
    for name, holds in (guards or {}).items():
        reason = reason.when(F.coalesce(holds, F.lit(True)), name)
    return out.select(*schedules.columns, "__last.*", "last_triggered_at", "next_due_at", reason.alias("reason"))


class Progress(StreamingQueryListener):
    """Appends a row of PROGRESS for every start, trigger, idle trigger and end of the session's streaming queries to a JSON folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _put(self, query, run, event: str, at: str | None, batch: int | None = None, rows: int | None = None, millis: int | None = None, error: str | None = None) -> None:
        when = datetime.fromisoformat(at) if at else datetime.now(UTC)
        self.spark.createDataFrame([(str(query), str(run), event, batch, when, rows, millis, error)], PROGRESS).coalesce(1).write.mode("append").json(self.path)

    def onQueryStarted(self, event) -> None:
        self._put(event.id, event.runId, "started", event.timestamp)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._put(p.id, p.runId, "progress", p.timestamp, p.batchId, p.numInputRows, p.batchDuration)

    def onQueryIdle(self, event) -> None:
        self._put(event.id, event.runId, "idle", event.timestamp)

    def onQueryTerminated(self, event) -> None:
        self._put(event.id, event.runId, "terminated", None, error=event.exception)

    def read(self) -> DataFrame:
        return self.spark.read.schema(PROGRESS).json(self.path)


def streams(progress: DataFrame, every_seconds: int | None = None) -> DataFrame:
    """A row a query: state (running, waiting, stopped, failed), last trigger, batches and rows of all its runs, next_due_at, last error.

    waiting: the last trigger found nothing. next_due_at is null for queries that have ended and without an interval.
    """
    order = F.struct("at", F.array_position(F.array(*map(F.lit, EVENTS)), F.col("event")))
    trigger = F.col("event").isin("progress", "idle")
    each = progress.groupBy("id").agg(
        F.max_by("event", order).alias("__event"), F.max_by("error", order).alias("error"), F.max(F.when(trigger, F.col("at"))).alias("last_run_at"),
        F.count_if(F.col("event") == "progress").alias("batches"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
    )
    ended = F.col("__event") == "terminated"
    state = F.when(ended & F.col("error").isNotNull(), "failed").when(ended, "stopped").when(F.col("__event") == "idle", "waiting").otherwise("running")
    due = F.when(~ended, F.col("last_run_at") + F.make_dt_interval(secs=F.lit(every_seconds)))
    return each.select("id", state.alias("state"), "last_run_at", "batches", "rows", due.alias("next_due_at"), "error")
