"""Audit log: what ran, with which counts, from what to what; best effort, so it never stops the work.

Each state of a step is an event; the latest event of a step is what it is now.
"""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import money
from ..sources.lake import Commit, LakeTable

EVENTS = ("seq long, step_id string, run_id string, level string, name string, table_name string, status string, at double, started double, retry int, "
          "rows_read long, inserted long, updated long, rejected long, error string")
LINEAGE = "run_id string, step_id string, source string, target string, version long, at double"
BAD = ("FAILED", "ABANDONED")
MOST_ERROR = 4000


class JsonLog(logging.Formatter):
    """Log lines as JSON with the run and step they belong to."""

    def __init__(self, run_id: str, step: str | None = None):
        super().__init__()
        self.context = {"run_id": run_id, "step": step}

    def format(self, record):
        line = {"level": record.levelname, "logger": record.name, "message": record.getMessage()} | self.context
        return json.dumps(line | ({"error": self.formatException(record.exc_info)} if record.exc_info else {}))


def batch_id(table: str, now: datetime) -> str:
    """A name for a batch that sorts by time and is never given twice."""
    return f"{table}-{now:%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"


@dataclass
class Step:
    """Counts that a step reports."""

    step_id: str
    read: int = 0
    inserted: int = 0
    updated: int = 0
    rejected: int = 0
    lineage: list[tuple[str, str, int | None]] = field(default_factory=list)

    def wrote(self, commit: Commit) -> None:
        """Add a commit's counts; a commit that was not needed adds nothing."""
        if commit.version is not None:
            self.inserted += commit.inserted
            self.updated += commit.updated


class AuditLog:
    def __init__(self, spark, path: str, run_id: str, clock: Callable[[], float] = time.time, append: Callable[[str, list[tuple], str], None] | None = None):
        self.spark, self.path, self.run_id, self.clock = spark, path, run_id, clock
        self._append = append or self._to_table
        self._seq = 0

    def _to_table(self, name: str, rows: list[tuple], schema: str) -> None:
        t, df = LakeTable(self.spark, f"{self.path}/{name}"), self.spark.createDataFrame(rows, schema)
        t.append(df) if t.exists() else t.create(df)

    def _tell(self, name: str, rows: list[tuple], schema: str) -> None:
        try:
            self._append(name, rows, schema)
        except Exception:
            logging.getLogger(__name__).warning("an audit row was lost", exc_info=True)

    def _event(self, step: Step, level: str, name: str, table: str | None, status: str, started: float, retry: int, error: str | None = None) -> None:
        self._seq += 1
        now = self.clock()
        self._tell("events", [(int(now * 1e6) + self._seq, step.step_id, self.run_id, level, name, table, status, now, started, retry, step.read, step.inserted, step.updated, step.rejected, error and error[:MOST_ERROR])], EVENTS)

    @contextmanager
    def step(self, name: str, table: str | None = None, level: str = "task", retry: int = 0) -> Iterator[Step]:
        """A step that is RUNNING, then SUCCESS or FAILED; the body's error goes on, an error of the log does not."""
        step, started = Step(uuid.uuid4().hex), self.clock()
        self._event(step, level, name, table, "RUNNING", started, retry)
        try:
            yield step
        except BaseException as e:
            self._event(step, level, name, table, "FAILED", started, retry, f"{type(e).__name__}: {e}")
            raise
        self._event(step, level, name, table, "SUCCESS", started, retry)
        if step.lineage:
            self._tell("lineage", [(self.run_id, step.step_id, s, t, v, self.clock()) for s, t, v in step.lineage], LINEAGE)

    def events(self) -> DataFrame:
        return LakeTable(self.spark, f"{self.path}/events").df()

    def abandon(self, older_than_seconds: float) -> int:
        """Close steps that have been running for too long, as their processes are gone; how many."""
        stale = latest_events(self.events()).filter((F.col("status") == "RUNNING") & (F.col("started") < self.clock() - older_than_seconds))
        rows = stale.withColumn("status", F.lit("ABANDONED")).withColumn("at", F.lit(self.clock())).withColumn("seq", F.col("seq") + 1).drop("seconds")
        return LakeTable(self.spark, f"{self.path}/events").append(rows).inserted


def latest_events(events: DataFrame) -> DataFrame:
    """The last event of every step, with its duration where it ended."""
    place = F.row_number().over(Window.partitionBy("step_id").orderBy(F.col("seq").desc()))
    return events.withColumn("__place", place).filter("__place = 1").drop("__place").withColumn("seconds", F.when(F.col("status") != "RUNNING", F.col("at") - F.col("started")))


def _bad(status: Column) -> Column:
    return status.isin(*BAD)


def flow_runs(steps: DataFrame) -> DataFrame:
    """One row per flow: attempts, failures, retries, the first failed task, the tasks that succeeded in order, rows moved."""
    tasks = steps.filter("level = 'task'").groupBy("run_id").agg(
        F.count("*").alias("task_attempts"), F.count_if(_bad(F.col("status"))).alias("failed_attempts"), F.count_if(F.col("retry") > 0).alias("retried_attempts"),
        F.min_by(F.when(_bad(F.col("status")), F.col("name")), F.when(_bad(F.col("status")), F.col("seq"))).alias("first_failed_task"),
        F.expr("listagg(name, ' > ') within group (order by seq) filter (where status = 'SUCCESS')").alias("steps_succeeded"))
    moved = steps.filter("level = 'table'").groupBy("run_id").agg(*[F.sum(c).alias(f"rows_{c}") for c in ("inserted", "updated", "rejected")])
    flows = steps.filter("level = 'flow'").select("run_id", F.col("name").alias("flow_name"), "status", "started", "at", "seconds", "error")
    return flows.join(tasks, "run_id", "left").join(moved, "run_id", "left").fillna(0, ["task_attempts", "failed_attempts", "retried_attempts", "rows_inserted", "rows_updated", "rows_rejected"])


def task_stats(steps: DataFrame) -> DataFrame:
    """One row per task: attempts, successes and failures, times of successes, the last status."""
    good = F.when(F.col("status") == "SUCCESS", F.col("seconds"))
    wins = F.count_if(F.col("status") == "SUCCESS")
    return steps.filter("level = 'task'").groupBy(F.col("name").alias("task_name")).agg(
        F.count("*").alias("attempts"), wins.alias("successes"), F.count_if(_bad(F.col("status"))).alias("failures"),
        money(100.0 * wins.cast("double") / F.count("*"), 1).alias("success_rate"), money(F.avg(good), 1).alias("avg_seconds"),
        money(F.percentile(good, 0.5), 1).alias("median_seconds"), money(F.percentile(good, 0.95), 1).alias("p95_seconds"), money(F.max(good), 1).alias("max_seconds"),
        F.max("started").alias("last_start"), F.max_by("status", "seq").alias("last_status"))


def run_stats(flows: DataFrame) -> DataFrame:
    """One row: ended runs, share of successes, median minutes, last status; running ones do not count."""
    ended = flows.filter("status <> 'RUNNING'")
    return ended.agg(F.count("*").alias("runs"), money(100.0 * F.count_if(F.col("status") == "SUCCESS").cast("double") / F.nullif(F.count("*"), F.lit(0)), 1).alias("success_pct"),
                     money(F.percentile("seconds", 0.5) / 60, 1).alias("median_minutes"), F.max_by("status", "started").alias("last_status"))


def rejections(log: DataFrame) -> DataFrame:
    """Per table and rule: rows, runs, the last sample; log: at, run_id, table_name, rule, rows, sample."""
    return log.groupBy("table_name", "rule").agg(F.sum("rows").alias("rows"), F.count_distinct("run_id").alias("runs"), F.max_by("sample", "at").alias("last_sample"))


def recent_durations(steps: DataFrame, flows: int = 15) -> DataFrame:
    """Task durations of the last flows, each labelled by its start."""
    last = steps.filter("level = 'flow'").orderBy(F.desc("started"), "run_id").limit(flows).select("run_id", F.date_format(F.timestamp_seconds("started"), "MM-dd HH:mm").alias("run"))
    return steps.filter("level = 'task' and seconds is not null").join(last, "run_id").select("run", "run_id", F.col("name").alias("task_name"), money(F.col("seconds") / 60, 2).alias("minutes"))
