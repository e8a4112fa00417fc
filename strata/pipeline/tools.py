"""Looking at tables, comparing versions, timing, exporting datasets: ``python -m strata.pipeline.tools`` inspects a table."""

from __future__ import annotations

import argparse
import statistics
import time
from collections.abc import Callable, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins
from ..operators.control import worth_compacting
from ..sources.lake import LakeTable
from ..sources.storage import Storage
from ..sources.tabular import table_reference, to_markdown, write_csv
from . import audit, checks

LAYERS = ("bronze", "silver", "silver/_quarantine")


def tables(spark: SparkSession, root: str) -> list[str]:
    """Names of all versioned tables below a lake's folder: those that have a log."""
    return sorted({f.partition("/_log/")[0] for f, _ in Storage(spark, root).files() if "/_log/" in f})


def columns(df: DataFrame) -> DataFrame:
    """Name, type and place of every column."""
    rows = [(f.name, f.dataType.simpleString(), k) for k, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "column_name string, data_type string, position int")


def key_changes(table: LakeTable, key: str, old: int, new: int) -> DataFrame:
    """Keys that one version has and the other lacks: added and missing."""
    a, b = (table.df(version=v).select(key).distinct() for v in (old, new))
    return b.subtract(a).withColumn("change", F.lit("added")).unionByName(a.subtract(b).withColumn("change", F.lit("missing")))


def change_summary(table: LakeTable, start: int, end: int | None = None) -> DataFrame:
    return table.changes(start, end).groupBy("_commit_version", "_change_type").agg(F.count("*").alias("rows")).orderBy("_commit_version", "_change_type")


def partition_sizes(df: DataFrame) -> DataFrame:
    """One row: rows in all, in the largest and in the median partition that has any."""
    per = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("total"), F.max("n").alias("largest"), F.percentile("n", 0.5).alias("median"))


def maintain(table: LakeTable, keep_seconds: float = 7 * 86400, dry_run: bool = False) -> dict:
    """Compact a table that is worth it, then drop files that no kept version needs."""
    sizes = [f["bytes"] for f in table._state()[0].values()]
    compacted = worth_compacting(sizes) and table.optimize(small_bytes=1 << 60).version is not None
    return {"files": len(sizes), "compacted": compacted, "dropped": len(table.vacuum(keep_seconds, dry_run))}


# --- timing ----------------------------------------------------------------------


def timed(run: Callable[[], object], repeats: int = 3, warmup: int = 1, clock: Callable[[], float] = time.perf_counter) -> dict[str, float]:
    """Least, median and most seconds of a call, after calls that do not count."""
    for _ in range(warmup):
        run()
    took = []
    for _ in range(repeats):
        start = clock()
        run()
        took.append(clock() - start)
    return {"min": min(took), "median": statistics.median(took), "max": max(took)}


@contextmanager
def conf(spark: SparkSession, **settings):
    """Session settings (with '__' for '.') that hold inside the block only."""
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def compare_skew_joins(spark: SparkSession, big: DataFrame, small: DataFrame, key: str, salts: int = 8, repeats: int = 1) -> list[dict]:
    """A plain, a broadcast, a salted and an adaptively split join of the same sides: seconds and rows, which must agree."""
    off = dict(spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1")
    split = dict(spark__sql__adaptive__enabled="true", spark__sql__adaptive__skewJoin__enabled="true", spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="1m", spark__sql__adaptive__skewJoin__skewedPartitionFactor="2", spark__sql__adaptive__advisoryPartitionSizeInBytes="1m")
    ways = {"plain": (off, lambda: joins.merge_join(big, small, key)), "broadcast": ({}, lambda: joins.small_join(big, small, key)), "salted": (off, lambda: joins.salted(big, small, key, salts)), "adaptive": (split, lambda: joins.merge_join(big, small, key))}
    out = []
    for name, (settings, join) in ways.items():
        with conf(spark, **settings):
            out.append({"way": name, "rows": join().count()} | timed(lambda join=join: join().write.format("noop").mode("overwrite").save(), repeats, 0))
    if len({r["rows"] for r in out}) != 1:
        raise RuntimeError(f"the joins disagree: {out}")
    return out


# --- datasets of the dashboard -----------------------------------------------------

TOP = 20
MODELS = {
    "kpi_monthly": lambda m: m["agg_monthly_kpis"].withColumn("month", F.date_format("month", "yyyy-MM")).orderBy("month"),
    "daily_sales": lambda m: m["agg_daily_sales"].withColumn("avg_order_value", F.round((F.col("revenue") / F.nullif(F.col("orders"), F.lit(0))).cast("decimal(38,6)"), 2).cast("double")).orderBy("date_day"),
    "customer_retention": lambda m: m["agg_customer_retention"].withColumn("cohort_month", F.date_format("cohort_month", "yyyy-MM")).orderBy("cohort_month", "months_since_first"),
    "product_sales_top": lambda m: m["agg_product_sales"].orderBy("revenue_rank", "product_id").limit(TOP),
    "category_revenue": lambda m: m["agg_category_revenue"].orderBy(F.desc("revenue"), "category"),
    "customer_versions_examples": lambda m: _examples(m["dim_customer"]),
    "fact_orders_sample": lambda m: m["fact_orders"].select("order_id", "order_item_id", "date_key", "order_status", "purchased_at", "price", "freight", "delivery_days", "is_late", "order_item_key").orderBy(F.desc("purchased_at"), "order_item_key").limit(TOP),
}
#: steps: latest events of steps; results: the check log (id, run_id, check_name, category, status, rows_failed, detail); rejected and drift: their logs.
OPERATIONS = {
    "flow_runs": lambda o: audit.flow_runs(o["steps"]).withColumn("error", F.left("error", F.lit(300))).orderBy(F.desc("started"), "run_id").limit(200),
    "task_runs": lambda o: o["steps"].filter("level = 'task'").select("run_id", "name", "status", "started", "seconds", "retry", "step_id").orderBy(F.desc("started"), "step_id").limit(1000),
    "task_stats": lambda o: audit.task_stats(o["steps"]).orderBy("task_name"),
    "table_loads_latest": lambda o: _of_last(o["steps"].filter("level = 'table'"), o["steps"].filter("level = 'flow'"), "started").select("name", "table_name", "rows_read", "inserted", "updated", "rejected", "seconds", "status", "seq").orderBy("seq"),
    "dq_scorecard": lambda o: checks.scorecard(o["results"]).orderBy(F.desc("run_id")).limit(100),
    "dq_by_category_latest": lambda o: checks.scorecard(_of_last(o["results"], o["results"], "id"), "category").orderBy("category"),
    "dq_checks_latest": lambda o: checks.sorted_worst_first(checks.latest_results(_of_last(o["results"], o["results"], "id"))),
    "rejected_records": lambda o: o["rejected"].orderBy(F.desc("at"), "table_name", "rule").limit(200),
    "schema_changes": lambda o: o["drift"].orderBy(F.desc("at"), "table_name", "column").limit(50),
}


def _examples(dim_customer: DataFrame) -> DataFrame:
    many = dim_customer.groupBy("customer_id").agg(F.count("*").alias("n")).filter("n > 1").orderBy("customer_id").limit(TOP // 2)
    return dim_customer.join(F.broadcast(many), "customer_id", "left_semi").orderBy("customer_id", "valid_from")


def _of_last(df: DataFrame, runs: DataFrame, by: str) -> DataFrame:
    """Rows of the last run."""
    return df.join(F.broadcast(runs.orderBy(F.desc(by), "run_id").limit(1).select("run_id")), "run_id", "left_semi")


def export(frames: Mapping[str, DataFrame], folder: str) -> str:
    """Each dataset as CSV; the text is a Markdown page with row counts and first rows."""
    page = []
    for name, df in frames.items():
        write_csv(df, f"{folder}/{name}")
        back = df.sparkSession.read.option("header", True).csv(f"{folder}/{name}")
        page.append(f"## {name}\n\n{back.count()} rows\n\n{to_markdown(back, 5)}\n")
    return "\n".join(page)


def load_exports(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All CSV datasets of a folder by name."""
    names = sorted({f.split("/")[0] for f, _ in Storage(spark, folder).files() if f.endswith(".csv")})
    return {n: spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/{n}") for n in names}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    parser = argparse.ArgumentParser(description="Look at a versioned table.")
    parser.add_argument("root")
    parser.add_argument("table", help="bronze/<name> or silver/<name>")
    parser.add_argument("what", choices=("history", "as-of", "changes"))
    parser.add_argument("--version", type=int)
    parser.add_argument("--since", type=int, default=1)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    t = LakeTable(spark, f"{args.root}/{'/'.join(table_reference(args.table))}")
    df = t.history() if args.what == "history" else t.df(version=args.version) if args.what == "as-of" else change_summary(t, args.since)
    text = to_markdown(df)
    print(text)
    return text


if __name__ == "__main__":
    main()
