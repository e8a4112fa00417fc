"""Data quality checks: tests that give the rows which break them, and records of PASS, WARN or FAIL."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import money
from ..operators import versions

#: Categories of tests by what they are called, the longest name first; hours between runs; cents.
CATEGORIES = {"unique_combination": "uniqueness", "accepted_values": "validity", "non_negative": "validity", "relationships": "referential_integrity", "not_null": "completeness", "unique": "uniqueness"}
OUTCOMES = {"pass": "PASS", "warn": "WARN", "fail": "FAIL", "error": "FAIL", "runtime error": "FAIL"}
MOST_GAP_HOURS = 26
TOLERANCE = 0.01
RESULT = "check_name string, category string, status string, rows_failed long, detail string"


def category_of(name: str) -> str:
    """Category of a test by its name; a test of its own is a business rule."""
    plain = name.removeprefix("source_")
    return next((c for kind, c in CATEGORIES.items() if plain.startswith(f"{kind}_")), "business_rule")


# --- tests: the rows that break them ------------------------------------------


def unique(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n")).filter("n > 1")


def not_null(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNull())


def accepted_values(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    return df.filter(F.col(col).isNotNull() & ~F.col(col).isin(list(values)))


def relationships(df: DataFrame, col: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose value is in no parent row; null has no parent to miss."""
    return df.filter(F.col(col).isNotNull()).join(parent.select(F.col(key).alias("__parent")).distinct(), F.col(col) == F.col("__parent"), "left_anti")


def non_negative(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col) < 0)


@dataclass(frozen=True)
class Check:
    """A one-row frame (rows_failed, detail) under a name; a check that is not critical can only warn."""

    name: str
    category: str
    frame: DataFrame
    critical: bool = True


def breaking(name: str, rows: DataFrame, critical: bool = True, category: str | None = None) -> Check:
    """A check that fails with the rows of a test."""
    return Check(name, category or category_of(name), rows.agg(F.count("*").alias("rows_failed")).withColumn("detail", F.lit("")), critical)


def difference(name: str, left: tuple[str, DataFrame], right: tuple[str, DataFrame], critical: bool = True, tolerance: float = 0.0) -> Check:
    """A check that two one-row, one-column frames hold the same, within a tolerance; null counts as 0."""
    one, two = (df.toDF(side).select(F.coalesce(F.col(side).cast("double"), F.lit(0.0)).alias(side)) for side, (_, df) in zip("ab", (left, right), strict=True))
    off = F.abs(F.col("a") - F.col("b"))
    failed = F.when(off > tolerance, F.greatest(F.floor(off), F.lit(1))).otherwise(0).cast("long")
    detail = F.format_string(f"{left[0]}=%.2f {right[0]}=%.2f", "a", "b")
    return Check(name, "reconciliation", one.crossJoin(two).select(failed.alias("rows_failed"), detail.alias("detail")), critical)


def record(checks: Sequence[Check]) -> DataFrame:
    """A row for each check: all are worked out in one query."""
    def row(c: Check) -> DataFrame:
        status = F.when(F.col("rows_failed") == 0, "PASS").otherwise("FAIL" if c.critical else "WARN")
        return c.frame.select(F.lit(c.name).alias("check_name"), F.lit(c.category).alias("category"), status.alias("status"), F.col("rows_failed").cast("long").alias("rows_failed"), "detail")

    return reduce(DataFrame.unionByName, map(row, checks))


def freshness(flows: DataFrame, flow: str, run_id: str, now: Column) -> Check:
    """Hours since the flow's last success before this run; without one there is nothing to miss."""
    last = flows.filter((F.col("flow_name") == flow) & (F.col("status") == "SUCCESS") & (F.col("run_id") != run_id)).agg(F.max("at").alias("at"))
    hours = (now - F.col("at")) / 3600
    frame = last.select(F.when(hours > MOST_GAP_HOURS, 1).otherwise(0).alias("rows_failed"), F.coalesce(F.format_string("hours=%.1f", hours), F.lit("no earlier success")).alias("detail"))
    return Check("pipeline_previous_success_recent", "freshness", frame, False)


def pipeline_checks(bronze: DataFrame, silver: DataFrame, quarantine: DataFrame | None, source: DataFrame, staging_rows: DataFrame, items: DataFrame, fact: DataFrame, metrics: dict[str, tuple[DataFrame, DataFrame, DataFrame]], fresh: Check, key: str, version: str) -> list[Check]:
    """The pipeline's 14 checks; metrics: name to one-value frames of source, staging and Gold."""
    r = versions.reconciled(source, silver, quarantine, key, version)
    shown = F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in r.columns])
    rows = lambda df: df.agg(F.count("*"))
    out = [
        breaking("bronze_no_duplicate_versions", unique(bronze, key, version), category="uniqueness"),
        Check("source_keys_in_silver_or_quarantine", "reconciliation", r.select(F.col("missing").alias("rows_failed"), shown.alias("detail"))),
        Check("silver_versions_newest_or_explained", "reconciliation", r.select((F.col("stale_unexplained") + F.col("ahead")).alias("rows_failed"), shown.alias("detail")), False),
        breaking("silver_unique_key", unique(silver, key), category="uniqueness"),
        difference("silver_vs_staging_rows", ("silver", rows(silver)), ("staging", rows(staging_rows))),
        breaking("fact_no_null_customer_key", not_null(fact, "customer_key"), category="completeness"),
        difference("items_vs_fact", ("items", rows(items)), ("fact", rows(fact)), False)]
    for name, (src, staging, gold) in metrics.items():
        out += [difference(f"{name}_staging_vs_gold", ("staging", staging), ("gold", gold), True, TOLERANCE), difference(f"{name}_source_vs_gold", ("source", src), ("gold", gold), False, TOLERANCE)]
    return [*out, fresh]


# --- the log -------------------------------------------------------------------


def latest_results(log: DataFrame) -> DataFrame:
    """Of a check that a run recorded several times, the last one; log: id, run_id, check_name, category, status."""
    place = F.row_number().over(Window.partitionBy("run_id", "check_name").orderBy(F.col("id").desc()))
    return log.withColumn("__place", place).filter("__place = 1").drop("__place")


def scorecard(log: DataFrame, *by: str) -> DataFrame:
    """Checks, outcomes, pass rate and health (a warning counts half), per run or per ``by``."""
    n = {s: F.count_if(F.col("status") == s) for s in ("PASS", "WARN", "FAIL")}
    total = F.nullif(F.count("*"), F.lit(0))
    return latest_results(log).groupBy(*(by or ("run_id",))).agg(
        F.count("*").alias("checks"), n["PASS"].alias("passed"), n["WARN"].alias("warned"), n["FAIL"].alias("failed"),
        money(100.0 * n["PASS"].cast("double") / total, 1).alias("pass_rate"), money(100.0 * (n["PASS"] + 0.5 * n["WARN"]).cast("double") / total, 1).alias("health_score"))


def test_results(spark: SparkSession, text: str) -> DataFrame:
    """Rows from a test runner's JSON: {"results": [{"unique_id", "status", "failures", "message"}]}; models are left out."""
    rows = []
    for r in json.loads(text)["results"]:
        kind, _, name, *_ = [*r["unique_id"].split("."), "", "", ""]
        if kind == "test":
            rows.append((name, category_of(name), OUTCOMES[r["status"]], int(r.get("failures") or 0), r.get("message") or ""))
    return spark.createDataFrame(rows, RESULT)


def source_freshness(spark: SparkSession, text: str) -> DataFrame:
    """Rows from a freshness report: {"results": [{"unique_id", "status", "max_loaded_at"}]}."""
    rows = [(f"freshness_{r['unique_id'].split('.')[-1]}", "freshness", OUTCOMES[r["status"]], int(r["status"] != "pass"), f"newest={r.get('max_loaded_at')}") for r in json.loads(text)["results"]]
    return spark.createDataFrame(rows, RESULT)


def sorted_worst_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("status") != "FAIL", F.col("status") != "WARN", "category", "check_name")


AlertHook = Callable[[str, str], None]
