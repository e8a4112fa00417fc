"""Latest versions, comparison of batches with targets, and reconciliation of layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by ``order``, column after column; further columns break ties by value."""
    rest = [c for c, t in df.dtypes if c not in {*keys, *order} and not t.startswith(("map", "variant"))]
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in [*order, *rest]])
    return df.withColumn("__place", F.row_number().over(w)).filter("__place = 1").drop("__place")


def version_classes(batch: DataFrame, target: DataFrame | None, keys: Sequence[str], version: str) -> DataFrame:
    """One row: new, newer, same and late rows of a batch against the target."""
    if target is None:
        return batch.agg(F.count("*").alias("new"), *[F.lit(0).cast("long").alias(n) for n in ("newer", "same", "late")])
    t = target.select(*keys, F.col(version).alias("__held"))
    v, held = F.col(version), F.col("__held")
    return batch.select(*keys, version).join(t, list(keys), "left").agg(
        F.count_if(held.isNull()).alias("new"), F.count_if(v > held).alias("newer"), F.count_if(v == held).alias("same"), F.count_if(v < held).alias("late"))


def reconciled(source: DataFrame, silver: DataFrame, quarantine: DataFrame | None, key: str, version: str) -> DataFrame:
    """One row of counts per fate of the source's keys.

    The quarantine is read once, grouped by key into whether a version was
    rejected at all and which ones were.
    """
    src = source.groupBy(key).agg(F.max(version).alias("s"))
    held = silver.select(key, F.col(version).alias("h"))
    out = src.join(held, key, "left")
    if quarantine is None:
        out = out.withColumn("q", F.lit(False)).withColumn("explained", F.lit(False))
    else:
        q = quarantine.select(key, F.col(version).alias("v")).distinct().join(src, key).groupBy(key).agg(F.lit(True).alias("q"), F.max(F.col("v") == F.col("s")).alias("explained"))
        out = out.join(q, key, "left").fillna(False, ["q", "explained"])
    has, stale = F.col("h").isNotNull(), F.col("h") < F.col("s")
    return out.agg(
        F.count("*").alias("source"), F.count_if(has).alias("in_silver"), F.count_if(~has & F.col("q")).alias("quarantined_only"), F.count_if(~has & ~F.col("q")).alias("missing"),
        F.count_if(stale & F.col("explained")).alias("stale_explained"), F.count_if(stale & ~F.col("explained")).alias("stale_unexplained"), F.count_if(F.col("h") > F.col("s")).alias("ahead"))


def validity(df: DataFrame, keys: Sequence[str], version: str, end: Column) -> DataFrame:
    """Versions as ranges: valid_from, valid_to (the next version's start or ``end``) and is_current."""
    following = F.lead(version).over(Window.partitionBy(*keys).orderBy(version))
    return df.withColumn("valid_from", F.col(version)).withColumn("valid_to", F.coalesce(following, end)).withColumn("is_current", following.isNull())


def snapshot(current: DataFrame, incoming: DataFrame, key: str, version: str, columns: Sequence[str]) -> DataFrame:
    """History after a snapshot by timestamp: new keys open, newer versions close the open row and open another, else nothing.

    current: key, version, columns, valid_from, valid_to (null while open), scd_id.
    """
    opening = current.filter("valid_to is null").select(key, F.col(version).alias("__v"))
    fresh = incoming.select(key, version, *columns).join(opening, key, "left").filter(F.col("__v").isNull() | (F.col(version) > F.col("__v"))).drop("__v")
    ends = fresh.select(key, F.col(version).alias("__end"))
    closed = current.join(ends, key, "left").withColumn("valid_to", F.coalesce("valid_to", "__end")).drop("__end")
    opened = fresh.withColumn("valid_from", F.col(version)).withColumn("valid_to", F.lit(None).cast(current.schema["valid_to"].dataType)).withColumn("scd_id", F.md5(F.concat(F.col(key).cast("string"), F.lit("|"), F.col(version).cast("string"))))
    return closed.unionByName(opened.select(*closed.columns))


def changed_or_missing(rows: DataFrame, existing: DataFrame, key: str, version: str) -> DataFrame:
    """Rows at or past the newest version held, and rows whose key is not held.  First run: all."""
    top = existing.agg(F.max(version).alias("__top"))
    held = existing.select(key).distinct().withColumn("__held", F.lit(True))
    out = rows.join(held, key, "left").crossJoin(F.broadcast(top))  # a single row
    return out.filter(F.col("__held").isNull() | F.col("__top").isNull() | (F.col(version) >= F.col("__top"))).drop("__held", "__top")


def replaced(existing: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """Delete the selected keys, then insert the selected rows."""
    return existing.join(selected.select(key).distinct(), key, "left_anti").unionByName(selected, allowMissingColumns=True)
