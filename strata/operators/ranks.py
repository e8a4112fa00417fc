"""Ranks and trailing means over a whole table without a window in a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def global_rank(df: DataFrame, value: str, name: str, ranges: int = 64) -> DataFrame:
    """Add the rank by falling value, ties alike.

    Rows are dealt to ranges of values by quantiles, ranked within their range,
    and moved by the number of rows in the ranges above; equal values share a
    range.  Bounds that are off make ranges uneven, not ranks wrong.
    """
    edges = df.agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)] or [0.5], 1000).alias("__edges"))  # one row
    dealt = df.crossJoin(F.broadcast(edges)).withColumn("__range", F.size(F.filter("__edges", lambda b: b >= F.col(value)))).drop("__edges")
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))  # as many rows as ranges
    above = sizes.withColumn("__above", F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))).drop("__n")
    local = F.rank().over(Window.partitionBy("__range").orderBy(F.col(value).desc()))
    out = dealt.withColumn(name, local).join(F.broadcast(above), "__range")
    return out.withColumn(name, (F.col(name) + F.coalesce("__above", F.lit(0))).cast("long")).drop("__range", "__above")
