"""Joins for skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20


def key_shares(df: DataFrame, key: str, top: int = 5) -> DataFrame:
    """The most frequent keys with their share of all rows."""
    counts = df.groupBy(key).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows").alias("total"))
    return counts.orderBy(F.desc("rows"), key).limit(top).crossJoin(F.broadcast(total)).select(key, "rows", (F.col("rows") / F.col("total")).alias("share"))


def salted(big: DataFrame, small: DataFrame, key: str, salts: int, how: str = "inner") -> DataFrame:
    """A join in which a key's rows go to ``salts`` tasks.  The salt is a hash of the row, so reruns agree.

    Each row of the small side goes to every salt, so a join that keeps
    unmatched rows of the small side would keep them several times.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join cannot be {how}")
    plain = [c for c, t in big.dtypes if not t.startswith(("map", "variant"))]
    a = big.withColumn("__salt", F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int"))
    b = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [key, "__salt"], how).drop("__salt")


def small_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast the small side if its plan is of at most ``limit`` bytes, else leave the join to adaptive execution.

    The size is the optimizer's, which it takes from the files and knows without reading a row; it never falls short
    of a filtered scan's.
    """
    size = small._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return big.join(F.broadcast(small) if int(size) <= limit else small, key, how)


def merge_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    return big.join(small.hint("merge"), key, how)


def point_in_time(facts: DataFrame, versions: DataFrame, key: str, at: str) -> DataFrame:
    """Left join with the version valid at a time: valid_from <= at < valid_to."""
    v = versions.alias("v")
    on = (facts[key] == F.col(f"v.{key}")) & (facts[at] >= F.col("v.valid_from")) & (facts[at] < F.col("v.valid_to"))
    return facts.join(v, on, "left").drop(F.col(f"v.{key}"))
