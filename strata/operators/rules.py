"""Named validation rules, the split into valid and rejected rows, and reports on what was rejected."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.scalars import never_null


@dataclass(frozen=True)
class Rule:
    """A valid row meets ``holds``; false and null break the rule."""

    name: str
    holds: Column


def required(*names: str) -> list[Rule]:
    return [Rule(f"not_null:{n}", F.col(n).isNotNull()) for n in names]


def one_of(name: str, values: Sequence) -> Rule:
    """The value is among ``values``; null passes."""
    return Rule(f"accepted:{name}", F.col(name).isNull() | F.col(name).isin(list(values)))


def readable_as(name: str, kind: str) -> Rule:
    """The value can be read as a type; null passes."""
    return Rule(f"type:{name}:{kind}", F.col(name).isNull() | F.col(name).try_cast(kind).isNotNull())


def that(name: str, condition: str | Column) -> Rule:
    return Rule(name, F.expr(condition) if isinstance(condition, str) else condition)


def number(name: str) -> Column:
    """A column as a number, null where it is none, also under ANSI rules."""
    return F.col(name).try_cast("double")


def trim_strings(df: DataFrame) -> DataFrame:
    """Spaces at both ends of every string column go; tabs stay."""
    return df.withColumns({f.name: F.trim(F.col(f"`{f.name}`")) for f in df.schema if isinstance(f.dataType, StringType)})


def apply_rules(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with failed_rules (in rule order) and reason.  Both read one marked plan."""
    broken = [F.when(~never_null(r.holds), F.lit(r.name)) for r in rules]
    failed = F.array_compact(F.array(*broken)) if rules else F.array().cast("array<string>")
    marked = df.withColumn("failed_rules", failed)
    valid = marked.filter(F.size("failed_rules") == 0).drop("failed_rules")
    return valid, marked.filter(F.size("failed_rules") > 0).withColumn("reason", F.array_join("failed_rules", ", "))


def split_valid(df: DataFrame, keys: Sequence[str], condition: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with all keys that meet the condition, and the others."""
    ok = F.lit(True)
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    ok = never_null(ok & F.expr(condition)) if condition else ok
    return df.filter(ok), df.filter(~ok)


def failure_counts(rejected: DataFrame) -> DataFrame:
    return rejected.select(F.explode("failed_rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("rows"))


def breaking_rows(rejected: DataFrame, rule: str) -> DataFrame:
    """Rejected rows that break one rule, whatever else they break."""
    return rejected.filter(F.array_contains("failed_rules", rule))


def failure_samples(rejected: DataFrame, keys: Sequence[str], per_rule: int = 5) -> DataFrame:
    """rule, rows, sample: the first keys by value of each rule, in one job."""
    key = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("NULL"))) for k in keys])
    hits = rejected.select(F.explode("failed_rules").alias("rule"), key.alias("k")).groupBy("rule", "k").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    placed = hits.withColumn("place", F.row_number().over(Window.partitionBy("rule").orderBy("k")))
    return placed.groupBy("rule").agg(F.sum("n").alias("rows"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("place") <= per_rule, F.col("k")))), "; ").alias("sample"))
