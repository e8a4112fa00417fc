"""Mixing sources to target weights.

Words are summed by source, every source gets a target by its weight, and a
source whose target would repeat it too often gives the excess to the others.
Whole repeats go to every document of a source; the rest of its target is
filled in the order of a hash, up to a cut found with nested hash histograms.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, hash_key, materialize, nested_cuts, small_side, table

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(sources: DataFrame) -> DataFrame:
    """Add pos: place of the source by code point from 0, null last; no table-wide sort in one task."""
    parts = max(1, int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialize(sources.repartitionByRange(parts, F.col("grp").asc_nulls_last()).withColumn("pid", F.spark_partition_id()))
    before = ranged.groupBy("pid").agg(F.count("*").alias("n")).withColumn(
        "skip", F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.row_number().over(Window.partitionBy("pid").orderBy(F.col("grp").asc_nulls_last())) - 1
    return ranged.withColumn("local", local).join(before.select("pid", "skip"), "pid").select("grp", "source_size", (F.col("local") + F.col("skip")).cast("long").alias("pos"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> tuple[DataFrame, int]:
    """(grp, source_size, target) per source and the number of sources.

    All words are shared out by weight.  A target stops at ``max_repeat`` times
    its source's size; the excess is shared again until none is above.  Each
    round is one aggregate over the sources.
    """
    ranked = ranked_sources(sizes.groupBy("grp").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(max_repeat)))
    total = ranked.agg(F.sum("source_size").alias("t"), F.count("*").alias("n")).first()
    groups, total = int(total["n"]), int(total["t"] or 0)
    level = None  # words per unit of weight
    while groups:
        capped = F.lit(False) if level is None else F.col("limit") <= F.col("weight") * F.lit(level)
        row = ranked.agg(F.sum(F.when(capped, F.col("limit"))).alias("used"), F.sum(F.when(~capped, F.col("weight"))).alias("w")).first()
        if not row["w"]:
            break
        now = float(total - (row["used"] or 0)) / float(row["w"])
        if level is not None and now <= level:
            break
        level = now
    target = F.least(F.col("limit").cast("double"), F.col("weight").cast("double") * F.lit(float(level or 0.0)))
    return ranked.select("grp", "source_size", target.alias("target")), groups


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    return materialize(docs.select(F.col("source").alias("grp"), count_words(F.col("text")).alias("size"), hash_key(F.col("doc_id")).alias("key"), *more))


def mix_plan(sizes: DataFrame, weights: tuple[float, ...], max_repeat: float) -> tuple[DataFrame, int]:
    """grp, source_size, target, full (copies of every document), cut (key up to which one more is taken)."""
    targets, groups = source_targets(sizes, weights, max_repeat)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("full", full)
    budgets = targets.select("grp", (F.col("target") - F.col("full") * F.col("source_size")).alias("budget"))
    cuts = nested_cuts(sizes.filter("size > 0").select("grp", "key", F.col("size").alias("weight")), budgets, groups)
    joined = targets.alias("t").join(cuts.alias("c"), F.col("t.grp").eqNullSafe(F.col("c.grp")), "left")
    return materialize(joined.select("t.*", F.coalesce("c.cut", F.lit(-1)).alias("cut"))), groups


def _copies() -> Column:
    return F.col("p.full") + (F.col("d.key") <= F.col("p.cut")).cast("long")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies per document.

    Null text: size 0, nothing taken.  Null source: a source of its own, placed
    last.  Documents with equal doc_id and source share a hash and are taken or
    left together.  Other columns of docs are ignored, whatever their names; an
    empty table gives no rows.
    """
    sizes = sized(docs, F.col("doc_id"))
    plan, groups = mix_plan(sizes, weights, max_repeat)
    out = sizes.alias("d").join(small_side(plan, groups).alias("p"), F.col("d.grp").eqNullSafe(F.col("p.grp")))
    return out.select("d.doc_id", "d.size", "p.source_size", "p.target", (F.col("d.size") * _copies()).alias("taken"), _copies().alias("copies"))


def query(spark, sf_dir):
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark, docs, sf_dir):
    """Every document as many times as the mix takes it, in the columns of docs.

    The mix is decided on doc_id, source and word count; the texts are read
    again beside the small table of cuts, so they cross no shuffle while the
    number of sources stays within the checked bound.
    """
    names = docs.columns
    plan, groups = mix_plan(sized(docs), WEIGHTS, MAX_REPEAT)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("source").alias("grp"), hash_key(F.col("doc_id")).alias("key"), (F.trim(F.translate(F.col("text"), "\t\n\x0b\x0c\r", "     ")) != "").alias("some"))
    out = rows.alias("d").join(small_side(plan, groups).alias("p"), F.col("d.grp").eqNullSafe(F.col("p.grp")))
    copies = F.when(F.col("some"), _copies()).otherwise(0).cast("int")
    return out.select("d.row", F.explode(F.array_repeat(F.lit(1), copies))).select(*[F.col(f"row.`{c}`").alias(c) for c in names])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source),
c AS (
  SELECT *, row_number() OVER w AS place, sum(3 * source_size) OVER w AS capped, sum(weight) OVER w AS capped_weight,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS total_weight
  FROM s WINDOW w AS (ORDER BY 3 * source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f AS (
  SELECT *, (total - (capped - 3 * source_size))::DOUBLE / (total_weight - (capped_weight - weight))::DOUBLE AS level FROM c),
l AS (SELECT arg_min(level, place) AS level FROM f WHERE level * weight <= 3 * source_size),
t AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, weight::DOUBLE * coalesce(l.level, 0.0)) AS target FROM f, l),
u AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.doc_id, d.size, u.source_size, u.target, u.whole, target - whole * source_size AS budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY d.source, key) AS own
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN upto <= budget OR 2 * upto - own <= 2 * budget THEN 1 ELSE 0 END)::BIGINT AS taken
FROM r
"""
