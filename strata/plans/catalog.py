"""All queries by name, each with the SQL that an independent engine runs on the same tables.

``SHARED`` queries are one text for both engines; the others are built from the
library's operators and compared with SQL written on its own.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..models import marts  # noqa: F401  (registers the models)
from ..models.registry import MODELS, build, order
from ..operators import control, joins, rules, versions
from ..pipeline import audit, bronze, checks, silver, tools
from ..pipeline.state import StateStore
from ..sources import tabular
from ..sources.lake import LakeTable

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(text: str):
    """A query over the tables that a text names in braces."""
    used = sorted(set(re.findall(r"\{(\w+)\}", text)))

    def run(spark, sf_dir):
        return spark.sql(text, **{t: load(spark, sf_dir, t) for t in used})

    return run


def _r(x: str, n: int = 2) -> str:
    return f"cast(round(cast({x} as decimal(38,6)), {n}) as double)"


MONTH = "cast(date_trunc('month', {0}) as date)"
LOG = """lg as (select event_id as id, user_id as run_id, event_type as check_name, ts,
    case when event_type = 'error' then 'FAIL' when event_type = 'click' then 'WARN' else 'PASS' end as status, value from {events})"""

#: The same text for both engines.
SHARED = {
    "stg_orders": "select o_orderkey as order_id, o_custkey as customer_id, o_orderstatus as order_status, o_orderdate as purchased_at, o_totalprice as total from {orders}",
    "stg_customers": "select c_custkey as customer_id, c_name as customer_name, c_nationkey as nation_id, c_mktsegment as segment from {customer}",
    "stg_order_items": "select l_orderkey as order_id, l_linenumber as item_id, l_partkey as product_id, l_suppkey as seller_id, l_extendedprice as price, l_extendedprice * l_tax as freight from {lineitem}",
    "stg_payments": "select o_orderkey as order_id, 1 as payment_sequential, o_orderpriority as payment_type, o_totalprice as payment_value from {orders}",
    "stg_sellers": "select s_suppkey as seller_id, s_name as seller_name, s_nationkey as nation_id from {supplier}",
    "stg_products_unknown_category": "select p_partkey as product_id, coalesce(nullif(p_brand, 'Brand#11'), 'unknown') as category, p_size as size from {part}",
    "items_enriched": "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, o_custkey, o_orderstatus, case when l_shipdate > o_orderdate + interval '30' day then 1 else 0 end as is_late from {lineitem} join {orders} on l_orderkey = o_orderkey",
    "payments_enriched": "select o_orderkey as order_id, o_orderpriority as payment_type, o_totalprice as payment_value, o_orderstatus as order_status, c_mktsegment as segment from {orders} join {customer} on o_custkey = c_custkey",
    "dim_seller": "select md5(cast(s_suppkey as varchar(20))) as seller_key, s_suppkey as seller_id, s_name as seller_name, n_name as nation from {supplier} join {nation} on s_nationkey = n_nationkey",
    "dq_unique": "select o_orderkey, count(*) as n from {orders} group by 1 having count(*) > 1",
    "dq_not_null": "select o_orderkey from {orders} where nullif(o_custkey % 7, 0) is null",
    "dq_accepted": "select o_orderkey, o_orderstatus from {orders} where o_orderstatus is not null and o_orderstatus not in ('F', 'O')",
    "dq_relationships": "select o_orderkey from {orders} o where o_custkey is not null and not exists (select 1 from {customer} c where c.c_custkey = o.o_custkey and c.c_custkey % 10 <> 0)",
    "dq_non_negative": "select c_custkey, c_acctbal from {customer} where c_acctbal < 0",
    "dq_unique_combination": "select l_orderkey, l_linenumber, count(*) as n from {lineitem} group by 1, 2 having count(*) > 1",
    "dq_fact_complete": "select o_orderkey as k, 'no items' as side from (select o_orderkey from {orders} except select l_orderkey from {lineitem}) a union all select l_orderkey, 'no order' from (select l_orderkey from {lineitem} except select o_orderkey from {orders} where o_orderstatus <> 'P') b",
    "dq_revenue_reconciles": f"select {_r('a.r', 1)} as items, {_r('b.r', 1)} as by_part, abs(a.r - b.r) <= 0.01 as matches from (select sum(l_extendedprice) as r from {{lineitem}}) a cross join (select sum(r) as r from (select l_partkey, sum(l_extendedprice) as r from {{lineitem}} group by 1) x) b",
    "layer_metrics": f"select cast(count(distinct o_orderkey) as bigint) as orders, count(*) as items, {_r('sum(l_extendedprice)', 1)} as revenue from {{lineitem}} l join {{orders}} on o_orderkey = l.l_orderkey",
    "dq_latest": f"with {LOG} select run_id, check_name, id, status from (select *, row_number() over (partition by run_id, check_name order by id desc) as k from lg) t where k = 1",
    "dq_scorecard": f"""with {LOG}, t as (select * from (select *, row_number() over (partition by run_id, check_name order by id desc) as k from lg) x where k = 1)
select run_id, count(*) as checks, count(*) filter (where status = 'PASS') as passed, count(*) filter (where status = 'WARN') as warned, count(*) filter (where status = 'FAIL') as failed,
  {_r("100.0 * cast(count(*) filter (where status = 'PASS') as double) / nullif(count(*), 0)", 1)} as pass_rate, {_r("100.0 * (cast(count(*) filter (where status = 'PASS') as double) + 0.5 * count(*) filter (where status = 'WARN')) / nullif(count(*), 0)", 1)} as health from t group by 1""",
    "dq_scorecard_by_category": f"with {LOG} select case when check_name like '%up%' then 'growth' when check_name like '%r%' then 'risk' else 'traffic' end as category, count(*) as checks, count(*) filter (where status <> 'PASS') as open_checks from lg group by 1",
    "source_freshness": "select cast(max(ts) as date) as newest, cast(case when max(ts) < timestamp '2024-02-01 00:00:00' - interval '24' hour then 'warn' else 'pass' end as varchar(10)) as status from {events}",
    "pipeline_freshness": "select coalesce(max(ts) filter (where event_type = 'purchase') >= timestamp '2024-01-31 00:00:00' - interval '26' hour, true) as fresh from {events}",
    "business_totals": f"with o as (select o_custkey, count(*) as n, sum(o_totalprice) as r from {{orders}} where o_orderstatus <> 'P' group by 1) select cast(sum(n) as bigint) as orders, count(*) as customers, {_r('sum(r)', 1)} as revenue, {_r('sum(r) / sum(n)')} as aov from o",
    "topn_products": "select l_partkey, count(*) as units from {lineitem} group by 1 order by units desc, l_partkey limit 15",
    "ordered_statuses": f"with {LOG} select run_id, check_name, status, id from lg order by status <> 'FAIL', status <> 'WARN', id desc limit 100",
    "customers_with_many_versions": "select user_id, event_id, ts from {events} where user_id in (select user_id from {events} group by user_id having count(*) > 70)",
    "set_union_except": "(select l_partkey as k, 'sold' as side from {lineitem} union select p_partkey, 'listed' from {part}) except select p_partkey, 'listed' from {part} where p_size > 25",
    "distinct_status_priority": "select distinct o_orderstatus, o_orderpriority from {orders}",
    "is_distinct_from": "select o_orderkey from {orders} where nullif(o_custkey % 5, 0) is distinct from nullif(o_orderkey % 5, 0)",
    "left_join_preaggregated": "select c_custkey, coalesce(n, 0) as orders, coalesce(late, 0) as late from {customer} left join (select o_custkey, count(*) as n from {orders} group by 1) a on a.o_custkey = c_custkey left join (select o_custkey as k, count(*) filter (where l_shipdate > o_orderdate + interval '30' day) as late from {orders} join {lineitem} on l_orderkey = o_orderkey group by 1) b on b.k = c_custkey",
    "scalar_subquery": "select o_orderkey, o_orderdate from {orders} where o_orderdate >= (select max(o_orderdate) from {orders}) - interval '10' day",
    "using_join": "select l_orderkey, count(*) as n from {lineitem} join (select o_orderkey as l_orderkey, o_orderstatus from {orders}) o using (l_orderkey) where o_orderstatus = 'F' group by l_orderkey",
    "duplicate_count": "select count(*) - count(distinct l_orderkey) as duplicate_orders from {lineitem}",
    "watermark_window_extract": "select event_id, user_id, ts from {events} where ts >= timestamp '2024-01-20 12:00:00' - interval '10' minute",
    "backfill_extract": "select event_id, user_id, ts from {events} where ts >= timestamp '2024-01-05 00:00:00' and ts < timestamp '2024-01-12 00:00:00'",
    "recent_runs_tasks": "select user_id as run_id, event_type as task, count(*) as attempts from {events} where user_id in (select user_id from {events} group by 1 order by max(ts) desc, user_id limit 15) group by 1, 2",
}


# --- queries made of the library's operators ----------------------------------


def _dirty_items(spark, d):
    """lineitem with gaps and wrong values in known places."""
    li = load(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 7 != 0, F.col("l_partkey")).alias("l_partkey"), F.when(F.col("l_suppkey") % 11 == 0, "abc").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("quantity"), "l_returnflag", F.col("l_extendedprice"))


def item_rules():
    return [*rules.required("l_partkey"), rules.one_of("l_returnflag", ["A", "R"]), rules.readable_as("quantity", "double"), rules.that("quantity_small", rules.number("quantity") < 45)]
DIRTY = """d as (select l_orderkey, l_linenumber, case when l_partkey % 7 <> 0 then l_partkey end as l_partkey,
  case when l_suppkey % 11 = 0 then 'abc' else cast(cast(l_quantity as int) as varchar) end as quantity, l_returnflag, l_extendedprice from lineitem),
m as (select *, list_filter([case when l_partkey is null then 'not_null:l_partkey' end, case when not (l_returnflag in ('A', 'R')) then 'accepted:l_returnflag' end,
  case when try_cast(quantity as double) is null then 'type:quantity:double' end, case when not coalesce(try_cast(quantity as double) < 45, false) then 'quantity_small' end], lambda x: x is not null) as f from d)"""


def q_rules_valid(spark, d):
    return rules.apply_rules(_dirty_items(spark, d), item_rules())[0]


def q_rules_quarantine(spark, d):
    return rules.apply_rules(_dirty_items(spark, d), item_rules())[1].drop("failed_rules")


def q_rule_counts(spark, d):
    return rules.failure_counts(rules.apply_rules(_dirty_items(spark, d), item_rules())[1])


def q_split(spark, d):
    good, bad = rules.split_valid(_dirty_items(spark, d), ["l_partkey"], "l_extendedprice > 20000")
    return good.agg(F.count("*").alias("rows")).withColumn("side", F.lit("valid")).unionByName(bad.agg(F.count("*").alias("rows")).withColumn("side", F.lit("invalid")))


def q_trim(spark, d):
    return rules.trim_strings(load(spark, d, "documents").select("doc_id", F.concat(F.lit("  "), F.col("lang"), F.lit(" ")).alias("lang"), F.concat(F.lit(" "), F.col("source")).alias("source")))


def q_latest_events(spark, d):
    return versions.latest(load(spark, d, "events"), ["user_id"], ["ts"]).select("user_id", "event_id", "ts", "event_type")


def q_latest_items(spark, d):
    return versions.latest(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]).select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")


def _events(spark, d):
    return load(spark, d, "events").select("user_id", "ts", "event_id", "event_type")


EARLY, MIDDLE = "ts < timestamp_ntz'2024-01-10 00:00:00'", "ts < timestamp_ntz'2024-01-20 00:00:00' and event_id % 3 <> 0"
LATE = "ts < timestamp_ntz'2024-01-25 00:00:00'"


def q_classify(spark, d):
    e = _events(spark, d)
    return versions.version_classes(e.filter(MIDDLE), versions.latest(e.filter("user_id % 5 <> 0").filter(EARLY), ["user_id"], ["ts"]), ["user_id"], "ts")


def q_reconcile(spark, d):
    e = _events(spark, d)
    silver = versions.latest(e.filter("event_type <> 'error'").filter("user_id % 7 <> 0"), ["user_id"], ["ts"])
    return versions.reconciled(e, silver, e.filter("event_type = 'error'"), "user_id", "ts")


def q_dim_date(spark, d):
    day = F.col("date_day")
    iso = F.extract(F.lit("DAYOFWEEK_ISO"), day).cast("int")
    return tabular.days(spark, "2016-01-01", "2030-12-31").select(S.date_key(day).alias("date_key"), "date_day", F.year(day).alias("year"), F.month(day).alias("month"), F.date_format(day, "MMM").alias("month_name"), iso.alias("day_of_week"), (iso >= 6).alias("is_weekend"))


def _user_versions(spark, d):
    return versions.validity(_events(spark, d), ["user_id"], "ts", F.lit(S.OPEN_END).cast("timestamp_ntz"))


def q_scd2(spark, d):
    return _user_versions(spark, d).select("user_id", "event_type", "valid_from", "valid_to", "is_current")


def _snapshots(spark, d, moments):
    e = _events(spark, d)
    empty = spark.createDataFrame([], "user_id long, ts timestamp_ntz, event_type string, valid_from timestamp_ntz, valid_to timestamp_ntz, scd_id string")
    out = empty
    for upto in moments:
        out = versions.snapshot(out, versions.latest(e.filter(upto), ["user_id"], ["ts"]), "user_id", "ts", ["event_type"])
    return out.drop("ts")


def q_scd2_snapshot(spark, d):
    """Three snapshots of the users' state, the last one of all events, applied one after the other."""
    return _snapshots(spark, d, (EARLY, LATE, "true"))


def q_fact_pit(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("user_id"), (F.col("o_orderdate") + F.expr("interval '10227' day")).alias("moment"))
    v = _user_versions(spark, d).select("user_id", F.col("event_id").alias("version_id"), "valid_from", "valid_to")
    return joins.point_in_time(orders, v, "user_id", "moment").select("o_orderkey", "user_id", "moment", "version_id")


def q_fact_filter(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return versions.changed_or_missing(o, o.filter("o_orderdate < timestamp_ntz'1999-01-01 00:00:00' and o_orderkey % 13 <> 0"), "o_orderkey", "o_orderdate")


def q_fact_delete_insert(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return versions.replaced(li.withColumn("l_extendedprice", F.lit(0.0)), li.filter("l_orderkey % 10 = 0"), "l_orderkey")


def q_rolling(spark, d):
    day = load(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date_day")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("revenue"))
    from pyspark.sql import Window

    # one row per day: the window's single task holds as many rows as there are days
    w = Window.orderBy("date_day").rowsBetween(-6, 0)
    return day.select("date_day", F.col("revenue").cast("double").alias("revenue"), S.money((F.sum("revenue").over(w) / F.count("*").over(w)).cast("double"), 2).alias("rolling_7"))


def q_pivot(spark, d):
    o = load(spark, d, "orders")
    return o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))


def q_unpivot(spark, d):
    o = load(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"))
    return o.unpivot("o_orderstatus", ["orders", "customers"], "metric", "value")


def q_retention_avg(spark, d):
    r = _model("agg_customer_retention")(spark, d)
    return r.filter("months_since_first between 1 and 12").groupBy("months_since_first").agg(S.share(F.sum("active_customers"), F.sum("cohort_size")).alias("retention_pct"))


def q_shares(spark, d):
    return joins.key_shares(load(spark, d, "lineitem"), "l_suppkey").select("l_suppkey", "rows", S.money(F.col("share"), 6).alias("share"))


def _join_sides(spark, d):
    return load(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), load(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")


def _joined(how):
    def run(spark, d):
        big, small = _join_sides(spark, d)
        return how(big, small).groupBy("s_name").agg(F.count("*").alias("n"))

    return run


def _split_join(a, b):
    """A merge join whose large partitions adaptive execution splits; the settings hold while the rows are counted."""
    spark = a.sparkSession
    with tools.conf(spark, spark__sql__adaptive__enabled="true", spark__sql__adaptive__skewJoin__enabled="true", spark__sql__autoBroadcastJoinThreshold="-1"):
        counted = joins.merge_join(a, b, "k").groupBy("k", "s_name").agg(F.count("*").alias("n")).collect()  # a row for each supplier
    rows = spark.createDataFrame(counted, "k long, s_name string, n long")
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n", "times")


def q_run_stats(spark, d):
    e = load(spark, d, "events")
    dur = F.col("value")
    return e.groupBy(F.col("event_type").alias("task")).agg(F.count("*").alias("runs"), S.money(F.percentile(dur, 0.5), 4).alias("median"), S.money(F.percentile(dur, 0.95), 4).alias("p95"), F.max_by("user_id", "event_id").alias("last_run"))


def _flow_runs(e):
    bad = F.col("event_type") == "error"
    return e.groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("tasks"), F.count_if(bad).alias("failed"), F.min_by(F.when(bad, F.col("event_id")), F.when(bad, F.col("event_id"))).alias("first_failed"), F.expr("listagg(event_type, ' > ') within group (order by event_id)").alias("path"))


def q_flow_paths(spark, d):
    return _flow_runs(load(spark, d, "events"))


def _lake(spark, name):
    """A table in the shared folder that the cluster names, on any file system; in a temporary one where it names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="strata-lake-")
    return LakeTable(spark, f"{shared}/strata-lake-{uuid.uuid4().hex}/{name}")


def _landed(spark, d, last=()):
    e = _events(spark, d)
    t = _lake(spark, "bronze")
    t.create(e.filter(EARLY))
    for batch in (MIDDLE, MIDDLE, *last):
        t.insert_if_absent(e.filter(batch), ["event_id"])
    return t.df()


def q_bronze_insert_only(spark, d):
    """Overlapping batches, the last one of all events."""
    return _landed(spark, d, ["true"])


def q_silver_upsert(spark, d):
    e = _events(spark, d)
    t = _lake(spark, "silver")
    t.create(versions.latest(e.filter(MIDDLE), ["user_id"], ["ts"]))
    t.upsert_newer(versions.latest(e.filter("user_id % 3 = 0"), ["user_id"], ["ts"]), ["user_id"], "ts")
    t.upsert_newer(versions.latest(e.filter(EARLY), ["user_id"], ["ts"]), ["user_id"], "ts")
    return t.df()


def q_change_feed(spark, d):
    e = _events(spark, d)
    t = _lake(spark, "feed")
    t.create(versions.latest(e.filter(EARLY), ["user_id"], ["ts"]), {"changeFeed": "true"})
    t.upsert_newer(versions.latest(e.filter("user_id % 3 = 0"), ["user_id"], ["ts"]), ["user_id"], "ts")
    t.delete("user_id % 10 = 1")
    return t.changes(2).groupBy("_commit_version", "_change_type").agg(F.count("*").alias("rows"))


def q_time_travel(spark, d):
    e = _events(spark, d)
    t = _lake(spark, "travel")
    t.create(e.filter(EARLY))
    t.append(e.filter("ts >= timestamp_ntz'2024-01-10 00:00:00'"))
    return t.df(version=0)


def q_compaction(spark, d):
    e = _events(spark, d)
    t = _lake(spark, "compact")
    t.create(e.filter("event_id % 4 = 0"))
    for k in (1, 2, 3):
        t.append(e.filter(f"event_id % 4 = {k}"))
    t.optimize()
    return t.df()


def q_restore(spark, d):
    e = _events(spark, d)
    t = _lake(spark, "restore")
    t.create(e)
    t.delete(EARLY)
    t.restore(0)
    return t.df()


def q_delete_window(spark, d):
    t = _lake(spark, "delete")
    t.create(_events(spark, d))
    t.delete("ts >= timestamp_ntz'2024-01-10 00:00:00' and ts < timestamp_ntz'2024-01-15 00:00:00'")
    return t.df()


def q_jdbc(spark, d):
    url = f"jdbc:derby:{tempfile.mkdtemp(prefix='strata-derby-')}/db;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    tabular.write_jdbc(load(spark, d, "supplier"), url, "suppliers", driver)
    return tabular.read_jdbc(spark, url, "(select * from suppliers where \"s_acctbal\" > 0) q", driver)


def q_backfill_chunks(spark, d):
    chunks = control.split_window(datetime(2024, 1, 1), datetime(2024, 1, 31), days=7)
    e = _events(spark, d)
    bounds = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(chunks)], "chunk int, low timestamp_ntz, high timestamp_ntz")
    place = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / (7 * 86400)).cast("int")
    return e.withColumn("chunk", place).join(F.broadcast(bounds), "chunk").filter("ts >= low and ts < high").groupBy("chunk").agg(F.count("*").alias("n"))


def q_json_keys(spark, d):
    return load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def q_normal_forms(spark, d):
    o = load(spark, d, "orders")
    day = F.col("o_orderdate")
    return o.select("o_orderkey", F.date_format(day, "yyyy-MM").alias("month"), F.left("o_orderpriority", F.lit(3)).alias("short"), F.concat_ws(", ", "o_orderstatus", "o_orderpriority").alias("both"), F.format_string("%05d", F.col("o_custkey").cast("int")).alias("padded"), F.expr("try_cast(o_orderpriority as int)").alias("number"))


def _model(*names):
    """A model over the tables; several give a dictionary."""

    def run(spark, d):
        sources = {n for m in order(names) for n in MODELS[m].needs if n not in MODELS}
        frames = build({n: load(spark, d, n) for n in sources}, names)
        return frames[names[0]] if len(names) == 1 else frames

    return run


# --- Bronze to Silver ---------------------------------------------------------

def _event_spec():
    return silver.SilverSpec("events", ("user_id",), "ts", (rules.one_of("event_type", ["click", "purchase", "signup", "view"]),), True)


def _merged_events(spark, d):
    """Three landings of events, each merged on; the tables and what every merge did."""
    e = _events(spark, d)
    landing, target, quarantine = (_lake(spark, n) for n in ("bronze", "silver", "quarantine"))
    state, spec = StateStore(spark, f"{target.path}-state"), bronze.BronzeSpec("events", "incremental", ("event_id",))
    done = []
    for batch in (EARLY, MIDDLE, "true"):
        bronze.write(spec, landing, e.filter(batch))
        done.append(silver.process(_event_spec(), landing, target, quarantine, state))
    done.append(silver.process(_event_spec(), landing, target, quarantine, state))
    return target, quarantine, done


def q_silver_incremental(spark, d):
    return _merged_events(spark, d)[0].df()


def q_quarantine_log(spark, d):
    return _merged_events(spark, d)[1].df().select("user_id", "ts", "event_id", "reason")


def q_silver_steps(spark, d):
    rows = [(k, m.mode, m.read, m.rejected, m.inserted, m.updated) for k, m in enumerate(_merged_events(spark, d)[2])]
    return spark.createDataFrame(rows, "step int, mode string, read long, rejected long, inserted long, updated long")


def q_key_changes(spark, d):
    e = _events(spark, d)
    t = _lake(spark, "keys")
    t.create(e.filter(EARLY))
    t.insert_if_absent(e.filter(MIDDLE), ["event_id"])
    t.delete("user_id % 10 = 3")
    return tools.key_changes(t, "user_id", 0, 2).unionByName(tools.key_changes(t, "user_id", 0, 1))


def q_write_counts(spark, d):
    e = _events(spark, d)
    t = _lake(spark, "counts")
    t.create(versions.latest(e.filter(EARLY), ["user_id"], ["ts"]))
    base = t.version()
    t.upsert_newer(versions.latest(e.filter(MIDDLE), ["user_id"], ["ts"]), ["user_id"], "ts")
    t.delete("user_id % 10 = 3")
    rows = [("since", *t.write_counts(base).values()), ("none", *t.write_counts(t.version()).values())]
    return spark.createDataFrame(rows, "part string, inserted long, updated long, deleted long")


def q_small_files(spark, d):
    """A table written in twenty appends, grouped as it is."""
    e = _events(spark, d)
    t = _lake(spark, "small")
    t.create(e.filter("event_id % 20 = 0").coalesce(1))
    for k in range(1, 20):
        t.append(e.filter(f"event_id % 20 = {k}").coalesce(1))
    return t.df().groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def q_row_json(spark, d):
    o = load(spark, d, "orders")
    row = F.to_json(F.struct(*o.columns))
    return o.select("o_orderkey", F.get_json_object(row, "$.o_orderstatus").alias("status"), F.length("o_orderpriority").alias("letters"), (F.length(F.get_json_object(row, "$.o_orderpriority")) == F.length("o_orderpriority")).alias("same"))


def q_kept_frame(spark, d):
    """One kept frame read by two aggregates."""
    kept = load(spark, d, "lineitem").select("l_returnflag", "l_quantity").persist()
    try:
        flags = kept.groupBy(F.col("l_returnflag").alias("k")).agg(F.count("*").alias("n"))
        sizes = kept.groupBy((F.floor(F.col("l_quantity") / 10)).cast("string").alias("k")).agg(F.count("*").alias("n"))
        return spark.createDataFrame(flags.union(sizes).collect(), "k string, n long")  # a row for each flag and size
    finally:
        kept.unpersist()


# --- the audit log: events stand for steps ---------------------------------------


def _steps(spark, d):
    e = load(spark, d, "events")
    level = F.when(F.col("event_type") == "signup", "flow").when(F.col("event_type") == "purchase", "table").otherwise("task")
    status = F.when(F.col("event_id") % 31 == 0, "ABANDONED").when(F.col("event_id") % 7 == 0, "FAILED").when(F.col("event_id") % 97 == 0, "RUNNING").otherwise("SUCCESS")
    return e.select(
        F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("step_id"), F.col("user_id").cast("string").alias("run_id"), level.alias("level"), F.col("event_type").alias("name"), status.alias("status"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("started"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at"), F.when(status != "RUNNING", F.col("value")).alias("seconds"),
        (F.col("event_id") % 3).cast("int").alias("retry"), (F.col("event_id") % 5).alias("inserted"), (F.col("event_id") % 2).alias("updated"), F.lit(0).cast("long").alias("rejected"), F.lit(None).cast("string").alias("error"))


def q_flow_runs(spark, d):
    # flows of one run share its tasks; each is told apart by its start
    return audit.flow_runs(_steps(spark, d)).drop("at", "error").withColumn("started", F.col("started").cast("long"))


def q_task_stats(spark, d):
    return audit.task_stats(_steps(spark, d)).withColumn("last_start", F.col("last_start").cast("long"))


def q_audit_run_stats(spark, d):
    return audit.run_stats(_steps(spark, d).filter("level = 'flow'"))


def q_rejections(spark, d):
    s = _steps(spark, d)
    return audit.rejections(s.select(F.col("seq").alias("at"), "run_id", F.col("level").alias("table_name"), F.col("name").alias("rule"), F.col("inserted").alias("rows"), F.col("step_id").alias("sample")))


def q_rejected_samples(spark, d):
    return rules.failure_samples(rules.apply_rules(_dirty_items(spark, d), item_rules())[1], ["l_orderkey", "l_linenumber"])


def q_recorded_checks(spark, d):
    o, li, c = (load(spark, d, t) for t in ("orders", "lineitem", "customer"))
    total = lambda df, col: df.agg(F.sum(F.col(col).cast("decimal(18,2)")))
    made = [
        checks.breaking("unique_orders", checks.unique(o, "o_orderkey")), checks.breaking("unique_combination_items", checks.unique(li, "l_orderkey", "l_linenumber"), False),
        checks.breaking("not_null_orders_custkey", checks.not_null(o, "o_custkey")), checks.breaking("accepted_values_status", checks.accepted_values(o, "o_orderstatus", ["F", "O"])),
        checks.breaking("relationships_customer", checks.relationships(o, "o_custkey", c.filter("c_custkey % 10 <> 0"), "c_custkey"), False), checks.breaking("non_negative_balance", checks.non_negative(c, "c_acctbal")),
        checks.difference("revenue_items_vs_flags", ("items", total(li, "l_extendedprice")), ("flags", total(li.filter("l_returnflag in ('A', 'N', 'R')"), "l_extendedprice")), True, checks.TOLERANCE)]
    return checks.record(made).drop("detail")


def q_pipeline_checks(spark, d):
    e, m = _events(spark, d), _model("fact_orders", "agg_daily_sales", "sales", "fact_payments")(spark, d)
    o, li = load(spark, d, "orders"), load(spark, d, "lineitem")
    valid = e.filter("event_type <> 'error'")
    one = lambda df, c: df.agg(c.alias("v"))
    revenue, orders = one(m["sales"], F.sum("price")), one(m["sales"], F.count_distinct("order_id"))
    metrics = {"revenue": (revenue, revenue, one(m["agg_daily_sales"], F.sum("revenue"))), "orders": (orders, orders, one(m["agg_daily_sales"], F.sum("orders"))),
               "payments": (one(o, F.sum(F.col("o_totalprice").cast("decimal(18,2)"))), one(o, F.sum(F.col("o_totalprice").cast("decimal(18,2)"))), one(m["fact_payments"], F.sum(F.col("payment_value").cast("decimal(18,2)"))))}
    flows = _steps(spark, d).filter("level = 'flow'").withColumnRenamed("name", "flow_name")
    fresh = checks.freshness(flows, "signup", "-", F.unix_timestamp(F.lit("2024-02-02 00:00:00").cast("timestamp")))
    made = checks.pipeline_checks(e, versions.latest(valid.filter("user_id % 7 <> 0"), ["user_id"], ["ts"]), e.filter("event_type = 'error'"), e, valid.select("user_id").distinct(), li, m["fact_orders"], metrics, fresh, "user_id", "ts")
    return checks.record(made).select("check_name", "category", "status")


E = "select user_id, ts, event_id, event_type from events"
LATEST = "(select * exclude k from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from ({0})) where k = 1)"
S_EARLY, S_MIDDLE = "ts < timestamp '2024-01-10 00:00:00'", "ts < timestamp '2024-01-20 00:00:00' and event_id % 3 <> 0"
_mid, _all3, _early = (LATEST.format(f"{E} where {w}") for w in (S_MIDDLE, "user_id % 3 = 0", S_EARLY))
NEWER = f"select coalesce(b.user_id, a.user_id) as user_id, case when b.ts > a.ts or a.ts is null then b.ts else a.ts end as ts, case when b.ts > a.ts or a.ts is null then b.event_id else a.event_id end as event_id, case when b.ts > a.ts or a.ts is null then b.event_type else a.event_type end as event_type from ({{0}}) a full join ({{1}}) b on a.user_id = b.user_id"
JOIN_SQL = "select s_name, count(*) as n from lineitem join supplier on l_suppkey = s_suppkey group by 1"

ITEMS = "(select o_orderkey, o_custkey, o_orderstatus as st, o_orderdate as bought, l_linenumber, l_partkey, l_suppkey, l_extendedprice::decimal(18,2) as p, (l_extendedprice * l_tax)::decimal(18,6) as f, (l_shipdate::date - o_orderdate::date)::int as days, (l_shipdate > o_orderdate + interval 30 day)::int as late from orders join lineitem on l_orderkey = o_orderkey)"
ORDERS_SQL = f"select o_orderkey, o_custkey, date_trunc('month', any_value(bought))::date as m, any_value(bought)::date as day, count(*) as n, sum(p) as r, sum(f) as f, max(late) as late, sum(late) as late_items from {ITEMS} where st in ('F', 'O') group by o_orderkey, o_custkey"
BORN_SQL = f"select *, min(m) over (partition by o_custkey) as born from ({ORDERS_SQL})"
MONTHLY_SQL = f"""select m as month, count(*) as orders, count(distinct o_custkey) as customers, count(distinct case when born = m then o_custkey end) as new_customers, count(distinct case when born < m then o_custkey end) as returning_customers,
  sum(n)::bigint as items_sold, {_r('sum(r)')} as revenue, {_r('sum(f)')} as freight, {_r('sum(r)::double / count(*)')} as avg_order_value, {_r('100.0 * sum(late)::double / count(*)', 1)} as late_delivery_pct from ({BORN_SQL}) group by m"""
RETENTION_SQL = f"""with b as ({BORN_SQL}), pairs as (select distinct o_custkey, born, m from b), act as (select born as cohort_month, date_diff('month', born, m)::int as months_since_first, count(*) as active_customers from pairs group by 1, 2)
select cohort_month, months_since_first, first_value(active_customers) over (partition by cohort_month order by months_since_first) as cohort_size, active_customers,
  {_r('100.0 * active_customers::double / first_value(active_customers) over (partition by cohort_month order by months_since_first)', 1)} as retention_pct from act"""
DAILY_SQL = f"select day as date_day, count(*) as orders, sum(n)::bigint as items_sold, {_r('sum(r)')} as revenue, {_r('sum(f)')} as freight, sum(late_items)::bigint as late_deliveries from ({ORDERS_SQL}) group by day"
PRODUCT_SQL = f"""select l_partkey as product_id, coalesce(p_brand, 'unknown') as category, count(distinct o_orderkey) as orders, count(*) as units_sold, sum(p)::double as revenue, {_r('sum(p)::double / count(*)')} as avg_price, min(bought)::date as first_sale, max(bought)::date as last_sale,
  rank() over (order by sum(p) desc) as revenue_rank, {_r('100.0 * sum(p)::double / sum(sum(p)) over ()::double', 3)} as revenue_share_pct from {ITEMS} join part on p_partkey = l_partkey where st <> 'P' group by 1, 2""".replace("over ()::double", "over ()").replace("sum(sum(p)) over ()", "(sum(sum(p)) over ())::double")
CUSTOMER_SQL = """select md5(c_custkey::varchar || '|' || strftime(f, '%Y%m%d')) as customer_key, c_custkey as customer_id, case when f = timestamp '1998-01-01' then 'NEW ' else '' end || c_mktsegment as segment, f as valid_from, t as valid_to, t > timestamp '9000-01-01' as is_current
from customer, lateral (select unnest(case when c_custkey % 3 = 0 then [timestamp '1900-01-01', timestamp '1998-01-01'] else [timestamp '1900-01-01'] end) as f, unnest(case when c_custkey % 3 = 0 then [timestamp '1998-01-01', timestamp '9999-12-31'] else [timestamp '9999-12-31'] end) as t)"""
STEPS_SQL = """s as (select event_id as seq, user_id::varchar as run_id, case event_type when 'signup' then 'flow' when 'purchase' then 'table' else 'task' end as level, event_type as name, floor(epoch(ts))::bigint as started, value,
  case when event_id % 31 = 0 then 'ABANDONED' when event_id % 7 = 0 then 'FAILED' when event_id % 97 = 0 then 'RUNNING' else 'SUCCESS' end as status from events)"""
BATCHES_SQL = f"x as (select *, case when {S_EARLY} then 0 when {S_MIDDLE} then 1 else 2 end as step from events)"

PAIRED = {
    "agg_daily_sales": (_model("agg_daily_sales"), DAILY_SQL),
    "agg_category_revenue": (_model("agg_category_revenue"), f"select coalesce(p_brand, 'unknown') as category, count(distinct o_orderkey) as orders, {_r('sum(p)')} as revenue, {_r('sum(days)::double / count(days)', 1)} as avg_delivery_days from {ITEMS} join part on p_partkey = l_partkey where st <> 'P' group by 1"),
    "agg_monthly_kpis": (_model("agg_monthly_kpis"), MONTHLY_SQL),
    "agg_customer_retention": (_model("agg_customer_retention"), RETENTION_SQL),
    "agg_product_sales": (_model("agg_product_sales"), PRODUCT_SQL),
    "dim_customer": (_model("dim_customer"), CUSTOMER_SQL),
    "dim_product": (_model("dim_product"), "select md5(p_partkey::varchar) as product_key, p_partkey as product_id, coalesce(p_brand, 'unknown') as category from part"),
    "fact_orders": (_model("fact_orders"), f"""with c as ({CUSTOMER_SQL})
select md5(concat_ws('-', o_orderkey, l_linenumber, l_partkey, l_suppkey, days)) as order_item_key, o_orderkey as order_id, l_linenumber as order_item_id, o_custkey as customer_id,
  (select customer_key from c where customer_id = o_custkey and bought >= valid_from and bought < valid_to) as customer_key, md5(l_partkey::varchar) as product_key, md5(l_suppkey::varchar) as seller_key, strftime(bought, '%Y%m%d')::int as date_key,
  st as order_status, bought as purchased_at, p as price, f as freight, days as delivery_days, late as is_late from {ITEMS}"""),
    "fact_payments": (_model("fact_payments"), "select md5(o_orderkey::varchar || '-1') as payment_key, o_orderkey as order_id, 1 as payment_sequential, o_orderpriority as payment_type, o_totalprice as payment_value, strftime(o_orderdate, '%Y%m%d')::int as date_key from orders"),
    "retention_matrix": (_model("retention_matrix"), f"select cohort_month, {', '.join(f'max(case when months_since_first = {k} then retention_pct end) as month_{k}' for k in range(13))} from ({RETENTION_SQL}) group by 1"),
    "aggregates_disagree": (_model("aggregates_disagree"), f"select a.r as daily_revenue, a.o as daily_orders, b.r as monthly_revenue, b.o as monthly_orders, c.r as product_revenue, 0::bigint as cohorts_not_100 from (select sum(revenue) as r, sum(orders)::bigint as o from ({DAILY_SQL})) a, (select sum(revenue) as r, sum(orders)::bigint as o from ({MONTHLY_SQL})) b, (select sum(revenue) as r from ({PRODUCT_SQL})) c where abs(a.r - b.r) > 0.05 or abs(a.r - c.r) > 0.05 or a.o <> b.o"),
    "business_headline": (_model("business_headline"), f"select sum(orders)::bigint as orders, (select count(distinct o_custkey) from ({ORDERS_SQL})) as customers, {_r('sum(revenue)', 1)} as revenue, {_r('sum(revenue) / sum(orders)', 1)} as avg_order_value from ({MONTHLY_SQL})"),
    "dataset_kpi_monthly": (lambda spark, d: tools.MODELS["kpi_monthly"](_model("agg_monthly_kpis", "agg_daily_sales")(spark, d)), f"select * replace (strftime(month, '%Y-%m') as month) from ({MONTHLY_SQL})"),
    "dataset_daily_sales": (lambda spark, d: tools.MODELS["daily_sales"](_model("agg_monthly_kpis", "agg_daily_sales")(spark, d)), f"select *, {_r('revenue / orders')} as avg_order_value from ({DAILY_SQL})"),
    "dataset_product_sales_top": (lambda spark, d: tools.MODELS["product_sales_top"](_model("agg_product_sales", "dim_product")(spark, d)), f"select * from ({PRODUCT_SQL}) order by revenue_rank, product_id limit 20"),
    "dataset_customer_versions": (lambda spark, d: tools.MODELS["customer_versions_examples"](_model("dim_customer", "customer_versions")(spark, d)), f"select * from ({CUSTOMER_SQL}) where customer_id in (select c_custkey from customer where c_custkey % 3 = 0 order by 1 limit 10)"),
    "silver_incremental": (q_silver_incremental, f"select user_id, ts, event_id, event_type from {LATEST.format(E + chr(32) + 'where event_type <> ' + chr(39) + 'error' + chr(39))}"),
    "quarantine_log": (q_quarantine_log, "select user_id, ts, event_id, 'accepted:event_type' as reason from events where event_type = 'error'"),
    "silver_steps": (q_silver_steps, f"""with {BATCHES_SQL}, good as (select * from x where event_type <> 'error'),
u as (select user_id, step, max(ts) as ts from good group by 1, 2), v as (select *, max(ts) over (partition by user_id order by step rows between unbounded preceding and 1 preceding) as before from u),
k as (select step, count(*) as read, count(*) filter (where event_type = 'error') as rejected from x group by 1), w as (select step, count(*) filter (where before is null) as inserted, count(*) filter (where before < ts) as updated from v group by 1)
select step::int as step, case step when 0 then 'full' else 'incremental' end as mode, read, rejected, inserted, updated from k join w using (step) union all select 3, 'skip', 0, 0, 0, 0"""),
    "write_counts": (q_write_counts, f"""with a as {_early}, b as {_mid}, m as (select b.user_id, a.ts as old, b.ts as new from b left join a using (user_id)), t as (select user_id from a union select user_id from b)
select 'since' as part, (select count(*) from m where old is null) as inserted, (select count(*) from m where new > old) as updated, (select count(*) from t where user_id % 10 = 3) as deleted union all select 'none', 0, 0, 0"""),
    "small_files_group_by": (q_small_files, "select event_type, count(*) as n, count(distinct user_id) as users from events group by 1"),
    "rows_breaking_rule": (lambda spark, d: rules.breaking_rows(rules.apply_rules(_dirty_items(spark, d), item_rules())[1], "quantity_small").drop("failed_rules", "reason"), f"with {DIRTY} select * exclude f from m where list_contains(f, 'quantity_small')"),
    "order_totals": (lambda spark, d: _model("items_with_orders")(spark, d).groupBy("order_id").agg(S.money(F.sum("price") + F.sum("freight")).alias("payment_value")), f"select o_orderkey as order_id, {_r('sum(p) + sum(f)')} as payment_value from {ITEMS} group by 1"),
    "row_json_keys": (q_row_json, "select o_orderkey, o_orderstatus as status, length(o_orderpriority)::int as letters, true as same from orders"),
    "kept_frame": (q_kept_frame, "select l_returnflag as k, count(*) as n from lineitem group by 1 union all select floor(l_quantity / 10)::int::varchar, count(*) from lineitem group by 1"),
    "partition_sizes": (lambda spark, d: tools.partition_sizes(load(spark, d, "lineitem").repartition(8, "l_suppkey")).select("total"), "select count(*) as total from lineitem"),
    "aqe_skew_join": (_joined(lambda a, b: _split_join(a, b)), JOIN_SQL),
    "version_key_changes": (q_key_changes, f"""with a as (select distinct user_id from events where {S_EARLY}), b as (select distinct user_id from events where ({S_EARLY}) or ({S_MIDDLE})), c as (select * from b where user_id % 10 <> 3)
select user_id, 'added' as change from (select * from c except select * from a) union all select user_id, 'missing' from (select * from a except select * from c) union all select user_id, 'added' from (select * from b except select * from a)"""),
    "v_flow_runs": (q_flow_runs, f"""with {STEPS_SQL}, t as (select run_id, count(*) as task_attempts, count(*) filter (where status in ('FAILED', 'ABANDONED')) as failed_attempts, count(*) filter (where seq % 3 > 0) as retried_attempts,
  arg_min(name, seq) filter (where status in ('FAILED', 'ABANDONED')) as first_failed_task, string_agg(name, ' > ' order by seq) filter (where status = 'SUCCESS') as steps_succeeded from s where level = 'task' group by 1),
r as (select run_id, sum(seq % 5)::bigint as i, sum(seq % 2)::bigint as u from s where level = 'table' group by 1)
select s.run_id, name as flow_name, status, started, case when status <> 'RUNNING' then value end as seconds, coalesce(task_attempts, 0) as task_attempts, coalesce(failed_attempts, 0) as failed_attempts, coalesce(retried_attempts, 0) as retried_attempts,
  first_failed_task, steps_succeeded, coalesce(i, 0) as rows_inserted, coalesce(u, 0) as rows_updated, 0::bigint as rows_rejected from s left join t on t.run_id = s.run_id left join r on r.run_id = s.run_id where level = 'flow'"""),
    "v_task_stats": (q_task_stats, f"""with {STEPS_SQL}, g as (select *, case when status = 'SUCCESS' then value end as ok from s where level = 'task')
select name as task_name, count(*) as attempts, count(ok) as successes, count(*) filter (where status in ('FAILED', 'ABANDONED')) as failures, {_r('100.0 * count(ok)::double / count(*)', 1)} as success_rate, {_r('avg(ok)', 1)} as avg_seconds,
  {_r('quantile_cont(ok, 0.5)', 1)} as median_seconds, {_r('quantile_cont(ok, 0.95)', 1)} as p95_seconds, {_r('max(ok)', 1)} as max_seconds, max(started) as last_start, arg_max(status, seq) as last_status from g group by 1"""),
    "run_stats": (q_audit_run_stats, f"with {STEPS_SQL} select count(*) as runs, {_r('100.0 * count(*) filter (where status = ' + chr(39) + 'SUCCESS' + chr(39) + ')::double / count(*)', 1)} as success_pct, {_r('quantile_cont(value, 0.5) / 60', 1)} as median_minutes, arg_max(status, started) as last_status from s where level = 'flow' and status <> 'RUNNING'"),
    "rejections": (q_rejections, f"with {STEPS_SQL} select level as table_name, name as rule, sum(seq % 5)::bigint as rows, count(distinct run_id) as runs, max(seq)::varchar as last_sample from s group by 1, 2"),
    "rejected_samples": (q_rejected_samples, f"with {DIRTY}, h as (select unnest(f) as rule, 'l_orderkey=' || l_orderkey || ', l_linenumber=' || l_linenumber as k from m), g as (select rule, k, count(*) as n, row_number() over (partition by rule order by k) as place from h group by 1, 2) select rule, sum(n)::bigint as rows, string_agg(k, '; ' order by k) filter (where place <= 5) as sample from g group by 1"),
    "recorded_checks": (q_recorded_checks, """with c(check_name, category, bad, rows_failed) as (
  select 'unique_orders', 'uniqueness', 'FAIL', count(*) - count(distinct o_orderkey) from orders union all select 'unique_combination_items', 'uniqueness', 'WARN', (select count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1))
  union all select 'not_null_orders_custkey', 'completeness', 'FAIL', count(*) - count(o_custkey) from orders union all select 'accepted_values_status', 'validity', 'FAIL', count(*) filter (where o_orderstatus = 'P') from orders
  union all select 'relationships_customer', 'referential_integrity', 'WARN', count(*) filter (where o_custkey % 10 = 0) from orders union all select 'non_negative_balance', 'validity', 'FAIL', count(*) filter (where c_acctbal < 0) from customer union all select 'revenue_items_vs_flags', 'reconciliation', 'FAIL', 0)
select check_name, category, case when rows_failed = 0 then 'PASS' else bad end as status, rows_failed::bigint as rows_failed from c"""),
    "pipeline_checks": (q_pipeline_checks, """with e as (select max(ts) as newest from events where event_type = 'signup' and event_id % 31 <> 0 and event_id % 7 <> 0 and event_id % 97 <> 0),
r as (select count(*) filter (where good is null and not coalesce(bad, false)) as missing, count(*) filter (where user_id % 7 <> 0 and good < newest and not coalesce(newest_bad, false)) as unexplained, count(*) filter (where user_id % 7 = 0 and not coalesce(bad, false)) as left_out,
  count(*) filter (where good is not null) as valid, count(*) filter (where good is not null and user_id % 7 <> 0) as kept
  from (select user_id, max(ts) as newest, max(ts) filter (where event_type <> 'error') as good, bool_or(event_type = 'error') as bad, arg_max(event_type, ts) = 'error' as newest_bad from events group by 1)),
c(check_name, category, bad, ok) as (values ('bronze_no_duplicate_versions', 'uniqueness', 'FAIL', true), ('source_keys_in_silver_or_quarantine', 'reconciliation', 'FAIL', (select left_out = 0 and missing = 0 from r)), ('silver_versions_newest_or_explained', 'reconciliation', 'WARN', (select unexplained = 0 from r)),
  ('silver_unique_key', 'uniqueness', 'FAIL', true), ('silver_vs_staging_rows', 'reconciliation', 'FAIL', (select valid = kept from r)), ('fact_no_null_customer_key', 'completeness', 'FAIL', true), ('items_vs_fact', 'reconciliation', 'WARN', true),
  ('revenue_staging_vs_gold', 'reconciliation', 'FAIL', true), ('revenue_source_vs_gold', 'reconciliation', 'WARN', true), ('orders_staging_vs_gold', 'reconciliation', 'FAIL', true), ('orders_source_vs_gold', 'reconciliation', 'WARN', true),
  ('payments_staging_vs_gold', 'reconciliation', 'FAIL', true), ('payments_source_vs_gold', 'reconciliation', 'WARN', true), ('pipeline_previous_success_recent', 'freshness', 'WARN', (select newest >= timestamp '2024-02-02' - interval 26 hour from e)))
select check_name, category, case when ok then 'PASS' else bad end as status from c"""),
    "rules_valid": (q_rules_valid, f"with {DIRTY} select * exclude f from m where len(f) = 0"),
    "rules_quarantine_reason": (q_rules_quarantine, f"with {DIRTY} select * exclude f, array_to_string(f, ', ') as reason from m where len(f) > 0"),
    "rules_failure_counts": (q_rule_counts, f"with {DIRTY} select rule, count(*) as rows from (select unnest(f) as rule from m) group by 1"),
    "split_valid_invalid": (q_split, f"with {DIRTY} select case when coalesce(l_partkey is not null and l_extendedprice > 20000, false) then 'valid' else 'invalid' end as side, count(*) as rows from m group by 1"),
    "clean_strings": (q_trim, "select doc_id, lang, source from documents"),
    "dedupe_latest_events": (q_latest_events, f"select user_id, event_id, ts, event_type from {LATEST.format(E)}"),
    "dedupe_latest_lineitem": (q_latest_items, "select l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_extendedprice desc, l_quantity desc) as k from lineitem) where k = 1"),
    "classify_versions": (q_classify, f"select count(*) filter (where t.ts is null) as new, count(*) filter (where b.ts > t.ts) as newer, count(*) filter (where b.ts = t.ts) as same, count(*) filter (where b.ts < t.ts) as late from ({E} where {S_MIDDLE}) b left join {LATEST.format(E + ' where user_id % 5 <> 0 and ' + S_EARLY)} t on b.user_id = t.user_id"),
    "reconcile_versions": (q_reconcile, """with s as (select user_id, max(ts) as s from events group by 1), h as (select user_id, max(ts) as h from events where event_type <> 'error' and user_id % 7 <> 0 group by 1),
q as (select user_id, bool_or(ts = s) as explained from (select user_id, ts from events where event_type = 'error') join s using (user_id) group by 1),
j as (select s.user_id, s, h, q.user_id is not null as q, coalesce(explained, false) as explained from s left join h using (user_id) left join q on q.user_id = s.user_id)
select count(*) as source, count(h) as in_silver, count(*) filter (where h is null and q) as quarantined_only, count(*) filter (where h is null and not q) as missing, count(*) filter (where h < s and explained) as stale_explained, count(*) filter (where h < s and not explained) as stale_unexplained, count(*) filter (where h > s) as ahead from j"""),
    "dim_date": (q_dim_date, "select cast(strftime(d, '%Y%m%d') as int) as date_key, cast(d as date) as date_day, cast(year(d) as int) as year, cast(month(d) as int) as month, strftime(d, '%b') as month_name, cast(isodow(d) as int) as day_of_week, isodow(d) >= 6 as is_weekend from generate_series(timestamp '2016-01-01', timestamp '2030-12-31', interval 1 day) t(d)"),
    "scd2_user_dim": (q_scd2, "select user_id, event_type, ts as valid_from, coalesce(lead(ts) over w, timestamp '9999-12-31 00:00:00') as valid_to, lead(ts) over w is null as is_current from events window w as (partition by user_id order by ts)"),
    "scd2_snapshot": (q_scd2_snapshot, f"""with v as (select user_id, event_type, ts from {_early} union select user_id, event_type, ts from {LATEST.format(E + " where ts < timestamp '2024-01-25 00:00:00'")} union select user_id, event_type, ts from {LATEST.format(E)})
select user_id, event_type, ts as valid_from, lead(ts) over (partition by user_id order by ts) as valid_to, md5(user_id::varchar || '|' || ts::varchar) as scd_id from v"""),
    "fact_pit_join": (q_fact_pit, "with v as (select user_id, event_id, ts, coalesce(lead(ts) over (partition by user_id order by ts), timestamp '9999-12-31 00:00:00') as e from events), o as (select o_orderkey, o_custkey % 150 as user_id, o_orderdate + interval 10227 day as moment from orders) select o_orderkey, o.user_id, moment, event_id as version_id from o left join v on v.user_id = o.user_id and moment >= ts and moment < e"),
    "fact_incremental_filter": (q_fact_filter, "with e as (select o_orderkey, o_orderdate from orders where o_orderdate < timestamp '1999-01-01 00:00:00' and o_orderkey % 13 <> 0) select o_orderkey, o_orderdate from orders where o_orderdate >= (select max(o_orderdate) from e) or o_orderkey not in (select o_orderkey from e)"),
    "fact_delete_insert": (q_fact_delete_insert, "select l_orderkey, l_linenumber, case when l_orderkey % 10 = 0 then l_extendedprice else 0.0 end as l_extendedprice from lineitem"),
    "rolling_7_revenue": (q_rolling, "with d as (select o_orderdate::date as date_day, sum(o_totalprice::decimal(18,2)) as r from orders group by 1) select date_day, r::double as revenue, round((sum(r) over w / count(*) over w)::decimal(38,6), 2)::double as rolling_7 from d window w as (order by date_day rows between 6 preceding and current row)"),
    "status_pivot": (q_pivot, "select o_orderpriority, nullif(count(*) filter (where o_orderstatus = 'F'), 0) as F, nullif(count(*) filter (where o_orderstatus = 'O'), 0) as O, nullif(count(*) filter (where o_orderstatus = 'P'), 0) as P from orders group by 1"),
    "unpivot_kpis": (q_unpivot, "with o as (select o_orderstatus, count(*) as orders, count(distinct o_custkey) as customers from orders group by 1) select o_orderstatus, 'orders' as metric, orders as value from o union all select o_orderstatus, 'customers', customers from o"),
    "retention_weighted_avg": (q_retention_avg, "select months_since_first, round((100.0 * sum(active_customers)::double / nullif(sum(cohort_size)::double, 0))::decimal(38,6), 2)::double as retention_pct from (" + RETENTION_SQL + ") where months_since_first between 1 and 12 group by 1"),
    "key_distribution": (q_shares, "select l_suppkey, count(*) as rows, round((count(*)::double / (select count(*) from lineitem))::decimal(38,6), 6)::double as share from lineitem group by 1 order by rows desc, l_suppkey limit 5"),
    "salted_join": (_joined(lambda a, b: joins.salted(a, b, "k", 8)), JOIN_SQL),
    "broadcast_join": (_joined(lambda a, b: joins.small_join(a, b, "k")), JOIN_SQL),
    "smj_join": (_joined(lambda a, b: joins.merge_join(a, b, "k")), JOIN_SQL),
    "task_durations": (q_run_stats, "select event_type as task, count(*) as runs, round(quantile_cont(value, 0.5)::decimal(38,6), 4)::double as median, round(quantile_cont(value, 0.95)::decimal(38,6), 4)::double as p95, arg_max(user_id, event_id) as last_run from events group by 1"),
    "flow_paths": (q_flow_paths, "select user_id as run_id, count(*) as tasks, count(*) filter (where event_type = 'error') as failed, min(event_id) filter (where event_type = 'error') as first_failed, string_agg(event_type, ' > ' order by event_id) as path from events group by 1"),
    "bronze_insert_only_merge": (q_bronze_insert_only, E),
    "silver_upsert_newer": (q_silver_upsert, NEWER.format(NEWER.format(f"select * from {_mid}", f"select * from {_all3}"), f"select * from {_early}")),
    "change_feed": (q_change_feed, f"""with a as {_early}, b as {_all3}, ins as (select b.user_id from b where user_id not in (select user_id from a)), upd as (select b.user_id from b join a on a.user_id = b.user_id where b.ts > a.ts), t as (select user_id from a union select user_id from b)
select * from (select 2::bigint as _commit_version, 'insert' as _change_type, count(*) as rows from ins union all select 2, 'update_preimage', count(*) from upd union all select 2, 'update_postimage', count(*) from upd union all select 3, 'delete', count(*) from t where user_id % 10 = 1) where rows > 0"""),
    "time_travel_as_of": (q_time_travel, f"{E} where {S_EARLY}"),
    "compaction_preserves_rows": (q_compaction, E),
    "restore_version": (q_restore, E),
    "delete_window": (q_delete_window, f"{E} where not (ts >= timestamp '2024-01-10 00:00:00' and ts < timestamp '2024-01-15 00:00:00')"),
    "jdbc_roundtrip": (q_jdbc, "select * from supplier where s_acctbal > 0"),
    "backfill_chunks": (q_backfill_chunks, "select cast(floor((epoch(ts) - epoch(timestamp '2024-01-01')) / 604800) as int) as chunk, count(*) as n from events where ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-31' group by 1"),
    "json_property": (q_json_keys, "select event_id, (props ->> '$.k')::int as k from events"),
    "scalar_forms": (q_normal_forms, "select o_orderkey, strftime(o_orderdate, '%Y-%m') as month, o_orderpriority[1:3] as short, concat_ws(', ', o_orderstatus, o_orderpriority) as both, printf('%05d', o_custkey) as padded, try_cast(o_orderpriority as int) as number from orders"),
}

QUERIES = {k: run_sql(v) for k, v in SHARED.items()} | {k: f for k, (f, _) in PAIRED.items()}
ORACLES = {k: re.sub(r"\{(\w+)\}", r"\1", v) for k, v in SHARED.items()} | {k: s for k, (_, s) in PAIRED.items()}
