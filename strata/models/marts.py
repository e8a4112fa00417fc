"""Star schema and business aggregates over orders and their items.

Orders with status P take the part of canceled ones.  Sums of money are sums of
decimals, so they do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import joins, versions
from ..operators.ranks import global_rank
from .registry import model

EXCLUDED = "P"
LATE_DAYS = 30


@model("customer")
def customer_versions(customer: DataFrame) -> DataFrame:
    """Versions of customers: every third one changed segment in 1998, so some orders have an older version."""
    first = customer.select("c_custkey", F.col("c_mktsegment").alias("segment"), F.lit("1900-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"))
    moved = customer.filter("c_custkey % 3 = 0").select("c_custkey", F.concat(F.lit("NEW "), "c_mktsegment").alias("segment"), F.lit("1998-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"))
    return first.unionByName(moved)


@model("customer_versions", table=True)
def dim_customer(customer_versions: DataFrame) -> DataFrame:
    """Versions with the time they hold; the open one until the end of time."""
    v = versions.validity(customer_versions, ["c_custkey"], "updated_at", F.lit(S.OPEN_END).cast("timestamp_ntz"))
    key = F.md5(F.concat(F.col("c_custkey").cast("string"), F.lit("|"), F.date_format("valid_from", "yyyyMMdd")))
    return v.select(key.alias("customer_key"), F.col("c_custkey").alias("customer_id"), "segment", "valid_from", "valid_to", "is_current")


@model("part")
def dim_product(part: DataFrame) -> DataFrame:
    return part.select(F.md5(F.col("p_partkey").cast("string")).alias("product_key"), F.col("p_partkey").alias("product_id"), F.coalesce("p_brand", F.lit("unknown")).alias("category"))


@model("lineitem", "orders")
def items_with_orders(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    late = F.col("l_shipdate") > F.col("o_orderdate") + F.expr(f"interval {LATE_DAYS} days")
    joined = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("o_orderkey").alias("order_id"), F.col("l_linenumber").alias("order_item_id"), F.col("o_custkey").alias("customer_id"), "l_partkey", "l_suppkey", F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderdate").alias("purchased_at"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), (F.col("l_extendedprice") * F.col("l_tax")).cast("decimal(18,6)").alias("freight"),
        F.datediff("l_shipdate", "o_orderdate").alias("delivery_days"), F.when(late, 1).otherwise(0).alias("is_late"))


@model("items_with_orders", "dim_customer", table=True)
def fact_orders(items: DataFrame, dim_customer: DataFrame) -> DataFrame:
    """An item sold, with the version of its customer that held at the purchase (null where none did)."""
    held = dim_customer.select("customer_key", "customer_id", "valid_from", "valid_to")
    f = joins.point_in_time(items, held, "customer_id", "purchased_at")
    return f.select(
        S.surrogate(*[F.col(c) for c in ("order_id", "order_item_id", "l_partkey", "l_suppkey", "delivery_days")]).alias("order_item_key"), "order_id", "order_item_id", "customer_id", "customer_key",
        F.md5(F.col("l_partkey").cast("string")).alias("product_key"), F.md5(F.col("l_suppkey").cast("string")).alias("seller_key"), S.date_key(F.col("purchased_at")).alias("date_key"),
        "order_status", "purchased_at", "price", "freight", "delivery_days", "is_late")


@model("orders", table=True)
def fact_payments(orders: DataFrame) -> DataFrame:
    key = S.surrogate(F.col("o_orderkey"), F.lit(1))
    return orders.select(key.alias("payment_key"), F.col("o_orderkey").alias("order_id"), F.lit(1).alias("payment_sequential"), F.col("o_orderpriority").alias("payment_type"), F.col("o_totalprice").alias("payment_value"), S.date_key(F.col("o_orderdate")).alias("date_key"))


@model("fact_orders")
def sales(fact_orders: DataFrame) -> DataFrame:
    """Items that count; an order without a status does not."""
    return fact_orders.filter(F.col("order_status") != EXCLUDED)


@model("sales", table=True)
def agg_daily_sales(sales: DataFrame) -> DataFrame:
    by_order = sales.groupBy("order_id", F.col("purchased_at").cast("date").alias("date_day")).agg(F.count("*").alias("n"), F.sum("price").alias("r"), F.sum("freight").alias("f"), F.sum("is_late").alias("late"))
    return by_order.groupBy("date_day").agg(F.count("*").alias("orders"), F.sum("n").alias("items_sold"), S.money(F.sum("r")).alias("revenue"), S.money(F.sum("f")).alias("freight"), F.sum("late").alias("late_deliveries"))


@model("sales", "dim_product", table=True)
def agg_category_revenue(sales: DataFrame, dim_product: DataFrame) -> DataFrame:
    both = sales.join(dim_product, "product_key")
    return both.groupBy("category").agg(F.count_distinct("order_id").alias("orders"), S.money(F.sum("price")).alias("revenue"), S.money(F.sum("delivery_days") / F.count("delivery_days"), 1).alias("avg_delivery_days"))


@model("sales", "dim_product", table=True)
def agg_product_sales(sales: DataFrame, dim_product: DataFrame) -> DataFrame:
    """Products with rank and share of revenue; the total comes from an aggregate and ranks from ranges of revenue."""
    by = sales.groupBy("product_key").agg(
        F.count_distinct("order_id").alias("orders"), F.count("*").alias("units_sold"), F.sum("price").cast("decimal(28,2)").alias("r"), F.min(F.col("purchased_at").cast("date")).alias("first_sale"), F.max(F.col("purchased_at").cast("date")).alias("last_sale"))
    total = by.agg(F.sum("r").alias("t"))
    out = global_rank(by, "r", "revenue_rank").crossJoin(F.broadcast(total)).join(dim_product, "product_key")
    return out.select("product_id", "category", "orders", "units_sold", F.col("r").cast("double").alias("revenue"), S.money(F.col("r").cast("double") / F.col("units_sold")).alias("avg_price"), "first_sale", "last_sale", "revenue_rank", S.money(100.0 * F.col("r").cast("double") / F.col("t").cast("double"), 3).alias("revenue_share_pct"))


@model("sales")
def customer_months(sales: DataFrame) -> DataFrame:
    """What each customer bought a month, with the month of the first purchase."""
    by_order = sales.groupBy("order_id", "customer_id").agg(F.min("purchased_at").alias("at"), F.count("*").alias("items"), F.sum("price").alias("r"), F.sum("freight").alias("f"), F.max("is_late").alias("late"))
    by = by_order.groupBy("customer_id", S.month_of(F.col("at")).alias("month")).agg(F.count("*").alias("orders"), F.sum("items").alias("items"), F.sum("r").alias("r"), F.sum("f").alias("f"), F.sum("late").alias("late"))
    born = by.groupBy("customer_id").agg(F.min("month").alias("cohort_month"))
    return by.join(born, "customer_id")


@model("customer_months", table=True)
def agg_monthly_kpis(customer_months: DataFrame) -> DataFrame:
    fresh, n = F.col("cohort_month") == F.col("month"), F.sum("orders")
    return customer_months.groupBy("month").agg(
        n.alias("orders"), F.count("*").alias("customers"), F.count_if(fresh).alias("new_customers"), F.count_if(~fresh).alias("returning_customers"), F.sum("items").alias("items_sold"),
        S.money(F.sum("r")).alias("revenue"), S.money(F.sum("f")).alias("freight"), S.money(F.sum("r").cast("double") / n).alias("avg_order_value"), S.money(100.0 * F.sum("late").cast("double") / n, 1).alias("late_delivery_pct"))


@model("customer_months", table=True)
def agg_customer_retention(customer_months: DataFrame) -> DataFrame:
    """Customers of a cohort who buy again, by months since their first purchase; its size is that of month 0."""
    later = S.months_between(F.col("cohort_month"), F.col("month"))
    active = customer_months.groupBy("cohort_month", later.alias("months_since_first")).agg(F.count("*").alias("active_customers"))
    size = active.filter("months_since_first = 0").select("cohort_month", F.col("active_customers").alias("cohort_size"))
    return active.join(size, "cohort_month").select("cohort_month", "months_since_first", "cohort_size", "active_customers", S.share(F.col("active_customers"), F.col("cohort_size"), 1).alias("retention_pct"))


@model("agg_customer_retention")
def retention_matrix(agg_customer_retention: DataFrame) -> DataFrame:
    """Retention of each cohort in the first year, a column a month."""
    first = agg_customer_retention.filter("months_since_first between 0 and 12")
    return first.groupBy("cohort_month").pivot("months_since_first", list(range(13))).agg(F.first("retention_pct")).select("cohort_month", *[F.col(f"`{k}`").alias(f"month_{k}") for k in range(13)])


@model("agg_daily_sales", "agg_monthly_kpis", "agg_product_sales", "agg_customer_retention")
def aggregates_disagree(daily: DataFrame, monthly: DataFrame, products: DataFrame, retention: DataFrame) -> DataFrame:
    """No row if revenue is the same by day, month and product, orders by day and month, and cohorts start whole."""
    sums = [daily.agg(F.sum("revenue").alias("daily_revenue"), F.sum("orders").alias("daily_orders")), monthly.agg(F.sum("revenue").alias("monthly_revenue"), F.sum("orders").alias("monthly_orders")),
            products.agg(F.sum("revenue").alias("product_revenue")), retention.filter("months_since_first = 0 and retention_pct <> 100").agg(F.count("*").alias("cohorts_not_100"))]
    row = sums[0]
    for one in sums[1:]:  # a row each
        row = row.crossJoin(one)
    near = lambda a, b: F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))) <= 0.05
    fine = near(F.col("daily_revenue"), F.col("monthly_revenue")) & near(F.col("daily_revenue"), F.col("product_revenue")) & F.col("daily_orders").eqNullSafe(F.col("monthly_orders")) & (F.col("cohorts_not_100") == 0)
    return row.filter(~fine)


@model("agg_monthly_kpis")
def business_headline(agg_monthly_kpis: DataFrame) -> DataFrame:
    """Totals; customers are those who were new in some month, so each counts once."""
    return agg_monthly_kpis.agg(F.sum("orders").alias("orders"), F.sum("new_customers").alias("customers"), S.money(F.sum("revenue"), 1).alias("revenue"), S.money(F.sum("revenue") / F.sum("orders"), 1).alias("avg_order_value"))
