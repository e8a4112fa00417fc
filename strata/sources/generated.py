"""Made-up shop data, changes to it, and skewed join sides; every column is a function of its row's number and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shares of order states and of payment types, in thousandths, and sizes.
STATES = {"delivered": 900, "shipped": 40, "processing": 20, "canceled": 20, "approved": 20}
PAYMENTS = {"credit_card": 740, "boleto": 190, "voucher": 50, "debit_card": 20}
ORDERS, PRODUCTS, SELLERS, WITHOUT_CATEGORY = 20_000, 2_000, 200, 40
SEED = 42


def _draw(salt: str, below: int, seed: int = SEED, of: str = "id") -> Column:
    return F.pmod(F.xxhash64(of, F.lit(salt), F.lit(seed)), F.lit(below)).cast("int")


def _pick(shares: dict[str, int], salt: str, seed: int) -> Column:
    x, upto, out = _draw(salt, 1000, seed), 0, None
    for name, share in shares.items():
        upto += share
        out = F.when(x < upto, name) if out is None else out.when(x < upto, name)
    return out


def shop(spark: SparkSession, orders: int = ORDERS, seed: int = SEED) -> dict[str, DataFrame]:
    """Six source tables; the same seed gives the same rows, whatever the partitions."""
    n = spark.range(orders)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    at = start + F.make_dt_interval(_draw("day", 500, seed), _draw("hour", 24, seed))
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    status = _pick(STATES, "status", seed)
    o = n.select(
        "id", name("o", F.col("id")).alias("order_id"), name("c", F.col("id")).alias("customer_id"), status.alias("order_status"), at.alias("order_purchase_timestamp"),
        F.when(status == "delivered", at + F.make_dt_interval(_draw("took", 23, seed) + 3)).alias("order_delivered_customer_date"), (at + F.make_dt_interval(_draw("due", 21, seed) + 10)).alias("order_estimated_delivery_date"), at.alias("updated_at"))
    size = F.when(_draw("size", 100, seed) < 80, 1).when(_draw("size", 100, seed) < 95, 2).otherwise(3)
    i = n.select("id", F.explode(F.sequence(F.lit(1).cast("long"), size.cast("long"))).alias("order_item_id")).withColumn("line", F.concat_ws("-", "id", "order_item_id"))
    i = i.select(
        name("o", F.col("id")).alias("order_id"), "order_item_id", name("p", _draw("part", PRODUCTS, seed, "line")).alias("product_id"), name("s", _draw("seller", SELLERS, seed, "line")).alias("seller_id"),
        (_draw("price", 30_000, seed, "line") / 100 + 5).alias("price"), (_draw("freight", 3_000, seed, "line") / 100).alias("freight_value"))
    paid = i.groupBy("order_id").agg(F.round(F.sum(F.col("price").cast("decimal(18,2)")) + F.sum(F.col("freight_value").cast("decimal(18,2)")), 2).cast("double").alias("payment_value"))
    pay = paid.join(n.select(name("o", F.col("id")).alias("order_id"), _pick(PAYMENTS, "pay", seed).alias("payment_type")), "order_id").select("order_id", F.lit(1).cast("long").alias("payment_sequential"), "payment_type", "payment_value")
    state = lambda salt: F.concat(F.char(_draw(salt + "1", 26, seed) + 65), F.char(_draw(salt + "2", 26, seed) + 65))
    c = n.select(name("c", F.col("id")).alias("customer_id"), name("u", F.floor(F.col("id") * 0.8)).alias("customer_unique_id"), name("city", _draw("city", 300, seed)).alias("customer_city"), state("state").alias("customer_state"), F.lit("2016-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"))
    p = spark.range(PRODUCTS).select(name("p", F.col("id")).alias("product_id"), F.when(F.col("id") >= WITHOUT_CATEGORY, name("category", _draw("category", 30, seed))).alias("product_category_name"), (_draw("weight", 9_000, seed) + 100).cast("long").alias("product_weight_g"))
    s = spark.range(SELLERS).select(name("s", F.col("id")).alias("seller_id"), name("city", _draw("city", 300, seed)).alias("seller_city"), state("state").alias("seller_state"))
    return {"orders": o.drop("id"), "order_items": i, "order_payments": pay, "customers": c, "products": p, "sellers": s}


def changed_shop(tables: dict[str, DataFrame], now: Column, delivered: int = 200, moved: int = 100, seed: int = 1) -> dict[str, DataFrame]:
    """The shop later: open orders delivered and customers moved, the first ones in a random order that the seed fixes."""
    def some(df, key, n):
        return df.orderBy(F.rand(seed), key).limit(n) if seed < 0 else df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)

    done = some(tables["orders"].filter("order_status = 'shipped'"), "order_id", delivered).select("order_id", F.lit(True).alias("__hit"))
    gone = some(tables["customers"], "customer_id", moved).select("customer_id", F.lit(True).alias("__hit"))
    hit = F.coalesce("__hit", F.lit(False))
    o = tables["orders"].join(F.broadcast(done), "order_id", "left").withColumns({
        "order_status": F.when(hit, "delivered").otherwise(F.col("order_status")), "order_delivered_customer_date": F.when(hit, now).otherwise(F.col("order_delivered_customer_date")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))})
    c = tables["customers"].join(F.broadcast(gone), "customer_id", "left").withColumns({"customer_city": F.when(hit, F.concat(F.lit("new "), "customer_city")).otherwise(F.col("customer_city")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))})
    return tables | {"orders": o.select(*tables["orders"].columns), "customers": c.select(*tables["customers"].columns)}


def scaled(df: DataFrame, times: int, *keys: str) -> DataFrame:
    """Copies of a table whose keys tell them apart."""
    copies = df.sparkSession.range(times).select(F.col("id").alias("__copy"))
    out = df.crossJoin(F.broadcast(copies))  # a handful of rows
    return out.withColumns({k: F.when(F.col("__copy") > 0, F.concat(F.col(k), F.lit("-"), F.col("__copy").cast("string"))).otherwise(F.col(k)) for k in keys}).drop("__copy")


def skewed(spark: SparkSession, rows: int, keys: int, hot_share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """A big side in which one key has ``hot_share`` of the rows, and a small side of all keys."""
    key = F.format_string("k%05d", F.when(_draw("hot", 1000) < int(hot_share * 1000), F.lit(0)).otherwise(_draw("key", keys)))
    big = spark.range(rows).withColumn("k", key).withColumn("v", (F.col("id") % 100).cast("double"))
    return big, spark.range(keys).select(F.format_string("k%05d", F.col("id").cast("int")).alias("k"), F.concat(F.lit("name"), F.col("id")).alias("name"))
