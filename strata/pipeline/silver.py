"""Bronze to Silver: valid rows, one per key, with a quarantine that keeps every rejected version once.

A target's checkpoint is set last, so work that stops in between is done again;
all of it can be done again without a change.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import control, rules, versions
from ..sources.lake import CHANGE_COLUMNS, Commit, LakeTable
from .bronze import METADATA
from .state import StateStore


@dataclass(frozen=True)
class SilverSpec:
    """A table's keys, what tells its versions apart, and its rules; ``incremental`` ones are merged, others made anew."""

    name: str
    keys: Sequence[str]
    version: str
    rules: tuple = ()
    incremental: bool = False
    order: Sequence[str] = ()


def table_specs() -> dict[str, SilverSpec]:
    """Keys and rules of the platform that is imitated."""
    r = rules
    purchase, delivered = "order_purchase_timestamp", "order_delivered_customer_date"
    orders = (*r.required("order_id", "customer_id", purchase, "updated_at"), r.one_of("order_status", ["delivered", "shipped", "processing", "canceled", "approved"]),
              r.that("delivered_after_purchase", f"{delivered} is null or {delivered} >= {purchase}"))
    items = (*r.required("order_id", "order_item_id", "product_id", "seller_id"), r.readable_as("price", "double"), r.that("price_positive", r.number("price") > 0), r.that("freight_not_negative", r.number("freight_value") >= 0))
    payments = (*r.required("order_id", "payment_sequential"), r.one_of("payment_type", ["credit_card", "boleto", "voucher", "debit_card"]), r.that("payment_not_negative", r.number("payment_value") >= 0))
    customers = (*r.required("customer_id", "customer_unique_id"), r.that("state_two_letters", "length(customer_state) = 2"))
    listed = [
        SilverSpec("orders", ("order_id",), "updated_at", orders, True), SilverSpec("order_items", ("order_id", "order_item_id"), "ingestion_ts", items),
        SilverSpec("order_payments", ("order_id", "payment_sequential"), "ingestion_ts", payments), SilverSpec("customers", ("customer_id",), "updated_at", customers),
        SilverSpec("products", ("product_id",), "ingestion_ts", tuple(r.required("product_id"))), SilverSpec("sellers", ("seller_id",), "ingestion_ts", tuple(r.required("seller_id")))]
    return {s.name: s for s in listed}


@dataclass
class Merged:
    mode: str
    why: str
    read: int = 0
    inserted: int = 0
    updated: int = 0
    rejected: int = 0
    duplicates: int = 0
    late: int = 0
    superseded_by_invalid: int = 0


def validate(df: DataFrame, spec: SilverSpec) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the newest valid row of each key, rejected rows, all valid rows): trimmed, then ruled on, then made unique."""
    valid, rejected = rules.apply_rules(rules.trim_strings(df), spec.rules)
    return versions.latest(valid, spec.keys, [spec.version, *spec.order]), rejected, valid


def read_bronze(bronze: LakeTable, mode: str, checkpoint: int | None, upto: int) -> DataFrame:
    """Rows at a version, or those that came or changed since the checkpoint; rows deleted from Bronze stay in Silver."""
    if mode == "full":
        return bronze.df(version=upto)
    feed = bronze.changes(checkpoint + 1, upto)
    return feed.filter(F.col("_change_type").isin("insert", "update_postimage")).drop(*CHANGE_COLUMNS)


def _quarantined(rejected: DataFrame, spec: SilverSpec, quarantine: LakeTable) -> Commit:
    """Add rejected versions that the quarantine lacks; null keys are equal, so a version is never there twice."""
    if not quarantine.exists():
        quarantine.create(rejected.limit(0))
    return quarantine.insert_if_absent(rejected, [*spec.keys, spec.version], evolve=True)


def process(spec: SilverSpec, bronze: LakeTable, silver: LakeTable, quarantine: LakeTable, state: StateStore, force: bool = False) -> Merged:
    """Bring a table's Silver up to Bronze's present version, by its changes where the feed has them."""
    upto, name = bronze.version(), f"silver/{spec.name}"
    if not spec.incremental:
        return _replace(spec, bronze, silver, quarantine, state, upto)
    done = state.checkpoint(name)
    mode, why = control.load_mode(done, upto, bronze.feed_since(), silver.exists(), force)
    if mode == "skip":
        return Merged(mode, why)
    try:
        df = read_bronze(bronze, mode, done, upto)
    except Exception as e:
        if mode == "full":
            raise
        logging.getLogger(__name__).warning("the changes cannot be read", exc_info=True)
        mode, why = "full", f"the changes cannot be read: {e}"
        df = read_bronze(bronze, mode, done, upto)
    fresh, rejected, valid = validate(df, spec)
    before = silver.df() if silver.exists() else None
    keys = list(spec.keys)
    # all counts in one job
    facts = df.agg(F.count("*").alias("read")).crossJoin(valid.agg(F.count("*").alias("valid"))).crossJoin(versions.version_classes(fresh, before, keys, spec.version)).first()
    kept = sum(facts[c] for c in ("new", "newer", "same", "late"))
    if facts["read"] > facts["valid"] or not quarantine.exists():
        _quarantined(rejected.withColumn("quarantined_at", F.current_timestamp().cast("timestamp_ntz")), spec, quarantine)
    if not silver.exists():
        commit = silver.create(fresh)
    else:
        commit = silver.upsert_newer(fresh, keys, spec.version, evolve=True)
    if facts["read"] == facts["valid"]:
        state.set_checkpoint(name, upto, mode)
        return Merged(mode, why, facts["read"], commit.inserted, commit.updated, 0, facts["valid"] - kept, facts["late"], 0)
    # keys whose newest version of this batch was rejected and is newer than what Silver now has
    newest = versions.latest(rejected.drop("failed_rules", "reason"), keys, [spec.version])
    behind = versions.version_classes(newest, silver.df(), keys, spec.version).first()["newer"]
    state.set_checkpoint(name, upto, mode)
    return Merged(mode, why, facts["read"], commit.inserted, commit.updated, facts["read"] - facts["valid"], facts["valid"] - kept, facts["late"], behind)


def _replace(spec, bronze, silver, quarantine, state, upto) -> Merged:
    """Make Silver and the quarantine anew from all of Bronze."""
    df = bronze.df(version=upto)
    fresh, rejected, valid = validate(df, spec)
    total, good = df.count(), valid.count()
    commit = silver.overwrite(fresh, evolve=True)
    quarantine.overwrite(rejected.withColumn("quarantined_at", F.current_timestamp().cast("timestamp_ntz")), evolve=True)
    state.set_checkpoint(f"silver/{spec.name}", upto, "full")
    return Merged("full", "the table is made anew", total, commit.inserted, 0, total - good, good - commit.inserted)


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in METADATA]
