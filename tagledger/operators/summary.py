"""Raw usage and list prices -> one row per workload and day."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tagledger.constants import SUMMARY_DAYS
from tagledger.functions import workload as W
from tagledger.functions.predicates import carries_key
from tagledger.schemas import MONEY, QUANTITY, RATE

DAY_KEY = ("usage_date", "workspace_id", "product", "workload_id")
WORKLOAD_KEY = ("product", "workload_id")


def usage_window(usage: DataFrame, as_of: dt.date, days: int = SUMMARY_DAYS,
                 unit: str = "DBU") -> DataFrame:
    """Usage records of the window in the wanted unit. Both conditions compare
    a stored column with a literal, so they reach the scan."""
    floor = as_of - dt.timedelta(days=days)
    return usage.filter((F.col("usage_date") >= F.lit(floor)) & (F.col("usage_unit") == unit))


def workload_records(usage: DataFrame) -> DataFrame:
    """The few flat columns the summary needs, null workloads dropped."""
    return usage.select(
        "usage_date",
        "workspace_id",
        F.col("billing_origin_product").alias("product"),
        W.workload_id().alias("workload_id"),
        W.workload_name().alias("workload_name"),
        W.owner().alias("owner"),
        F.coalesce(F.col("product_features.is_serverless").cast("int"), F.lit(0)).alias("is_serverless"),
        "sku_name",
        W.tag_keys().alias("tag_keys"),
        F.col("usage_quantity").cast(QUANTITY).alias("dbus"),
    ).filter(F.col("workload_id").isNotNull())


def current_prices(list_prices: DataFrame, on_duplicate: str = "error") -> DataFrame:
    """Open price per SKU. More than one open price would multiply cost, so it
    is an error unless ``on_duplicate`` is "latest" (the one that started last)
    or "keep" (each counts).

    The SKU comes out as a maximum, equal to the grouping key but not known to
    be. A join by SKU then shuffles these rows afresh, and only a join of two
    plain shuffles is open to skew handling."""
    open_prices = list_prices.filter(F.col("price_end_time").isNull()).select(
        "sku_name", F.col("pricing")["default"].alias("rate"), "price_start_time")
    if on_duplicate == "keep":
        return open_prices.drop("price_start_time")
    if on_duplicate not in ("error", "latest"):
        raise ValueError(f"on_duplicate must be error, latest or keep, not {on_duplicate!r}")
    per_sku = open_prices.groupBy(F.col("sku_name").alias("_sku")).agg(
        F.max("sku_name").alias("sku_name"),
        F.max(F.struct("price_start_time", "rate"))["rate"].alias("rate"),
        F.count(F.lit(1)).alias("_open"))
    if on_duplicate == "latest":
        return per_sku.select("sku_name", "rate")
    message = F.concat(F.lit("more than one open price for SKU "), F.col("sku_name"))
    only = F.when(F.col("_open") == 1, F.col("rate")).otherwise(F.raise_error(message).cast(RATE))
    return per_sku.select("sku_name", only.alias("rate"))


def daily_summary(usage: DataFrame, list_prices: DataFrame, as_of: dt.date,
                  days: int = SUMMARY_DAYS, on_duplicate: str = "error") -> DataFrame:
    """Cost and tag keys per day, workspace, product and workload.

    Two steps. The first groups by everything but the quantity, so its only
    buffer is one sum: it runs as a hash aggregate inside the scan stage and
    shrinks a hot workload before anything is shuffled. Prices are joined to
    that small result, not to raw records; Spark broadcasts them if their size
    allows and otherwise joins by SKU, where skew-join handling applies. The
    second step takes the maxima and the union of the distinct key sets. The
    quantity has one type from the start: a product of DECIMAL(27,6) and
    DECIMAL(10,4) just fits 38 digits and is not rounded."""
    records = workload_records(usage_window(usage, as_of, days))
    condensed = records.groupBy(
        *DAY_KEY, "workload_name", "owner", "is_serverless", "tag_keys", "sku_name",
    ).agg(F.sum("dbus").cast("decimal(27,6)").alias("dbus"))
    priced = condensed.join(current_prices(list_prices, on_duplicate), "sku_name", "left")
    cost = (F.col("dbus") * F.coalesce(F.col("rate"), F.lit(0).cast(RATE))).cast(MONEY)
    key_sets = F.collect_set("tag_keys")
    no_price = F.when(F.col("rate").isNull(), F.col("dbus")).otherwise(F.lit(0))
    return priced.groupBy(*DAY_KEY).agg(
        F.max("workload_name").alias("workload_name"),
        F.max("owner").alias("owner"),
        F.max("is_serverless").alias("is_serverless"),
        F.sort_array(F.array_distinct(F.flatten(key_sets))).alias("tag_keys"),
        F.sum("dbus").cast("decimal(38,6)").alias("dbus"),
        F.sum(cost).cast(MONEY).alias("list_cost"),
        F.sum(no_price).cast("decimal(38,6)").alias("unpriced_dbus"),
    )


def summary_window(summary: DataFrame, as_of: dt.date, days: int,
                   workspaces: Sequence[str] | None = None) -> DataFrame:
    """Summary rows of the last ``days`` days; the literal floor prunes the
    ``usage_date`` partitions."""
    rows = summary.filter(F.col("usage_date") >= F.lit(as_of - dt.timedelta(days=int(days))))
    return rows.filter(F.col("workspace_id").isin(*workspaces)) if workspaces else rows


TEXT = ("workspace_id", "workload_name", "owner")


def workload_rollup(summary: DataFrame, keys: Sequence[str], as_of: dt.date, days: int,
                    workspaces: Sequence[str] | None = None,
                    text: Sequence[str] = TEXT) -> DataFrame:
    """One row per product and workload over the window, with the ``text``
    columns asked for; the result stays partitioned by the workload key, which
    later joins reuse.

    The maximum of a string cannot be kept in a hash aggregate. Text columns
    therefore are grouping keys of a first step, which leaves a row or two per
    workload, and only those are sorted. Without text one step is enough.
    Numbers the caller does not use are pruned."""
    rows = summary_window(summary, as_of, days, workspaces).withColumns({
        "_carries": carries_key(keys), "cost": F.col("list_cost"), "last_seen": F.col("usage_date")})

    def numbers():
        return [F.max("is_serverless").alias("is_serverless"), F.max("last_seen").alias("last_seen"),
                F.max("_carries").alias("_carries"), F.sum("cost").cast(MONEY).alias("cost")]

    if text:
        rows = rows.groupBy(*WORKLOAD_KEY, *text).agg(*numbers())
    return (
        rows.groupBy(*WORKLOAD_KEY).agg(*[F.max(c).alias(c) for c in text], *numbers())
        .withColumn("is_untagged", ~F.col("_carries")).drop("_carries")
    )


def summary_freshness(summary: DataFrame) -> DataFrame:
    return summary.agg(F.max("usage_date").alias("as_of"), F.count(F.lit(1)).alias("rows"))
