"""Spend reports over the summary."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tagledger.constants import RULE_FIELDS, SUCCEEDED, TAGGABLE
from tagledger.functions.predicates import not_taggable_reason
from tagledger.functions.workload import days_since
from tagledger.operators.summary import summary_window, workload_rollup


def _whole(cost: Column) -> Column:
    return F.round(cost, 0)


def _percent(part: Column, whole: Column) -> Column:
    return F.round(F.lit(100) * part / F.nullif(whole, F.lit(0)), 1)


def _where(condition: Column, cost: str = "cost") -> Column:
    return F.sum(F.when(condition, F.col(cost)).otherwise(F.lit(0)))


def kpi_summary(summary: DataFrame, keys: Sequence[str], as_of: dt.date, days: int,
                workspaces: Sequence[str] | None = None) -> DataFrame:
    """Total and untagged cost, the share, and how many workload ids are untagged."""
    untagged = F.col("is_untagged")
    cost, missing = F.sum("cost"), _where(untagged)
    return workload_rollup(summary, keys, as_of, days, workspaces, text=()).agg(
        _whole(cost).alias("total_cost"),
        _whole(missing).alias("untagged_cost"),
        _percent(missing, cost).alias("pct_untagged"),
        F.count_distinct(F.when(untagged, F.col("workload_id"))).alias("untagged_workloads"),
    )


def by_product(summary: DataFrame, keys: Sequence[str], as_of: dt.date, days: int,
               workspaces: Sequence[str] | None = None) -> DataFrame:
    """Cost split per product, largest untagged first. Products whose rounded
    total is 0 are left out."""
    untagged = F.col("is_untagged")
    cost, missing = F.sum("cost"), _where(untagged)
    return (
        workload_rollup(summary, keys, as_of, days, workspaces, text=())
        .groupBy("product")
        .agg(
            _whole(cost).alias("total_cost"),
            _whole(missing).alias("untagged_cost"),
            _whole(_where(~untagged)).alias("tagged_cost"),
            _percent(missing, cost).alias("pct_untagged"),
        )
        .filter(F.col("total_cost") > 0)
        .orderBy(F.desc("untagged_cost"), "product")
    )


def product_risk(products: DataFrame) -> DataFrame:
    """Risk band and bar length per product of ``by_product``: high from 95 %
    untagged, medium from 70 %; bar relative to the largest untagged cost, at
    least 2. The maximum is a scalar subquery, one number for the whole plan."""
    largest = products.agg(F.max("untagged_cost").alias("m")).scalar()
    top = F.when(largest > 0, largest).otherwise(F.lit(1))
    pct = F.coalesce(F.col("pct_untagged"), F.lit(0))
    return products.select(
        "*",
        F.when(pct >= 95, "high").when(pct >= 70, "medium").otherwise("low").alias("risk"),
        F.greatest(F.lit(2), F.round(F.lit(100) * F.col("untagged_cost") / top, 0).cast("int"))
        .alias("bar"),
    )


def tagged_live_adjustment(queue: DataFrame, key: str,
                           workspaces: Sequence[str] | None = None) -> DataFrame:
    """Workloads tagged since the snapshot, from the queue (of some workspaces):
    each id counts once at its highest cost."""
    if workspaces:
        queue = queue.filter(F.col("workspace_id").isin(*workspaces))
    return (
        queue.filter((F.col("status") == SUCCEEDED) & (F.col("tag_key") == key))
        .groupBy("workload_id").agg(F.max("list_cost").alias("list_cost"))
        .agg(F.count(F.lit(1)).alias("workloads"), _whole(F.sum("list_cost")).alias("cost"))
    )


def kpi_live(summary: DataFrame, queue: DataFrame, key: str, as_of: dt.date, days: int,
             workspaces: Sequence[str] | None = None) -> DataFrame:
    """``kpi_summary`` with the live credit taken off, never below 0. The two
    one-row inputs are stacked and folded into one row, so no join is needed."""
    base = kpi_summary(summary, [key], as_of, days, workspaces)
    live = tagged_live_adjustment(queue, key, workspaces).select(
        F.col("cost").alias("live_cost"), F.col("workloads").alias("live_workloads"))
    one = base.unionByName(live, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in
          ("total_cost", "untagged_cost", "untagged_workloads", "live_cost", "live_workloads")])
    total, credit = F.col("total_cost"), F.coalesce("live_cost", F.lit(0))
    left = F.greatest(F.lit(0), F.coalesce("untagged_cost", F.lit(0)) - credit)
    credited = F.coalesce("live_workloads", F.lit(0))
    everything = credit + left
    return one.select(
        "total_cost",
        _whole(left).alias("untagged_cost"),
        F.greatest(F.lit(0), F.col("untagged_workloads") - credited).alias("untagged_workloads"),
        F.coalesce(_percent(left, total), F.lit(0)).alias("pct_untagged"),
        _whole(credit).alias("tagged_live_cost"),
        credited.alias("tagged_live_workloads"),
        F.coalesce(_percent(credit, everything), F.lit(0)).alias("pct_tagged_live"),
    )


def not_taggable_breakdown(summary: DataFrame, key: str, as_of: dt.date, days: int,
                           workspaces: Sequence[str] | None = None) -> DataFrame:
    """Untagged cost that no direct tag can cover, per product and reason."""
    return (
        workload_rollup(summary, [key], as_of, days, workspaces, text=())
        .filter(F.col("is_untagged") & (F.col("cost") > 0))
        .withColumn("reason", not_taggable_reason())
        .filter(F.col("reason") != TAGGABLE)
        .groupBy("product", "reason")
        .agg(F.count(F.lit(1)).alias("workloads"), _whole(F.sum("cost")).alias("cost"))
        .orderBy(F.desc("cost"), "product", "reason")
    )


def reason_rollup(breakdown: DataFrame) -> DataFrame:
    """``not_taggable_breakdown`` summed over products."""
    return breakdown.groupBy("reason").agg(
        F.sum("workloads").alias("workloads"), F.sum("cost").alias("cost"))


def distinct_field_values(summary: DataFrame, field: str, as_of: dt.date, days: int,
                          workspaces: Sequence[str] | None = None,
                          limit: int | None = None) -> DataFrame:
    """Values a rule on ``field`` can pick from, in alphabetical order, the first
    ``limit`` if given. An unknown field means owner."""
    column = RULE_FIELDS.get(field, "owner")
    found = (
        summary_window(summary, as_of, days, workspaces)
        .filter(F.col(column).isNotNull() & (F.col(column) != ""))
        .groupBy(F.col(column).alias("value"))
        .agg(_whole(F.sum("list_cost")).alias("cost"),
             F.count_distinct("workload_id").alias("workloads"))
        .orderBy(F.lower("value"), "value")
    )
    return found if limit is None else found.limit(limit)


def explore(rows: DataFrame, as_of: dt.date, min_cost: float = 0, active_within: int = 0,
            text: str = "", sort_by: str = "cost") -> DataFrame:
    """Filter and order a list of workloads: least cost, active within so many
    days (0 = any), text in the name (the id when there is no name) or owner."""
    age = days_since(F.col("last_seen"), as_of)
    keep = F.coalesce(F.col("cost"), F.lit(0)) >= F.lit(min_cost)
    if active_within:
        keep = keep & (F.coalesce(age, F.lit(2**31 - 1)) <= active_within)
    needle = text.strip()
    if needle:
        wanted = F.lower(F.lit(needle))
        hit = F.contains(F.lower(F.coalesce("workload_name", "workload_id")), wanted)
        if "owner" in rows.columns:
            hit = hit | F.contains(F.lower(F.coalesce("owner", F.lit(""))), wanted)
        keep = keep & hit
    order = {
        "cost": F.desc_nulls_last("cost"),
        "latest": F.desc_nulls_last("last_seen"),
        "name": F.coalesce("workload_name", F.lit("")),
    }[sort_by]
    return rows.filter(keep).orderBy(order, "product", "workload_id")
