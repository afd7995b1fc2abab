"""Tag keys as bit sets, so that one stored rollup answers any choice of keys.

Every tag key has a number. A workload's keys of a day are 64-bit words in which the bit of each key is set, a
column per 64 keys. Words of several days are combined by ``bit_or``, in a hash aggregate on numbers; whether a workload
misses all chosen keys is a mask on its words. No array of keys is collected, and a new choice of keys reads the
stored rollup instead of the summary.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagledger.operators.summary import DAY_KEY, WORKLOAD_KEY, summary_window
from tagledger.schemas import MONEY

WORD = 64


def key_numbers(summary: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(tag_key, number) of every key, from 0. With ``known`` numbers, those stay and new keys follow. There are
    as many rows as there are keys in use, which is what the one window is over."""
    found = summary.select(F.explode("tag_keys").alias("tag_key")).where("tag_key IS NOT NULL").distinct()
    start = F.lit(0)
    if known is not None:
        found = found.join(known, "tag_key", "left_anti")
        start = F.coalesce(known.agg(F.max("number") + 1).scalar(), F.lit(0))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("tag_key")) - 1
    numbered = found.withColumn("number", (place + start).cast("int"))
    return numbered if known is None else known.select("tag_key", "number").unionByName(numbered)


def word_columns(keys: int) -> list[str]:
    """Names of the words that hold so many keys; there is always one."""
    return [f"keys_{i}" for i in range(max(1, -(-keys // WORD)))]


def _words_of(number: Column, keys: int) -> dict[str, Column]:
    bit = F.expr(f"shiftleft(1L, number % {WORD})")
    return {name: F.when(F.floor(number / WORD) == i, bit).otherwise(F.lit(0).cast("long")) for i, name in enumerate(word_columns(keys))}


def daily_words(summary: DataFrame, numbers: DataFrame, keys: int) -> DataFrame:
    """Per day and workload its cost and the words of its keys; ``keys`` is how many are numbered. Costs and keys are
    stacked and summed in one aggregate, so nothing is joined back."""
    zero = {name: F.lit(0).cast("long") for name in word_columns(keys)}
    costs = summary.select(*DAY_KEY, F.coalesce("is_serverless", F.lit(0)).alias("is_serverless"), F.col("list_cost").alias("cost"),
                           *[c.alias(n) for n, c in zero.items()])
    held = summary.select(*DAY_KEY, F.explode("tag_keys").alias("tag_key")).join(numbers, "tag_key")
    bits = held.select(*DAY_KEY, F.lit(0).alias("is_serverless"), F.lit(0).cast(MONEY).alias("cost"),
                       *[c.alias(n) for n, c in _words_of(F.col("number"), keys).items()])
    return costs.unionByName(bits).groupBy(*DAY_KEY).agg(
        F.max("is_serverless").alias("is_serverless"), F.sum("cost").cast(MONEY).alias("cost"),
        *[F.bit_or(n).alias(n) for n in zero])


def rollup_words(daily: DataFrame, as_of: dt.date, days: int, workspaces: Sequence[str] | None = None) -> DataFrame:
    """One row per product and workload of the window: cost, last day, and the words of all keys it had."""
    names = [c for c in daily.columns if c.startswith("keys_")]
    return summary_window(daily, as_of, days, workspaces).groupBy(*WORKLOAD_KEY).agg(
        F.max("is_serverless").alias("is_serverless"), F.max("usage_date").alias("last_seen"),
        F.sum("cost").cast(MONEY).alias("cost"), *[F.bit_or(n).alias(n) for n in names])


def misses_all(rollup: DataFrame, numbers: DataFrame, keys: Sequence[str]) -> Column:
    """Does the workload miss all chosen keys (have none at all, when none are chosen)? A key that was never
    numbered is missed by all. The masks are scalar subqueries, one number per word."""
    missing = F.lit(True)
    for i, name in enumerate(c for c in rollup.columns if c.startswith("keys_")):
        held = F.col(name)
        if keys:
            chosen = numbers.where(F.col("tag_key").isin(*keys) & (F.floor(F.col("number") / WORD) == i))
            mask = chosen.agg(F.coalesce(F.bit_or(F.expr(f"shiftleft(1L, number % {WORD})")), F.lit(0).cast("long"))).scalar()
            held = held.bitwiseAND(mask)
        missing = missing & (held == 0)
    return missing


def kpi_of_rollup(rollup: DataFrame, numbers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``reports.kpi_summary`` for any choice of keys, from a stored rollup."""
    untagged = F.col("_untagged")
    cost, missed = F.sum("cost"), F.sum(F.when(untagged, F.col("cost")).otherwise(F.lit(0)))
    return rollup.withColumn("_untagged", misses_all(rollup, numbers, keys)).agg(
        F.round(cost, 0).alias("total_cost"), F.round(missed, 0).alias("untagged_cost"),
        F.round(F.lit(100) * missed / F.nullif(cost, F.lit(0)), 1).alias("pct_untagged"),
        F.count_distinct(F.when(untagged, F.col("workload_id"))).alias("untagged_workloads"))
