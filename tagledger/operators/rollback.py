"""Undo a batch from its audit records."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from tagledger import constants as C
from tagledger.operators.apply import (
    audit_id, change_state, refused_by_rule, refused_by_state, with_capability, with_state,
)
from tagledger.schemas import AUDIT, QUEUE_KEY, of_batch

CHANGE_KEY = ("product", "workload_id", "tag_key")


def rollback_plan(audit: DataFrame, batch_id: str, anchor: str = "latest",
                  skip_rolled_back: bool = False) -> DataFrame:
    """What to restore: one row per product, workload and key of the batch,
    from its latest successful SET. ``anchor="earliest"`` restores the value
    from before the batch's first SET instead; ``skip_rolled_back`` leaves out
    keys that already were restored.

    The latest row is a maximum over a struct, which is reduced before the
    shuffle, so a key with many records needs no sort in one task."""
    batch = of_batch(audit, batch_id).filter(F.col("status") == C.SUCCEEDED)
    record = F.struct("executed_at", "audit_id", "workspace_id", "old_value", "new_value")
    old_from = {"latest": F.max, "earliest": F.min}[anchor](record)
    plan = batch.filter(F.col("action") == C.SET).groupBy(*CHANGE_KEY).agg(
        F.max(record).alias("_last"), old_from.alias("_old"),
    ).select(
        F.lit(batch_id).alias("batch_id"), F.col("_last.workspace_id").alias("workspace_id"),
        *CHANGE_KEY, F.col("_old.old_value").alias("old_value"),
        F.col("_last.new_value").alias("new_value"),
    )
    if skip_rolled_back:
        undone = batch.filter(F.col("action") == C.ROLLBACK).select(*CHANGE_KEY).distinct()
        plan = plan.join(undone, list(CHANGE_KEY), "left_anti")
    return plan


def rollback_attempts(plan: DataFrame, tag_state: DataFrame, dry_run: bool = True) -> DataFrame:
    """The plan with status and error: SUCCEEDED, FAILED, or DRY_RUN. Where a product's tags cannot be
    read, the value from before is unknown: nothing is restored, and the row says so."""
    if dry_run:
        return plan.withColumns({
            "status": F.lit(C.DRY_RUN), "error": F.lit(None).cast("string")})
    rows = with_state(with_capability(plan.withColumn("is_serverless", F.lit(0))), tag_state)
    readable = F.coalesce(F.col("can.rollback"), F.lit(False))
    unknown = F.when(~readable, F.struct(F.lit(C.FAILED).alias("status"), F.concat(
        F.lit("PreviousValueUnknown: "), F.col("product"), F.lit(" "), F.col("workload_id")).alias("error")))
    return rows.withColumn("no", F.coalesce(refused_by_rule(), unknown, refused_by_state(readable))).select(
        *plan.columns,
        F.when(F.col("no").isNull(), C.SUCCEEDED).otherwise(C.FAILED).alias("status"),
        F.col("no.error").alias("error"),
    )


def rolled_back_state(tag_state: DataFrame, tried: DataFrame) -> DataFrame:
    """Tag state with the old values back; keys that had none are removed."""
    return change_state(tag_state, tried.filter(F.col("status") == C.SUCCEEDED)
                        .withColumnRenamed("old_value", "tag_value"))


def rollback_audit(tried: DataFrame, now: dt.datetime, executed_by: str,
                   run_token: str) -> DataFrame:
    """Audit rows of a rollback: from the value the batch had set to the value
    restored. A trial run leaves none."""
    return tried.filter(F.col("status") != C.DRY_RUN).select(
        audit_id(run_token, C.ROLLBACK), "batch_id", F.lit(now).alias("executed_at"),
        F.lit(executed_by).alias("executed_by"), "workspace_id", "product", "workload_id", "tag_key",
        F.col("new_value").alias("old_value"), F.col("old_value").alias("new_value"),
        F.lit(C.ROLLBACK).alias("action"), "status", "error",
    ).select(*AUDIT.fieldNames())


def mark_rolled_back(queue: DataFrame, batch_id: str, tried: DataFrame,
                     now: dt.datetime) -> DataFrame:
    """Queue snapshot with the restored rows of the batch set to ROLLED_BACK.
    Only the batch's SUCCEEDED rows are joined; all others pass straight
    through, so the queue itself is never shuffled. The join is by the whole merge key, which the batch is part of,
    so a queue that is stored in buckets of it (``sources.bucketed``) is not shuffled at all."""
    mine = F.coalesce(
        (F.col("batch_id") == batch_id) & (F.col("status") == C.SUCCEEDED), F.lit(False))
    restored = (
        tried.filter(F.col("status") == C.SUCCEEDED)
        .select(*QUEUE_KEY).dropDuplicates().withColumn("_restored", F.lit(True))
    )
    hit = F.col("_restored").isNotNull()
    changed = queue.filter(mine).join(restored, list(QUEUE_KEY), "left").withColumns({
        "status": F.when(hit, C.ROLLED_BACK).otherwise(F.col("status")),
        "executed_at": F.when(hit, F.lit(now)).otherwise(F.col("executed_at")),
    }).select(*queue.columns)
    return queue.filter(~mine).unionByName(changed)
