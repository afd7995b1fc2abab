"""How batches of intent are doing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagledger import constants as C
from tagledger.schemas import of_batch


def recent_batches(queue: DataFrame, limit: int | None = None) -> DataFrame:
    """Batches with their row counts per status, latest first. With a ``limit``
    a cheap pass over two columns picks the batches, so that only their rows are counted."""
    names = {
        "pending": C.PENDING, "running": C.RUNNING, "succeeded": C.SUCCEEDED, "failed": C.FAILED,
        "unsupported": C.UNSUPPORTED, "dry_run": C.SKIPPED_DRYRUN, "rolled_back": C.ROLLED_BACK,
    }
    order = [F.desc("enqueued_at"), "batch_id"]
    if limit is not None:
        latest = (
            queue.groupBy("batch_id").agg(F.max("enqueued_at").alias("enqueued_at"))
            .orderBy(*order).limit(limit).select("batch_id")
        )
        queue = queue.join(latest, "batch_id", "left_semi")
    return (
        queue
        .groupBy("batch_id")
        .agg(
            F.max("enqueued_at").alias("enqueued_at"),
            F.max("requested_by").alias("requested_by"),
            F.count(F.lit(1)).alias("rows"),
            F.count_distinct("workload_id").alias("workloads"),
            F.round(F.sum("list_cost"), 0).alias("cost"),
            *[F.count_if(F.col("status") == s).alias(n) for n, s in names.items()],
        )
        .orderBy(*order)
    )


def batch_progress(batches: DataFrame) -> DataFrame:
    """Progress of each batch: the share tagged, or the share reverted once a
    rollback has begun; what is in flight, left over, or not tagged at all."""
    done, back = F.col("succeeded"), F.col("rolled_back")
    in_flight = (F.col("pending") > 0) | (F.col("running") > 0)
    reverting = back > 0

    def share(part, whole):
        return F.when(whole > 0, F.round(F.lit(100) * part / whole, 0)).otherwise(0).cast("int")

    return batches.select(
        "batch_id", "rows", "cost",
        F.when(reverting, share(back, done + back)).otherwise(share(done, F.col("rows"))).alias("pct"),
        reverting.alias("reverting"),
        in_flight.alias("in_flight"),
        (reverting & (done > 0) & ~in_flight).alias("residual"),
        (F.col("failed") + F.col("unsupported")).alias("not_tagged"),
    )


def batch_failure_breakdown(queue: DataFrame, batch_id: str, limit: int | None = None) -> DataFrame:
    """Why rows of a batch were not tagged, by product, status and the error
    text up to its first colon; the ``limit`` most frequent reasons if given."""
    reason = F.coalesce(
        F.nullif(F.trim(F.split("last_error", ":")[0]), F.lit("")), F.lit("unknown"))
    found = (
        of_batch(queue, batch_id).filter(F.col("status").isin(C.FAILED, C.UNSUPPORTED))
        .groupBy("product", "status", reason.alias("reason"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.round(F.sum("list_cost"), 0).alias("cost"),
            F.min("last_error").alias("sample_reason"),
        )
        .orderBy(F.desc("rows"), "product", "status", "reason")
    )
    return found if limit is None else found.limit(limit)


def count_queue_rows(queue: DataFrame, batch_id: str) -> DataFrame:
    return of_batch(queue, batch_id).agg(F.count(F.lit(1)).alias("n"))
