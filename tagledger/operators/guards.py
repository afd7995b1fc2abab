"""Guards against proposing a workload twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagledger.constants import HANDLED_STATUSES
from tagledger.operators.summary import WORKLOAD_KEY
from tagledger.schemas import of_batch


def _workloads(queue: DataFrame) -> DataFrame:
    """Distinct workloads of some queue rows. Made distinct before the shuffle,
    so a workload that fills the queue still sends one row per task, and the
    result is already partitioned the way the anti join wants it."""
    return queue.select(*WORKLOAD_KEY).distinct()


def not_handled(workloads: DataFrame, queue: DataFrame, key: str) -> DataFrame:
    """Drop workloads that the queue has settled or in flight for this key.
    Rolled back and trial rows leave a workload eligible."""
    handled = queue.filter(
        (F.col("tag_key") == key) & F.col("status").isin(*HANDLED_STATUSES))
    return workloads.join(_workloads(handled), list(WORKLOAD_KEY), "left_anti")


def not_in_batch(workloads: DataFrame, queue: DataFrame, batch_id: str, key: str) -> DataFrame:
    """Drop workloads already queued for this key in one batch."""
    queued = of_batch(queue, batch_id).filter(F.col("tag_key") == key)
    return workloads.join(_workloads(queued), list(WORKLOAD_KEY), "left_anti")
