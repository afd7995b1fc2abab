"""Whole runs: drain the queue, undo a batch."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, functions as F

from tagledger import constants as C
from tagledger.operators import apply as A, queue as Q, rollback as R
from tagledger.plans.session import work_folder


@dataclass(frozen=True)
class RunResult:
    """Snapshots after a run, the audit rows to append, and how many rows had which status."""

    queue: DataFrame
    tag_state: DataFrame
    audit: DataFrame
    tried: DataFrame
    counts: dict[str, int] = field(default_factory=dict)


def counted(tried: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows with counts taken along as they are written: all, and per status. No job of its own."""
    seen = Observation()
    statuses = (*C.QUEUE_STATUSES, C.DRY_RUN)
    return tried.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses]), seen


def counts_of(seen: Observation) -> dict[str, int]:
    """Statuses that occurred, and ``rows``."""
    return {k: n for k, n in seen.get.items() if n or k == "rows"}


def _stored(rows: DataFrame, name: str) -> DataFrame:
    """Write once, read back: what was tried feeds three results and must not
    be computed three times, nor be lost with an executor."""
    path = work_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def run_writer(queue: DataFrame, tag_state: DataFrame, now: dt.datetime, run_token: str,
               executed_by: str, dry_run: bool = True, workspace_id: str | None = None,
               batch_id: str | None = None) -> RunResult:
    """Claim, apply, and settle the queue. The caller publishes the snapshots."""
    claimed = Q.claim(queue, now, run_token, workspace_id, batch_id)
    taken = queue.filter(Q.claimable(now, workspace_id, batch_id))
    rows, seen = counted(A.attempts(taken, tag_state, dry_run))
    tried = _stored(rows, "attempts")
    return RunResult(
        queue=A.apply_outcomes(claimed, A.outcomes(tried, now), among=Q.claimed_by(run_token)),
        tag_state=A.applied_state(tag_state, tried),
        audit=A.audit_rows(tried, now, executed_by, run_token),
        tried=tried, counts=counts_of(seen),
    )


def run_rollback(queue: DataFrame, tag_state: DataFrame, audit: DataFrame, batch_id: str,
                 now: dt.datetime, run_token: str, executed_by: str, dry_run: bool = True,
                 anchor: str = "latest", skip_rolled_back: bool = False) -> RunResult:
    """Restore what a batch changed. The caller publishes the snapshots."""
    plan = R.rollback_plan(audit, batch_id, anchor, skip_rolled_back)
    rows, seen = counted(R.rollback_attempts(plan, tag_state, dry_run))
    tried = _stored(rows, "rollback")
    return RunResult(
        queue=R.mark_rolled_back(queue, batch_id, tried, now),
        tag_state=R.rolled_back_state(tag_state, tried),
        audit=R.rollback_audit(tried, now, executed_by, run_token),
        tried=tried, counts=counts_of(seen),
    )
