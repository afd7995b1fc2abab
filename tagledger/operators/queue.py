"""Intent: rows for the write queue, and claiming them for a run."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tagledger.constants import PENDING, RUNNING, STALE_CLAIM_MINUTES
from tagledger.functions.rules import complete_rules, covers_key, rule_tags
from tagledger.operators.guards import not_handled, not_in_batch
from tagledger.operators.rule_impact import rule_candidates
from tagledger.operators.rule_index import tags_of
from tagledger.operators.suggestions import with_suggestion
from tagledger.operators.summary import WORKLOAD_KEY
from tagledger.operators.tag_plan import tag_plan
from tagledger.schemas import QUEUE_MONEY, WRITE_QUEUE


def queue_rows(rows: DataFrame, batch_id: str, requested_by: str, now: dt.datetime) -> DataFrame:
    """Shape workload rows with tag_key, tag_value and cost as PENDING intent."""
    return rows.withColumns({
        "batch_id": F.lit(batch_id),
        "enqueued_at": F.lit(now),
        "requested_by": F.lit(requested_by),
        "is_serverless": F.coalesce(F.col("is_serverless").cast("int"), F.lit(0)),
        "list_cost": F.col("cost").cast(QUEUE_MONEY),
        "status": F.lit(PENDING),
        "attempts": F.lit(0),
        "last_error": F.lit(None).cast("string"),
        "executed_at": F.lit(None).cast("timestamp"),
    }).select(*WRITE_QUEUE.fieldNames())


def enqueue_rules(summary: DataFrame, queue: DataFrame, rules: Sequence | DataFrame, keys: Sequence[str],
                  as_of: dt.date, days: int, batch_id: str, requested_by: str, now: dt.datetime,
                  workspaces: Sequence[str] | None = None,
                  skip_handled: bool = False) -> DataFrame | None:
    """One row per matched workload and tag of its winning rule. All tags of
    the rule are written, whichever key decided that the workload is untagged. ``rules`` is a
    list or a rule table.
    ``skip_handled`` makes the rows agree with ``rule_impact``; without it,
    handled workloads are queued again."""
    table = isinstance(rules, DataFrame)
    wanted = rules if table else complete_rules(rules)
    if not table and not wanted:
        return None
    matched = rule_candidates(summary, keys, rules, as_of, days, workspaces).filter("first_rule >= 0")
    if skip_handled:
        matched = not_handled(matched, queue, keys[0])
    return _with_rule_tags(matched, wanted, batch_id, requested_by, now)


def _with_rule_tags(matched: DataFrame, rules, batch_id: str, requested_by: str,
                    now: dt.datetime) -> DataFrame:
    tags = tags_of(rules) if isinstance(rules, DataFrame) else rule_tags(matched.sparkSession, rules)
    joined = matched.join(tags, matched["first_rule"] == tags["rule_idx"])
    return queue_rows(joined, batch_id, requested_by, now)


def enqueue_single(requests: DataFrame, batch_id: str, requested_by: str,
                   now: dt.datetime) -> DataFrame:
    """Rows for workloads with an explicit ``tags`` map, one per tag. Requests
    that ``tag_plan`` does not support are left out; cost may be null."""
    return queue_rows(
        tag_plan(requests).filter("supported")
        .select("workspace_id", "product", "workload_id", "is_serverless",
                _name_or_id().alias("workload_name"), F.col("list_cost").alias("cost"),
                F.explode("tags").alias("tag_key", "tag_value")),
        batch_id, requested_by, now)


def enqueue_selected(selection: DataFrame, key: str, batch_id: str, requested_by: str,
                     now: dt.datetime) -> DataFrame:
    """Rows for a reviewed selection, each with its own value; rows without an
    id or a value are left out."""
    def given(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit("")) != ""

    chosen = selection.filter(given("workload_id") & given("tag_value")).withColumns({
        "workspace_id": F.coalesce("workspace_id", F.lit("")),
        "workload_name": _name_or_id(),
        "tag_key": F.lit(key),
    })
    return queue_rows(chosen, batch_id, requested_by, now)


def _name_or_id() -> Column:
    return F.coalesce(F.nullif("workload_name", F.lit("")), F.col("workload_id"))


def enqueue_suggestions(candidates: DataFrame, queue: DataFrame, key: str, batch_id: str,
                        requested_by: str, now: dt.datetime,
                        exclude_batch: str | None = None) -> DataFrame:
    """One row per candidate of ``suggestion_candidates``, optionally without
    workloads that ``exclude_batch`` already has for this key."""
    if exclude_batch:
        candidates = not_in_batch(candidates, queue, exclude_batch, key)
    rows = candidates.withColumns({"tag_key": F.lit(key), "tag_value": F.col("suggested_cost_center")})
    return queue_rows(rows, batch_id, requested_by, now)


def auto_tag(summary: DataFrame, suggestions: DataFrame, queue: DataFrame, key: str,
             as_of: dt.date, days: int, batch_id: str, requested_by: str, now: dt.datetime,
             rules: Sequence = (), min_confidence: float = 0.8,
             workspaces: Sequence[str] | None = None, use_suggestions: bool = True) -> DataFrame:
    """Rules first, suggestions for the rest, one batch; ``origin`` tells the
    two apart. Both read the same workloads, so their shuffle is shared. A
    workload whose rule sets ``key`` is left out of the suggestions by looking
    at the rule itself, so the new rows need not be joined back."""
    wanted = complete_rules(rules)
    workloads = rule_candidates(summary, [key], rules, as_of, days, workspaces)
    by_rule = _with_rule_tags(workloads.filter("first_rule >= 0"), wanted, batch_id, requested_by, now)
    rows = by_rule.withColumn("origin", F.lit("rule"))
    if not use_suggestions:
        return rows
    rest = with_suggestion(workloads.filter(~covers_key(wanted, key)), suggestions, min_confidence)
    suggested = enqueue_suggestions(
        not_handled(rest, queue, key), queue, key, batch_id, requested_by, now)
    return rows.unionByName(suggested.withColumn("origin", F.lit("suggestion")))


def auto_tag_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count_if(F.col("origin") == "rule").alias("rule_rows"),
        F.count_if(F.col("origin") == "suggestion").alias("suggestion_rows"),
        F.count(F.lit(1)).alias("total_rows"),
    )


def claimable(now: dt.datetime, workspace_id: str | None = None,
              batch_id: str | None = None) -> Column:
    """Rows a run may take: pending ones, and those left RUNNING for over half
    an hour. Stored columns against literals, so it reaches the scan."""
    stale = F.lit(now - dt.timedelta(minutes=STALE_CLAIM_MINUTES))
    free = (F.col("status") == PENDING) | (
        (F.col("status") == RUNNING) & (F.col("executed_at") < stale))
    if workspace_id:
        free = free & (F.col("workspace_id") == workspace_id)
    if batch_id:
        free = free & (F.col("batch_id") == batch_id)
    return free


def claim(queue: DataFrame, now: dt.datetime, run_token: str, workspace_id: str | None = None,
          batch_id: str | None = None) -> DataFrame:
    """Queue snapshot with the claimable rows marked RUNNING and stamped with
    the run's token. A projection, no shuffle. One writer publishes snapshots
    at a time."""
    free = F.coalesce(claimable(now, workspace_id, batch_id), F.lit(False))
    return queue.withColumns({
        "status": F.when(free, RUNNING).otherwise(F.col("status")),
        "last_error": F.when(free, run_token).otherwise(F.col("last_error")),
        "executed_at": F.when(free, F.lit(now)).otherwise(F.col("executed_at")),
    })


def claimed_by(run_token: str) -> Column:
    return (F.col("status") == RUNNING) & (F.col("last_error") == run_token)


def claimed_rows(queue: DataFrame, run_token: str) -> DataFrame:
    return queue.filter(claimed_by(run_token))


def drain_order(rows: DataFrame) -> DataFrame:
    """Costliest first, unknown cost last."""
    return rows.orderBy(F.desc_nulls_last("list_cost"), "batch_id", *WORKLOAD_KEY, "tag_key")
