"""The stored tables of one deployment, and the runs that move them on.

    ledger = Ledger(spark, "s3://bucket/ledger")
    ledger.create()
    ledger.refresh_summary(usage, list_prices, as_of)
    ledger.enqueue(auto_tag(ledger.read("summary"), ...))
    ledger.drain(now, run_token, "me", dry_run=False)

A run appends: claims, audit records, tag changes and outcomes (``sources.changelog``), in directories of its batches
only. Nothing that others have written is rewritten, so runs on different rows may overlap with each other and with
enqueues, and a run that is repeated under its token changes nothing. Rows are claimed by appending, too: of two
runs that claim one row in the same moment the later claim counts, but both may have seen theirs alone, so scopes of
runs that start together should differ. Applying a value twice does no harm.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from tagledger import constants as C
from tagledger.operators import (
    apply as A, inventory as I, queue as Q, rollback as R, suggestions as SG, summary as S,
)
from tagledger.operators.validate import checked, overfull
from tagledger.plans.flows import RunResult, counted, counts_of
from tagledger.plans.session import work_folder
from tagledger.schemas import QUEUE_KEY, RESOURCE_KEY, batch_bucket
from tagledger.sources import changelog as L


class Ledger:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def create(self) -> None:
        """Empty tables, where there are none."""
        L.create_tables(self.spark, self.folder)

    def rows(self, name: str) -> DataFrame:
        """The rows of a stored table as they were written."""
        return L.read_rows(self.spark, self.folder, name)

    def read(self, name: str) -> DataFrame:
        """The current rows of a table."""
        if name == "write_queue":
            return L.current_queue(self.rows(name), self.rows("queue_events"))
        if name == "tag_state":
            return L.current_state(self.rows(name), self.rows("tag_changes"))
        return L.current_audit(self.rows(name)) if name == "audit" else self.rows(name)

    def append(self, name: str, rows: DataFrame) -> None:
        L.append_rows(rows, self.folder, name)

    def compact(self) -> None:
        """Leave one event per queue row, one change per tag and each audit record once. What is read
        stays the same. Nobody may be writing."""
        for name, fewer in (("queue_events", L.compacted_events), ("tag_changes", L.compacted_changes), ("audit", L.current_audit)):
            L.replace_parts(self._stored(fewer(self.rows(name)), "compact"), self.folder, name)

    def refresh_summary(self, usage: DataFrame, list_prices: DataFrame, as_of: dt.date,
                        on_duplicate: str = "error", changed: Sequence[dt.date] | None = None) -> None:
        """Build the summary, or only the days whose usage has ``changed``. Days that have no rows
        any more become empty."""
        if changed is not None:
            usage = usage.filter(F.col("usage_date").isin(list(changed)))
            days = self.spark.createDataFrame([(d,) for d in changed], "usage_date date")
        else:
            days = self.rows("summary").select("usage_date")
        L.replace_parts(S.daily_summary(usage, list_prices, as_of, on_duplicate=on_duplicate), self.folder, "summary", days)

    def refresh_suggestions(self, as_of: dt.date, now: dt.datetime, teams: Sequence[str],
                            scorer: Callable[[Column], Column]) -> None:
        workloads = SG.scoring_workloads(self.read("summary"), as_of)
        self.store_suggestions(SG.score_workloads(workloads, now, teams, scorer))

    def store_suggestions(self, rows: DataFrame) -> None:
        """Make ``rows`` all suggestions there are."""
        L.replace_parts(rows, self.folder, "suggestions", self.rows("suggestions").select("product"))

    def store_state(self, rows: DataFrame) -> None:
        """Make ``rows`` what is known of the state, before any later change."""
        L.replace_parts(rows, self.folder, "tag_state", self.rows("tag_state").select("product"))

    def record_scan(self, listings: Mapping[str, DataFrame], scan_id: str, scanned_at: dt.datetime,
                    errors: DataFrame | None = None, workspaces: Sequence[str] | None = None) -> None:
        """Store one scan, in place of an earlier try of the same scan, and bring the tag state up to date.
        ``workspaces`` says which were scanned (None: all); what is known of others, and of
        products without a listing, stays."""
        mine = self.spark.createDataFrame([(scan_id,)], "scan_id string")
        L.replace_parts(I.inventory_sweep(listings, scan_id, scanned_at, errors), self.folder, "inventory", mine)
        fresh = I.state_of(self.rows("inventory").filter(F.col("scan_id") == scan_id)).withColumn("seen_at", F.lit(scanned_at))
        scanned = F.col("product").isNull() | F.col("product").isin(*listings)
        if workspaces is not None:
            scanned = scanned & F.col("workspace_id").isin(*workspaces)
        products = self.spark.createDataFrame([(p,) for p in (None, *listings)], "product string").union(fresh.select("product"))
        named = [r[0] for r in products.distinct().collect()]  # as many as there are products, at most
        held = self.rows("tag_state").filter(F.col("product").isNull() | F.col("product").isin([p for p in named if p is not None]))
        state = self._stored(held.filter(~scanned).unionByName(fresh), "state")
        L.replace_parts(state, self.folder, "tag_state", products)

    def enqueue(self, rows: DataFrame) -> dict[str, int]:
        """Store intent and return how many rows there were, by origin too where rows tell it, counted
        by the write itself. A tag that breaks a limit, or a resource that would get too many
        tags, refuses the whole batch."""
        queue = self.read("write_queue").filter(F.col("status").isin(C.PENDING, C.RUNNING))
        full = overfull(rows, self.read("tag_state").filter("workload_id IS NOT NULL"), queue).limit(3).collect()
        if full:
            raise ValueError(f"too many tags for {len(full)} or more resources, such as {full[0].asDict()}")
        seen, counts = Observation(), [F.count(F.lit(1)).alias("total_rows")]
        if "origin" in rows.columns:
            counts += [F.count_if(F.col("origin") == o).alias(f"{o}_rows") for o in ("rule", "suggestion")]
        self.append("write_queue", checked(rows.observe(seen, *counts)))
        return dict(seen.get)

    def _of(self, batch_id: str | None) -> DataFrame:
        """The queue, or the rows of one batch, for which only its bucket is read."""
        queue = self.read("write_queue")
        return queue.filter((F.col("batch_id") == batch_id) & (F.col("batch_bucket") == batch_bucket(F.lit(batch_id)))) if batch_id else queue

    def _event(self, rows: DataFrame, rank: int, now: dt.datetime, tries: Column | None = None) -> DataFrame:
        return rows.select(*QUEUE_KEY, F.lit(now).alias("at"), F.lit(rank).alias("rank"), "status", "last_error", "executed_at",
                           (F.array().cast("array<string>") if tries is None else F.array(tries)).alias("tries"))

    def claim(self, now: dt.datetime, run_token: str, workspace_id: str | None = None,
              batch_id: str | None = None) -> None:
        """Mark what a run may take as its own."""
        free = self._of(batch_id).filter(Q.claimable(now, workspace_id, batch_id))
        self.append("queue_events", self._event(Q.claim(free, now, run_token, workspace_id, batch_id), L.CLAIMED, now))

    def apply_claimed(self, now: dt.datetime, run_token: str, executed_by: str,
                      dry_run: bool = True, batch_id: str | None = None) -> RunResult:
        """Carry out what the run has claimed."""
        taken = Q.claimed_rows(self._of(batch_id), run_token)
        rows, seen = counted(A.attempts(taken, self.read("tag_state"), dry_run))
        tried = self._stored(rows, run_token)
        written = tried.filter((F.col("status") == C.SUCCEEDED) & ~F.col("dry_run"))
        order = F.concat_ws("|", F.date_format("enqueued_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "batch_id")
        changes = written.select(*RESOURCE_KEY, "tag_key", F.lit(now).alias("at"), order.alias("place"),
                                 F.col("new_value").alias("tag_value"))
        events = self._event(A.outcomes(tried, now), L.TRIED, now, F.lit(run_token))
        return self._settle(tried, counts_of(seen), A.audit_rows(tried, now, executed_by, run_token), changes, events)

    def drain(self, now: dt.datetime, run_token: str, executed_by: str, dry_run: bool = True,
              workspace_id: str | None = None, batch_id: str | None = None) -> RunResult:
        """Claim and apply. The claim is stored first, so a run that starts
        meanwhile finds nothing to take; a run that dies leaves RUNNING rows,
        which are free again after half an hour."""
        self.claim(now, run_token, workspace_id, batch_id)
        return self.apply_claimed(now, run_token, executed_by, dry_run, batch_id)

    def rollback(self, batch_id: str, now: dt.datetime, run_token: str, executed_by: str,
                 dry_run: bool = True, anchor: str = "latest",
                 skip_rolled_back: bool = False) -> RunResult:
        plan = R.rollback_plan(self.read("audit"), batch_id, anchor, skip_rolled_back)
        rows, seen = counted(R.rollback_attempts(plan, self.read("tag_state"), dry_run))
        tried = self._stored(rows, run_token)
        restored = tried.filter(F.col("status") == C.SUCCEEDED)
        changes = restored.select(*RESOURCE_KEY, "tag_key", F.lit(now).alias("at"), F.lit("").alias("place"),
                                  F.col("old_value").alias("tag_value"))
        undone = R.mark_rolled_back(self._of(batch_id), batch_id, tried, now).filter(F.col("status") == C.ROLLED_BACK) \
            .filter(F.col("executed_at") == F.lit(now))
        return self._settle(tried, counts_of(seen), R.rollback_audit(tried, now, executed_by, run_token), changes,
                            self._event(undone, L.UNDONE, now))

    def _stored(self, rows: DataFrame, name: str) -> DataFrame:
        """Write once, read back: what was tried feeds three tables and must not
        be computed three times, nor be lost with an executor."""
        path = work_folder(self.spark, name)
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _settle(self, tried: DataFrame, counts: dict[str, int], audit: DataFrame, changes: DataFrame,
                events: DataFrame) -> RunResult:
        """Audit first, then the state, then the queue: whatever a crash cuts
        off, no change is without its record and the rows are tried again."""
        if counts["rows"]:
            self.append("audit", audit)
            self.append("tag_changes", changes)
            self.append("queue_events", events)
        return RunResult(self.read("write_queue"), self.read("tag_state"), audit, tried, counts)
