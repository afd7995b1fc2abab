"""Carry out claimed intent on the tag state, and record what happened."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tagledger import capability, constants as C
from tagledger.functions.tagmaps import is_noop, merge_changes, value_of
from tagledger.operators.sequence import with_previous
from tagledger.schemas import AUDIT, OUTCOMES, QUEUE_KEY, RESOURCE_KEY


def with_capability(rows: DataFrame) -> DataFrame:
    """Add ``can``, the capability of the row's product; null when unknown."""
    matrix = capability.capability_matrix(rows.sparkSession)
    can = matrix.select("product", F.struct("*").alias("can"))
    return rows.join(F.broadcast(can), "product", "left")


def with_state(rows: DataFrame, tag_state: DataFrame) -> DataFrame:
    """Add ``state``, a struct with the resource's tags and what is wrong with them, null when
    there is no such resource; and ``unlisted``, why the resources of its product or
    workspace could not be listed. Nothing that follows needs the rows grouped, so Spark is
    free to split a resource that many rows ask for."""
    resources, failed = tag_state.filter("workload_id IS NOT NULL"), tag_state.filter("workload_id IS NULL")
    everything = F.array(*[F.lit(p) for p in capability.BY_PRODUCT])
    unlisted = failed.select(
        "workspace_id", F.explode(F.when(F.col("product").isNull(), everything).otherwise(F.array("product"))).alias("product"),
        "problem").groupBy("workspace_id", "product").agg(F.max("problem").alias("unlisted"))
    state = resources.select(*RESOURCE_KEY, F.struct("tags", "problem").alias("state"))
    return rows.join(state, list(RESOURCE_KEY), "left").join(unlisted, ["workspace_id", "product"], "left")


def _no(status: str, error: Column) -> Column:
    return F.struct(F.lit(status).alias("status"), error.alias("error"))


def refused_by_rule() -> Column:
    """Struct (status, error) when the product, the serverless flag or the id
    rules a write out, else null. Policy comes first: for those products
    nothing is looked up."""
    product, can = F.col("product"), F.col("can")
    serverless = F.coalesce(F.col("is_serverless").cast("int") == 1, F.lit(False))
    unsupported = can["policy_driven"] | can["ui_only"] | (can["serverless_differs"] & serverless)
    job_id_ok = F.rlike("workload_id", F.lit(r"^\s*[+-]?[0-9]+\s*$"))
    return (
        F.when(can.isNull(), _no(C.UNSUPPORTED, F.concat(
            F.lit("no way to write tags of product "), product)))
        .when(unsupported, _no(C.UNSUPPORTED, can["reason"]))
        .when((product == "JOBS") & ~job_id_ok, _no(C.FAILED, F.concat(
            F.lit("InvalidId: job id must be an integer, not "), F.col("workload_id"))))
    )


def refused_by_state(readable: Column) -> Column:
    """Struct (status, error) when the resource could not be listed, does not exist, or
    has tags that should be readable and were not; else null."""
    name = F.concat(F.col("product"), F.lit(" "), F.col("workload_id"))
    return (
        F.when(F.col("unlisted").isNotNull(), _no(C.FAILED, F.concat(F.lit("Unknown: "), F.col("unlisted"))))
        .when(F.col("state").isNull(), _no(C.FAILED, F.concat(F.lit("ResourceDoesNotExist: "), name)))
        .when(readable & F.col("state.problem").isNotNull(), _no(C.FAILED, F.concat(
            F.lit("TagsUnreadable: "), F.col("state.problem"))))
    )


def attempts(claimed: DataFrame, tag_state: DataFrame, dry_run: bool = True) -> DataFrame:
    """One row per claimed row: status, error, old and new value, whether the
    key already stood as wanted (``noop``) and whether nothing was written
    (``dry_run``).

    Rows for the same resource and key take effect in the order they were
    queued, so each sees the value the one before it left. A trial run changes
    nothing, so there every row sees the stored value. Where a product's tags
    cannot be read, the old value is unknown and nothing counts as a no-op.

    Histories are followed before the tag state is looked up. A missing
    resource fails all its rows alike, so its histories do not matter; so does one
    whose tags or listing could not be read."""
    rows = with_capability(claimed).withColumns({
        "no": refused_by_rule(), "readable": F.col("can.rollback")}).drop("can")
    if dry_run:
        rows = rows.withColumn("previous", F.lit(None).cast("string"))
    else:
        rows = with_previous(
            rows.withColumn("_refused", F.col("no").isNotNull()),
            [*RESOURCE_KEY, "tag_key", "_refused"], "tag_value", "enqueued_at", "batch_id",
        ).drop("_refused")
    rows = with_state(rows, tag_state).withColumn(
        "no", F.coalesce("no", refused_by_state(F.coalesce("readable", F.lit(False)))))
    written = F.col("no").isNull()
    readable = written & F.col("readable")
    old = F.when(readable, F.coalesce(F.col("previous"), value_of(F.col("state.tags"), F.col("tag_key"))))
    noop = readable & is_noop(F.col("old_value"), F.col("tag_value"))
    return rows.withColumn("old_value", old).select(
        *QUEUE_KEY, "workspace_id", "enqueued_at",
        F.coalesce(F.col("no.status"), F.lit(C.SUCCEEDED)).alias("status"),
        F.col("no.error").alias("error"),
        "old_value",
        F.when(written, F.col("tag_value")).alias("new_value"),
        noop.alias("noop"),
        (written & ~noop & F.lit(dry_run)).alias("dry_run"),
    )


def outcomes(tried: DataFrame, now: dt.datetime) -> DataFrame:
    """Status per queue row; a success that wrote nothing because of a trial
    run is SKIPPED_DRYRUN, a no-op is a success either way."""
    skipped = (F.col("status") == C.SUCCEEDED) & F.col("dry_run")
    return tried.select(
        *QUEUE_KEY,
        F.when(skipped, C.SKIPPED_DRYRUN).otherwise(F.col("status")).alias("status"),
        F.col("error").alias("last_error"),
        F.lit(now).alias("executed_at"),
    ).select(*OUTCOMES.fieldNames())


def audit_rows(tried: DataFrame, now: dt.datetime, executed_by: str, run_token: str) -> DataFrame:
    """A record of each real change and each failure. No-ops, trial runs and
    unsupported rows leave none. The id is a digest of what it identifies, so
    a repeated run writes the same ids."""
    changed = (F.col("status") == C.SUCCEEDED) & ~F.col("noop") & ~F.col("dry_run")
    return tried.filter(changed | (F.col("status") == C.FAILED)).select(
        audit_id(run_token, C.SET), "batch_id", F.lit(now).alias("executed_at"),
        F.lit(executed_by).alias("executed_by"), "workspace_id", "product", "workload_id", "tag_key",
        "old_value", F.when(changed, F.col("new_value")).alias("new_value"),
        F.lit(C.SET).alias("action"), "status", "error",
    ).select(*AUDIT.fieldNames())


def audit_id(run_token: str, action: str) -> Column:
    parts = F.to_json(F.array(F.lit(run_token), F.lit(action), *[F.col(c) for c in QUEUE_KEY]))
    return F.sha2(parts, 256).alias("audit_id")


def change_state(tag_state: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply (resource, tag_key, tag_value) changes, one per key, to the tag
    state. A null value removes the key. What is gathered per resource is one
    entry per key, the size of its tag map."""
    entries = F.collect_list(F.struct("tag_key", "tag_value"))
    folded = changes.groupBy(*RESOURCE_KEY).agg(F.map_from_entries(entries).alias("_changes"))
    return tag_state.join(folded, list(RESOURCE_KEY), "left").select(
        *RESOURCE_KEY,
        F.when(F.col("_changes").isNull(), F.col("tags"))
        .otherwise(merge_changes(F.col("tags"), F.col("_changes"))).alias("tags"), "problem",
    )


def applied_state(tag_state: DataFrame, tried: DataFrame) -> DataFrame:
    """Tag state after the attempts: per key, the last written value stays."""
    last = F.max(F.struct("enqueued_at", "batch_id", "new_value"))["new_value"]
    written = tried.filter((F.col("status") == C.SUCCEEDED) & ~F.col("dry_run"))
    return change_state(
        tag_state, written.groupBy(*RESOURCE_KEY, "tag_key").agg(last.alias("tag_value")))


def newest_outcomes(found: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """The newest outcome per queue row (and per ``per`` columns, if any)."""
    newest = F.max(F.struct("executed_at", "status", "last_error")).alias("_newest")
    return found.groupBy(*QUEUE_KEY, *per).agg(newest).select(
        *QUEUE_KEY, *per, "_newest.status", "_newest.last_error", "_newest.executed_at")


def apply_outcomes(queue: DataFrame, found: DataFrame, round_column: str | None = None,
                   among: Column | None = None) -> DataFrame:
    """Queue snapshot with outcomes merged in by the four-column key: newest
    status, error and time; attempts grows by one, or by one per distinct
    ``round_column`` value that touched the row.

    ``among`` tells which rows can have an outcome at all, such as those a run
    has claimed. The others, mostly settled long ago, then pass straight
    through and only these are shuffled."""
    if among is not None:
        mine = F.coalesce(among, F.lit(False))
        touched = apply_outcomes(queue.filter(mine), found, round_column)
        return queue.filter(~mine).unionByName(touched)
    if round_column:
        found = newest_outcomes(found, (round_column,))
    newest = F.max(F.struct("executed_at", "status", "last_error")).alias("_new")
    tries = F.count(F.lit(1)) if round_column else F.lit(1)
    merged = found.groupBy(*QUEUE_KEY).agg(newest, tries.cast("int").alias("_tries"))
    hit = F.col("_new").isNotNull()
    updates = {
        "status": F.when(hit, F.col("_new.status")).otherwise(F.col("status")),
        "last_error": F.when(hit, F.col("_new.last_error")).otherwise(F.col("last_error")),
        "executed_at": F.when(hit, F.col("_new.executed_at")).otherwise(F.col("executed_at")),
        "attempts": F.when(hit, F.coalesce("attempts", F.lit(0)) + F.col("_tries"))
        .otherwise(F.col("attempts")),
    }
    return queue.join(merged, list(QUEUE_KEY), "left").withColumns(updates).select(*queue.columns)


def run_summary(tried: DataFrame, by: str = "status") -> DataFrame:
    return tried.groupBy(by).agg(F.count(F.lit(1)).alias("rows"))
