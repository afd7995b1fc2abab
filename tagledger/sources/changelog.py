"""Stored tables that change by adding rows, and how their current rows are read.

Intent, events, changes and audit records are only ever appended, by plain Spark writes into one directory per
bucket of batches (or product). The current row is worked out on reading, as a maximum over a struct: of an intent
row and its events the newest wins, of the changes to a tag the newest one made after the resource was scanned. All
of this counts a row that was written twice once, so a run, a task or a micro-batch that is repeated changes nothing,
and several runs may append at a time. ``compacted_events`` and ``compacted_changes`` are what such tables come down to.

What is worked out anew as a whole (days of the summary, a scan, the products of a scan, suggestions) is written with
dynamic partition overwrite: only directories that have rows are replaced, and only when all rows are written.
A directory that must become empty gets a row marked ``gone``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tagledger.functions.tagmaps import merge_changes
from tagledger.schemas import (
    AUDIT, BUCKET, QUEUE_KEY, RESOURCE_KEY, TABLES, TAG_STATE, WRITE_QUEUE, batch_bucket, conform,
)

#: Events of a queue row. ``rank`` orders those of one moment; ``tries`` names the attempts an event stands for.
EVENTS = T.StructType([WRITE_QUEUE[c] for c in QUEUE_KEY] + [
    T.StructField("at", T.TimestampType()), T.StructField("rank", T.IntegerType()), WRITE_QUEUE["status"],
    WRITE_QUEUE["last_error"], WRITE_QUEUE["executed_at"], T.StructField("tries", T.ArrayType(T.StringType()))])
#: Changes of one tag. ``place`` orders those of one moment; a null value removes the tag.
CHANGES = T.StructType([TAG_STATE[c] for c in RESOURCE_KEY] + [
    T.StructField("tag_key", T.StringType()), T.StructField("at", T.TimestampType()),
    T.StructField("place", T.StringType()), T.StructField("tag_value", T.StringType())])
#: The state as last scanned, and when.
SCANNED = T.StructType([*TAG_STATE.fields, T.StructField("seen_at", T.TimestampType())])
CLAIMED, TRIED, UNDONE = 1, 2, 3
STATE = ("status", "last_error", "executed_at")
#: Stored tables: their schema, and the column that their directories are named by.
STORED = {
    "write_queue": (WRITE_QUEUE, BUCKET), "queue_events": (EVENTS, BUCKET), "audit": (AUDIT, BUCKET),
    "tag_changes": (CHANGES, "product"), "tag_state": (SCANNED, "product"), "summary": (TABLES["summary"], "usage_date"),
    "inventory": (TABLES["inventory"], "scan_id"), "suggestions": (TABLES["suggestions"], "product"),
}
GONE = "gone"


def _stored_schema(name: str) -> T.StructType:
    schema, by = STORED[name]
    fields = [f for f in schema.fields if f.name != by] + [T.StructField(GONE, T.BooleanType())]
    return T.StructType(fields + [schema[by] if by in schema.names else T.StructField(by, T.IntegerType())])


def read_rows(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """All rows of a stored table, and the bucket where it has one."""
    schema, by = STORED[name]
    rows = spark.read.schema(_stored_schema(name)).parquet(f"{folder}/{name}").where(F.col(GONE).isNull())
    return rows.select(*schema.names, *([by] if by not in schema.names else []))


def _shaped(rows: DataFrame, name: str) -> DataFrame:
    schema, by = STORED[name]
    shaped = conform(rows, name) if name in TABLES and name != "tag_state" else rows.to(schema)
    if by == BUCKET:
        shaped = shaped.withColumn(BUCKET, batch_bucket(F.col("batch_id")))
    return shaped.withColumn(GONE, F.lit(None).cast("boolean"))


def append_rows(rows: DataFrame, folder: str, name: str) -> None:
    """Add rows; nothing that is there is read or written."""
    by = STORED[name][1]
    _shaped(rows, name).hint("rebalance", F.col(by)).write.mode("append").partitionBy(by).parquet(f"{folder}/{name}")


def replace_parts(rows: DataFrame, folder: str, name: str, parts: DataFrame | None = None) -> None:
    """Replace the directories that ``rows`` are of, and those that ``parts`` (one column of their values) names."""
    by = STORED[name][1]
    shaped = _shaped(rows, name)
    if parts is not None:
        marks = parts.select(F.col(parts.columns[0]).cast(shaped.schema[by].dataType).alias(by), F.lit(True).alias(GONE)).distinct()
        shaped = shaped.unionByName(marks, allowMissingColumns=True)
    shaped.hint("rebalance", F.col(by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(by).parquet(f"{folder}/{name}")


def create_tables(spark: SparkSession, folder: str, names: Sequence[str] = tuple(STORED)) -> None:
    """Empty tables, where there are none; what is there stays."""
    for name in names:
        append_rows(spark.createDataFrame([], STORED[name][0]), folder, name)


def _newest(*order: str) -> Column:
    return F.max(F.struct(*order))


def compacted_events(events: DataFrame) -> DataFrame:
    """One event per queue row: the newest state, and all attempts."""
    newest = _newest("at", "rank", *STATE).alias("_new")
    tries = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("tries", F.array().cast("array<string>"))))))
    return events.groupBy(*[c for c in (BUCKET, *QUEUE_KEY) if c in events.columns]).agg(newest, tries.alias("tries")).select(
        *QUEUE_KEY, "_new.*", "tries")


def current_queue(intents: DataFrame, events: DataFrame) -> DataFrame:
    """The queue: intent rows with the state that their newest event gave them; attempts grow by one per attempt that
    events tell of. Intents that were stored twice count once; events of rows that nobody queued count for nothing."""
    keys = [BUCKET, *QUEUE_KEY]
    given = [c for c in WRITE_QUEUE.names if c not in QUEUE_KEY and c not in STATE and c != "attempts"]
    first = F.struct("enqueued_at", *[c for c in given if c != "enqueued_at"])
    none = F.array().cast("array<string>")
    asked = intents.select(
        *keys, first.alias("_row"), F.struct(F.lit(0).alias("rank0"), F.lit(None).cast("timestamp").alias("at"),
                                             F.lit(0).alias("rank"), *STATE).alias("_state"), "attempts", none.alias("tries"))
    told = events.select(
        *keys, F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"),
        F.struct(F.lit(1).alias("rank0"), "at", F.coalesce("rank", F.lit(0)).alias("rank"), *STATE).alias("_state"),
        F.lit(None).cast("int").alias("attempts"), F.coalesce("tries", none).alias("tries"))
    tries = F.size(F.array_distinct(F.flatten(F.collect_set("tries"))))
    merged = asked.unionByName(told).groupBy(*keys).agg(
        F.max("_row").alias("_row"), F.max("_state").alias("_state"), F.max("attempts").alias("attempts"), tries.alias("_tries"))
    attempts = F.when(F.col("_tries") > 0, F.coalesce("attempts", F.lit(0)) + F.col("_tries")).otherwise(F.col("attempts"))
    return merged.where("_row IS NOT NULL").withColumn("attempts", attempts.cast("int")).select(
        *QUEUE_KEY, "_row.*", *[F.col(f"_state.{c}").alias(c) for c in STATE], "attempts", BUCKET,
    ).select(*WRITE_QUEUE.names, BUCKET)


def compacted_changes(changes: DataFrame) -> DataFrame:
    """The newest change per tag of a resource."""
    key = [*RESOURCE_KEY, "tag_key"]
    return changes.groupBy(*key).agg(_newest("at", "place", "tag_value").alias("_new")).select(*key, "_new.*")


def current_state(scanned: DataFrame, changes: DataFrame) -> DataFrame:
    """The tag state: what was scanned, with the newest change per tag made since. What is gathered per resource is an
    entry per tag, the size of its tag map."""
    entries = F.collect_list(F.struct("tag_key", "at", "tag_value")).alias("_changes")
    folded = compacted_changes(changes).groupBy(*RESOURCE_KEY).agg(entries)
    since = F.filter("_changes", lambda x: F.col("seen_at").isNull() | (x["at"] > F.col("seen_at")))
    named = F.map_from_entries(F.transform(since, lambda x: F.struct(x["tag_key"], x["tag_value"])))
    tags = F.when(F.col("_changes").isNull(), F.col("tags")).otherwise(merge_changes(F.col("tags"), named))
    return scanned.join(folded, list(RESOURCE_KEY), "left").select(*RESOURCE_KEY, tags.alias("tags"), "problem")


def current_audit(records: DataFrame) -> DataFrame:
    """Audit records, each once."""
    key = [BUCKET, "batch_id", "audit_id"]
    rest = [c for c in AUDIT.names if c not in key]
    return records.groupBy(*key).agg(_newest(*rest).alias("_one")).select(*key, "_one.*").select(*AUDIT.names, BUCKET)
