"""Schemas of the stored tables, and helpers that bring a frame to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

MONEY = T.DecimalType(38, 10)
QUEUE_MONEY = T.DecimalType(38, 6)
QUANTITY = T.DecimalType(18, 6)
RATE = T.DecimalType(10, 4)
TAGS = T.MapType(T.StringType(), T.StringType())


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


USAGE = T.StructType([
    T.StructField("usage_date", T.DateType()),
    T.StructField("workspace_id", T.StringType()),
    T.StructField("billing_origin_product", T.StringType()),
    T.StructField("usage_metadata", _strings(
        "job_id", "warehouse_id", "dlt_pipeline_id", "endpoint_id", "app_id", "index_id",
        "database_instance_id", "cluster_id", "job_name", "endpoint_name", "app_name", "run_name")),
    T.StructField("identity_metadata", _strings("owned_by", "run_as", "created_by")),
    T.StructField("product_features", T.StructType([T.StructField("is_serverless", T.BooleanType())])),
    T.StructField("sku_name", T.StringType()),
    T.StructField("usage_quantity", QUANTITY),
    T.StructField("usage_unit", T.StringType()),
    T.StructField("custom_tags", TAGS),
])

LIST_PRICES = T.StructType([
    T.StructField("sku_name", T.StringType()),
    T.StructField("pricing", T.StructType([T.StructField("default", RATE)])),
    T.StructField("price_start_time", T.TimestampType()),
    T.StructField("price_end_time", T.TimestampType()),
])

SUMMARY = T.StructType([
    T.StructField("usage_date", T.DateType()),
    T.StructField("workspace_id", T.StringType()),
    T.StructField("product", T.StringType()),
    T.StructField("workload_id", T.StringType()),
    T.StructField("workload_name", T.StringType()),
    T.StructField("owner", T.StringType()),
    T.StructField("is_serverless", T.IntegerType()),
    T.StructField("tag_keys", T.ArrayType(T.StringType())),
    T.StructField("dbus", T.DecimalType(38, 6)),
    T.StructField("list_cost", MONEY),
    T.StructField("unpriced_dbus", T.DecimalType(38, 6)),
])

SUGGESTIONS = T.StructType([
    T.StructField("product", T.StringType()),
    T.StructField("workload_id", T.StringType()),
    T.StructField("workload_name", T.StringType()),
    T.StructField("owner", T.StringType()),
    T.StructField("workspace_id", T.StringType()),
    T.StructField("list_cost", MONEY),
    T.StructField("suggested_cost_center", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("rationale", T.StringType()),
    T.StructField("annotated_at", T.TimestampType()),
])

WRITE_QUEUE = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("enqueued_at", T.TimestampType()),
    T.StructField("requested_by", T.StringType()),
    T.StructField("workspace_id", T.StringType()),
    T.StructField("product", T.StringType()),
    T.StructField("workload_id", T.StringType()),
    T.StructField("workload_name", T.StringType()),
    T.StructField("is_serverless", T.IntegerType()),
    T.StructField("tag_key", T.StringType()),
    T.StructField("tag_value", T.StringType()),
    T.StructField("list_cost", QUEUE_MONEY),
    T.StructField("status", T.StringType()),
    T.StructField("attempts", T.IntegerType()),
    T.StructField("last_error", T.StringType()),
    T.StructField("executed_at", T.TimestampType()),
])

AUDIT = T.StructType([
    T.StructField("audit_id", T.StringType()),
    T.StructField("batch_id", T.StringType()),
    T.StructField("executed_at", T.TimestampType()),
    T.StructField("executed_by", T.StringType()),
    T.StructField("workspace_id", T.StringType()),
    T.StructField("product", T.StringType()),
    T.StructField("workload_id", T.StringType()),
    T.StructField("tag_key", T.StringType()),
    T.StructField("old_value", T.StringType()),
    T.StructField("new_value", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
])

INVENTORY = T.StructType([
    T.StructField("scan_id", T.StringType()),
    T.StructField("scanned_at", T.TimestampType()),
    T.StructField("workspace_id", T.StringType()),
    T.StructField("product", T.StringType()),
    T.StructField("workload_id", T.StringType()),
    T.StructField("workload_name", T.StringType()),
    T.StructField("owner", T.StringType()),
    T.StructField("tags", TAGS),
    T.StructField("tag_keys", T.ArrayType(T.StringType())),
    T.StructField("tag_count", T.IntegerType()),
    T.StructField("direct_tag", T.BooleanType()),
    T.StructField("fallback", T.StringType()),
    T.StructField("tag_read_ok", T.BooleanType()),
    T.StructField("read_error", T.StringType()),
    T.StructField("raw_state", T.StringType()),
    T.StructField("listing_failed", T.BooleanType()),
])

# What is known of each resource. ``problem`` says why its tags could not be
# read. A row without workload_id stands for a listing that failed, and one without product
# as well for a workspace out of reach.
TAG_STATE = T.StructType([
    T.StructField("workspace_id", T.StringType()),
    T.StructField("product", T.StringType()),
    T.StructField("workload_id", T.StringType()),
    T.StructField("tags", TAGS),
    T.StructField("problem", T.StringType()),
])

# One outcome per queue row that was worked on.
OUTCOMES = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("workload_id", T.StringType()),
    T.StructField("product", T.StringType()),
    T.StructField("tag_key", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("last_error", T.StringType()),
    T.StructField("executed_at", T.TimestampType()),
])

QUEUE_KEY = ("batch_id", "workload_id", "product", "tag_key")
RESOURCE_KEY = ("workspace_id", "product", "workload_id")

# Columns that may not be null when a row is stored.
REQUIRED = {
    "write_queue": ("batch_id", "enqueued_at", "workspace_id", "product", "workload_id",
                    "tag_key", "tag_value", "status"),
    "audit": ("audit_id", "batch_id", "executed_at", "workspace_id", "product", "workload_id",
              "tag_key", "action", "status"),
    "inventory": ("scan_id", "scanned_at", "workspace_id", "product", "workload_id"),
}

# Batches are stored in this many directories, so that one can be looked up.
BATCH_BUCKETS = 256
BUCKET = "batch_bucket"


def batch_bucket(batch_id: Column) -> Column:
    return F.pmod(F.xxhash64(batch_id), F.lit(BATCH_BUCKETS)).cast("int")


def of_batch(rows: DataFrame, batch_id: str) -> DataFrame:
    """Rows of one batch; of a stored table, only its bucket is read."""
    mine = F.col("batch_id") == batch_id
    if BUCKET in rows.columns:
        mine = mine & (F.col(BUCKET) == batch_bucket(F.lit(batch_id)))
    return rows.filter(mine)


TABLES = {
    "usage": USAGE,
    "list_prices": LIST_PRICES,
    "summary": SUMMARY,
    "suggestions": SUGGESTIONS,
    "write_queue": WRITE_QUEUE,
    "audit": AUDIT,
    "inventory": INVENTORY,
    "tag_state": TAG_STATE,
    "outcomes": OUTCOMES,
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Reorder and cast to the table's schema; absent columns become null and
    a null in a required column fails the write."""
    shaped = df.to(TABLES[table])
    required = REQUIRED.get(table, ())
    return shaped.withColumns({
        c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{table}.{c} must not be null")))
            .otherwise(F.col(c))
        for c in required
    }) if required else shaped
