"""One key with a third of all rows: Spark must be able to split it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF, NOW, rows
from tagledger.operators import apply as A, guards as G, summary as S
from verification import fixtures as X

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture(autouse=True)
def small_limits(spark):
    saved = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in saved.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()  # the same shapes as below
    kept = df.collect()
    return df._jdf.queryExecution().executedPlan().toString(), kept


def test_hot_resource_is_split_between_tasks(spark):
    n = 240_000  # rows in ranges of the key compress to a quarter
    hot = F.col("id") % 3 == 0
    ids = spark.range(0, n, 1, 8)
    queue = ids.select(
        F.concat(F.lit("b"), F.col("id").cast("string")).alias("batch_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("enqueued_at"),
        F.lit("1").alias("workspace_id"), F.lit("JOBS").alias("product"),
        F.when(hot, "7").otherwise((F.col("id") + 100).cast("string")).alias("workload_id"),
        F.lit(0).alias("is_serverless"), F.lit("k").alias("tag_key"),
        F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("tag_value"))
    state = queue.select("workspace_id", "product", "workload_id").distinct().withColumn(
        "tags", F.create_map(F.lit("k"), F.lit("start"))).withColumn("problem", F.lit(None).cast("string"))
    plan, found = final_plan(A.attempts(queue, state, dry_run=False))
    assert "skew=true" in plan
    assert len(found) == n
    history = sorted((r["enqueued_at"], r["old_value"]) for r in found if r["workload_id"] == "7")
    assert [old for _, old in history] == ["start"] + ["even" if i % 2 else "odd" for i in range(1, n // 3)]


def test_hot_sku_is_split_when_prices_cannot_be_broadcast(spark):
    n = 240_000
    usage = spark.range(0, n, 1, 8).select(
        F.lit(AS_OF).alias("usage_date"), F.lit("1").alias("workspace_id"), F.lit("JOBS").alias("product"),
        F.col("id").cast("string").alias("job"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 500).cast("string")).alias("sku_name"))
    full = usage.select(
        "usage_date", "workspace_id", F.col("product").alias("billing_origin_product"),
        F.struct(*[(F.col("job") if f == "job_id" else F.lit(None).cast("string")).alias(f) for f in (
            "job_id", "warehouse_id", "dlt_pipeline_id", "endpoint_id", "app_id", "index_id",
            "database_instance_id", "cluster_id", "job_name", "endpoint_name", "app_name", "run_name")])
        .alias("usage_metadata"),
        F.struct(*[F.lit(None).cast("string").alias(f) for f in ("owned_by", "run_as", "created_by")])
        .alias("identity_metadata"),
        F.struct(F.lit(False).alias("is_serverless")).alias("product_features"), "sku_name",
        F.lit(1).cast("decimal(18,6)").alias("usage_quantity"), F.lit("DBU").alias("usage_unit"),
        F.lit(None).cast("map<string,string>").alias("custom_tags"))
    prices = usage.select("sku_name").distinct().select(
        "sku_name", F.struct(F.lit(2).cast("decimal(10,4)").alias("default")).alias("pricing"),
        F.lit(NOW).alias("price_start_time"), F.lit(None).cast("timestamp").alias("price_end_time"))
    plan, found = final_plan(S.daily_summary(full, prices, AS_OF))
    assert "skew=true" in plan
    assert len(found) == n and sum(r["list_cost"] for r in found) == 2 * n


def test_workload_that_fills_the_queue_does_not_reach_one_task(spark, make):
    """The guard sends each workload once per task, however often it is queued."""
    queue = spark.range(0, 30_000, 1, 8).select(
        F.lit("JOBS").alias("product"), F.lit("7").alias("workload_id"), F.lit("k").alias("tag_key"),
        F.lit("FAILED").alias("status"))
    workloads = make("suggestions", {"product": "JOBS", "workload_id": "7"}, {"product": "JOBS", "workload_id": "8"})
    left = G.not_handled(workloads, queue, "k")
    assert rows(left, "workload_id") == [("8",)]
    plan = left._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("HashAggregate"):]
    assert "Range (0, 30000" in below and "Exchange" not in below and plan.count("HashAggregate") >= 2
