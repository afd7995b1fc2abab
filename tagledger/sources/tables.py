"""Read and write the stored tables as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tagledger.schemas import BUCKET, TABLES, batch_bucket, conform

# Stored in one directory per value, so that a day, a scan or a batch can be picked out.
PARTITIONED_BY = {
    "usage": "usage_date", "summary": "usage_date", "inventory": "scan_id", "write_queue": BUCKET,
    "audit": BUCKET, "tag_state": "product",
}


def _stored_schema(table: str) -> T.StructType:
    """The table's schema; where batches are stored in buckets, the bucket too."""
    fields = list(TABLES[table].fields)
    return T.StructType(fields + [T.StructField(BUCKET, T.IntegerType())] * (PARTITIONED_BY.get(table) == BUCKET))


def read_table(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Read with the fixed schema; nothing is inferred."""
    schema = _stored_schema(table)
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def _write(rows: DataFrame, table: str, path: str, mode: str) -> None:
    """``rebalance`` gathers each directory's rows into files of even size and
    splits what is too large for one file."""
    column = PARTITIONED_BY.get(table)
    shaped = conform(rows, table)
    if column == BUCKET:
        shaped = shaped.withColumn(BUCKET, batch_bucket(F.col("batch_id")))
    if column is None:
        shaped.write.mode(mode).parquet(path)
    else:
        shaped.hint("rebalance", F.col(column)).write.mode(mode).partitionBy(column).parquet(path)


def append_table(rows: DataFrame, table: str, path: str) -> None:
    _write(rows, table, path, "append")


def replace_table(rows: DataFrame, table: str, path: str) -> None:
    _write(rows, table, path, "overwrite")
