"""Queue and audit as bucketed tables: joins on the merge key read them as they lie.

A table is written in a fixed number of buckets of its key, each sorted. A join or an aggregate on that key then
needs no shuffle of the table, only of what is merged in, which is one run's worth of rows. The number of
buckets stays with the table; it should be such that a bucket's rows fit one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagledger.schemas import QUEUE_KEY, TABLES, conform

#: What stored tables are joined by.
KEYS = {"write_queue": list(QUEUE_KEY), "audit": list(QUEUE_KEY)}


def store_bucketed(rows: DataFrame, table: str, name: str, path: str, buckets: int = 64) -> DataFrame:
    """Write rows of ``table`` as the catalog table ``name`` with its files under ``path``, in place of what it
    held. Each bucket is gathered first, so it is one file."""
    keys = KEYS[table]
    conform(rows, table).repartition(buckets, *keys).write.mode("overwrite").format("parquet").option("path", path) \
        .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return read_bucketed(rows.sparkSession, table, name)


def read_bucketed(spark: SparkSession, table: str, name: str) -> DataFrame:
    return spark.table(name).select(*TABLES[table].names)
