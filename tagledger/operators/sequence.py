"""The previous value in a key's history, however the history is spread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tagledger.plans.session import work_folder


def _ranged(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows in ranges of ``order``, stored, with the number of their range. What follows reads the ranges twice
    and must see the same ones, also after the loss of an executor."""
    path = work_folder(rows.sparkSession, "history")
    rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    schema = StructType([*rows.schema.fields, StructField("_part", IntegerType())])
    return rows.sparkSession.read.schema(schema).parquet(path)


def with_previous(rows: DataFrame, keys: Sequence[str], value: str, at: str, tie: str,
                  name: str = "previous") -> DataFrame:
    """Add the ``value`` of the row before, per key in order of (at, tie); null
    for the first. Values must not be null, and (at, tie) must tell a key's rows apart.

    A segmented scan. Rows are put into ranges of (key, at, tie), so a key that owns a large part of the rows, even
    in one moment, lies in many ranges, in order. Each range finds predecessors on its own. What a key's rows in one
    range lack is the last value it had in the range before, and only keys that reach over the edge
    of a range have such a value: fewer rows than there are ranges, which are joined back."""
    part = [*keys, "_part"]
    ranged = _ranged(rows, [*keys, at, tie])
    inside = ranged.withColumn("_inside", F.lag(value).over(Window.partitionBy(*part).orderBy(at, tie)))
    ends = ranged.groupBy(*part).agg(F.max(F.struct(at, tie, value))[value].alias("_end"))
    carried = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_part"))) \
        .where("_before IS NOT NULL").drop("_end")
    same = [F.col(f"i.{c}").eqNullSafe(F.col(f"c.{c}")) for c in part]
    joined = inside.alias("i").join(carried.alias("c"), same, "left")
    return joined.select(*[F.col(f"i.{c}") for c in rows.columns], F.coalesce("_inside", "_before").alias(name))
