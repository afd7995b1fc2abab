"""Helpers that the operators share: tables, the shared work folder, components.

Conventions of all operators here. Input columns are picked by name first, so
extra columns never clash. A null text counts as empty. A row is a document;
rows that repeat a doc_id are documents of their own unless a docstring says
otherwise. Empty tables give empty results.
"""

from __future__ import annotations

import os
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: ASCII white space as the contracts define it, for regular expressions and for trimming.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share;
    below the warehouse where a session (as in tests) names none. It goes when
    the application ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or (
        spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(folder)
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives the
    loss of executors, and lets the next join see both of its shuffles."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, function, schema, rows: int | None = None) -> DataFrame:
    """``mapInArrow``, with this package on the workers' path wherever the driver started. ``rows`` cuts
    Spark's batches into pieces of so many rows, which bounds what a worker holds of long columns."""
    root, env = str(Path(__file__).resolve().parents[2]), df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])

    def run(batches):
        try:
            yield from function(batches if rows is None else (
                b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)))
        finally:  # workers live on; what this task's batches held need not
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


#: Texts that a worker takes in hand at a time.
TEXTS = 1000


class UnionFind:
    """Groups under their smallest member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.up.setdefault(x, x)) != x:
            self.up[x] = self.up[up]
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        """False if the two were together already."""
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _contract(batches):
    """Each batch of edges becomes a forest of stars; never more edges than came in."""
    for batch in batches:
        groups = UnionFind()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            groups.join(a, b)
        stars = [(x, r) for x in list(groups.up) if (r := groups.find(x)) != x]
        yield pa.RecordBatch.from_arrays(
            [pa.array([s[0] for s in stars], pa.int64()), pa.array([s[1] for s in stars], pa.int64())],
            names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node that
    edges (two LONG columns) connect it to. Large-star and small-star rounds:
    every round keeps one row per edge and settles in about log(n) rounds. Nodes'
    minima are stored before they are joined, so that a hub's edges can be split."""
    a, b = edges.columns
    now = store(map_batches(edges.where(F.col(a) != F.col(b)).select(a, b), _contract, "u long, v long"),
                "edges")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = store(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "minima")
        large = store(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")),
                      "large")
        low = store(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        lead = low.select("u", F.col("m").alias("v"))
        rest = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = store(lead.unionByName(rest).distinct(), "edges")
        seen = now.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = seen
