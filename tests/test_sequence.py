"""Predecessors over ranges against a plain window."""

import datetime as dt
import random

from pyspark.sql import Window, functions as F

from conftest import NOW, rows
from tagledger.operators import sequence
from tagledger.operators.sequence import with_previous

KEYS = ["w", "k"]
SHAPE = "w string, k string, at timestamp, batch string, value string, extra map<string,string>"


def made(spark, n, hot=0, seed=1):
    """``hot`` rows are of one key and one minute."""
    rng = random.Random(seed)
    data = [(rng.choice(["1", "2", None]), str(rng.randrange(max(n // 4, 1))), NOW + dt.timedelta(seconds=rng.randrange(9000)), f"b{i:06d}", f"v{i}",
             {"a": "b"}) for i in range(n)]
    data += [("1", "hot", NOW + dt.timedelta(milliseconds=rng.randrange(3)), f"h{i:06d}", f"w{i}", None) for i in range(hot)]
    rng.shuffle(data)
    return spark.createDataFrame(data, SHAPE).repartition(6)


def plain(df):
    return df.withColumn("previous", F.lag("value").over(Window.partitionBy(*KEYS).orderBy("at", "batch")))


def test_same_as_a_plain_window(spark):
    for seed, n, hot in ((1, 0, 0), (2, 1, 0), (3, 300, 0), (4, 300, 300), (5, 30, 2000)):
        df = made(spark, n, hot, seed)
        found = with_previous(df, KEYS, "value", "at", "batch")
        assert found.columns == [*df.columns, "previous"]
        assert rows(found.drop("extra")) == rows(plain(df).drop("extra"))


def test_a_hot_minute_of_one_key_spreads_over_tasks(spark, monkeypatch):
    """A third of all rows are one key's, in one minute."""
    kept, ranged = [], sequence._ranged
    monkeypatch.setattr(sequence, "_ranged", lambda *a: kept.append(ranged(*a)) or kept[-1])
    settings = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = made(spark, 12_000, 6_000)
        found = with_previous(df, KEYS, "value", "at", "batch")
        assert rows(found.drop("extra")) == rows(plain(df).drop("extra"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    sizes = {r["_part"]: r["n"] for r in kept[0].where("k = 'hot'").groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(sizes) >= 6 and max(sizes.values()) < 1500


def test_few_values_are_carried_over(spark, monkeypatch):
    """Only keys that reach over the edge of a range are joined back."""
    kept, ranged = [], sequence._ranged
    monkeypatch.setattr(sequence, "_ranged", lambda *a: kept.append(ranged(*a)) or kept[-1])
    with_previous(made(spark, 4000, 500), KEYS, "value", "at", "batch").count()
    parts = kept[0].select("_part").distinct().count()
    spread = kept[0].groupBy(*KEYS).agg((F.count_distinct("_part") - 1).alias("n")).agg(F.sum("n")).first()[0]
    assert spread < parts
