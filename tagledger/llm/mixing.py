"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken ``target / source size`` times. The
whole part is certain; the fractions are rounded in pairs. Two documents trade
expected words until one of them is wholly in or wholly out; which way is drawn
with odds that keep each one's expectation, and the expected words of the source
never change. What a chunk of documents leaves over is one fraction and its smallest documents;
those meet in the next level of a tree. At its root the last open document is drawn and
the smallest ones make up for the difference, so a source misses its target by a few words.
"""

from __future__ import annotations

from collections import deque
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tagledger.llm.shared import SPACE_CLASS, map_batches, store

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Documents of one source that are rounded in one task.
CHUNK = 10_000
#: Smallest documents of a chunk that wait for the end of the source, and chunks that meet in one.
SPARE = 64
FAN = 100


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, n_docs, target), one row per source.

    Sources in order of code points, null last, weigh 5, 2, 1 and so on, and share
    the words of all; a target stops at 3 times its source's size. Sorted by
    that cap over weight, the capped ones come first, and the level that the others
    share follows from running sums. One row per source passes through one task."""
    per = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = per.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(place, F.lit(len(WEIGHTS))) + 1).cast("double"))
    weighed = weighed.withColumn("cap", (F.col("source_size") * MOST_COPIES).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole).cast("double")
    left = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = weighed.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / left).withColumn(
        "level", F.min(F.when(F.col("cap") >= F.col("w") * F.col("level"), F.struct(F.col("cap") / F.col("w"), "level")))
        .over(whole)["level"])
    return level.select("source", "source_size", "n_docs", F.least(
        F.col("cap"), F.col("w") * F.coalesce("level", F.lit(float("inf")))).alias("target"))


def _trade(p: list[float], size: list[float], a: int, b: int, u: float) -> int | None:
    """Move expected words between two open documents until one is whole; the one still open.
    Each keeps its expectation over the draw ``u``, and their sum stays as it is."""
    up = min((1 - p[a]) * size[a], p[b] * size[b])
    down = min(p[a] * size[a], (1 - p[b]) * size[b])
    move = up if u * (up + down) < down else -down
    p[a], p[b] = p[a] + move / size[a], p[b] - move / size[b]
    for x in (a, b):
        p[x] = 0.0 if p[x] < 1e-12 else 1.0 if p[x] > 1 - 1e-12 else p[x]
    return next((x for x in (a, b) if 0 < p[x] < 1), None)


def _settle(p, size, u, last: int | None, rest: list[int]) -> None:
    """The end of a source; ``rest`` has large ones first. Half of them trade, then the one
    still open is drawn and the smaller half makes up for what that adds or takes (on
    average nothing); then the smaller half does the same. Where the smaller ones together
    are too few words for that, coming near the target goes before their expectation."""
    while rest or last is not None:
        half = (len(rest) + 1) // 2
        for i in rest[:half]:
            if 0 < p[i] < 1:
                last = i if last is None else _trade(p, size, last, i, u[i])
        rest = rest[half:]
        if last is None:
            continue
        have, whole = sum(p[i] * size[i] for i in rest), sum(size[i] for i in rest)
        want = have + p[last] * size[last]
        p[last] = float(_again(u[last]) < p[last])
        want = min(max(0.0, want - p[last] * size[last]), whole)
        for i in rest:
            p[i] = p[i] * want / have if want <= have else 1 - (1 - p[i]) * (whole - want) / (whole - have)
        last = None


def _again(u: float) -> float:
    """Another draw from a draw."""
    return u * 7919.0 % 1.0


def _level(columns: list[str], final: bool):
    """Over rows by (source, chunk), large ones first: trades them one after the other and sets
    pick. The smallest SPARE of a chunk and the one still open go on, unless this level is final."""
    def run(batches):
        held = None
        for batch in chain(batches, [None]):
            end = batch is None
            if not end:  # the same schema for all, whatever Spark says of nulls
                batch = pa.RecordBatch.from_arrays(batch.columns, names=columns)
            if held is not None:
                batch = held if end else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                held = None
            if batch is None or not batch.num_rows:
                continue
            group, p, size, u = (batch.column(columns.index(c)).to_pylist()
                                 for c in ("__group", "__p", "__size", "__u"))
            last, spare, going_on = None, deque(), set()

            def close():
                if final:
                    _settle(p, size, u, last, list(spare))
                else:
                    going_on.update(spare, [] if last is None else [last])

            for i in range(len(group)):
                if i and group[i] != group[i - 1]:
                    close()
                    last = None
                    spare.clear()
                if size[i] <= 0 and p[i] < 1:
                    p[i] = 0.0
                if 0 < p[i] < 1:
                    spare.append(i)
                    if len(spare) > SPARE:
                        b = spare.popleft()
                        last = b if last is None else _trade(p, size, last, b, u[b])
            if end:
                close()
                wait = []
            else:
                wait = ([] if last is None else [last]) + list(spare)
            whole = _with(batch, columns, p, [None if i in going_on else int(x) for i, x in enumerate(p)])
            if wait:
                held = whole.take(pa.array(wait))
                keep = np.ones(len(p), bool)
                keep[wait] = False
                whole = whole.filter(pa.array(keep))
            yield whole

    return run


def _with(batch: pa.RecordBatch, columns, p, pick) -> pa.RecordBatch:
    arrays = list(batch.columns)
    arrays[columns.index("__p")] = pa.array(p, pa.float64())
    arrays[columns.index("__pick")] = pa.array(pick, pa.int32())
    return pa.RecordBatch.from_arrays(arrays, names=columns)


def _draw(key: str, level: int) -> Column:
    """An even draw from 0 to 1, new in every level."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(f"draw {level}")), F.lit(1 << 52)) / F.lit(float(1 << 52))


def mix(units: DataFrame, key: str = "doc_id", chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """``units`` (with source, size and a key) and source_size, target, copies.

    copies is 0 to 3; the same input gives the same copies, whatever its order.
    Units without words get the whole part of their rate only."""
    sizes = store(units, "units")
    stats = store(targets(sizes), "targets")
    rate = F.when(F.col("source_size") > 0, F.least(
        F.col("target") / F.col("source_size"), F.lit(float(MOST_COPIES)))).otherwise(F.lit(0.0))
    chunks = F.ceil(F.col("n_docs") / chunk).cast("long")
    rows = sizes.withColumnRenamed("source", "__s").join(
        stats, F.col("__s").eqNullSafe(F.col("source"))).drop("__s").select(
        *units.columns, "source_size", "target",
        F.floor(rate).cast("int").alias("__base"), (rate - F.floor(rate)).alias("__p"),
        F.col("size").cast("double").alias("__size"),
        _draw(key, 0).alias("__u"),
        F.pmod(F.xxhash64(F.col(key), F.lit("chunk")), chunks).alias("__chunk"),
        F.lit(None).cast("int").alias("__pick"))
    most = (stats.agg(F.max(chunks)).first()[0] or 1)
    settled, open_rows, level = None, rows, 0
    while open_rows is not None:
        grouped = open_rows.withColumn("__group", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), "__chunk"))
        columns = grouped.columns
        chunked = grouped.repartition("source", "__chunk").sortWithinPartitions(
            "__group", F.desc("__size"), key, "__u")
        done = store(map_batches(chunked, _level(columns, most <= 1), grouped.schema), "rounded")
        closed = done.where("__pick IS NOT NULL")
        settled = closed if settled is None else settled.unionByName(closed)
        level += 1
        open_rows = None if most <= 1 else done.where("__pick IS NULL").drop("__group").withColumns(
            {"__u": _draw(key, level), "__chunk": F.floor(F.col("__chunk") / fan)})
        most = -(-most // fan)
    return settled.select(
        *units.columns, "source_size", "target", (F.col("__base") + F.col("__pick")).alias("copies"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) per row of documents."""
    return mix(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken. Rows that are equal in
    doc_id, source and text are taken alike."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # in a struct, no name of theirs meets one of ours
    marked = docs.select(whole.alias("doc"), F.col("doc_id").alias("id"), F.col("source").alias("of"),
                         F.xxhash64(F.coalesce("text", F.lit("")), "source").alias("mark"), word_count(F.col("text")).alias("size"))
    units = marked.groupBy(F.col("id").alias("doc_id"), F.col("of").alias("source"), F.col("mark").alias("__mark")).agg(
        F.sum("size").alias("size"))
    taken = mix(units).where("copies > 0").select(
        F.col("doc_id").alias("__id"), F.col("__mark").alias("__m"), "copies")
    # what is taken grows with the documents, so it is never broadcast
    joined = marked.join(taken.hint("merge"), F.col("id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__m")))
    return joined.select("doc", F.explode(F.sequence(F.lit(1), "copies"))).select("doc.*")
