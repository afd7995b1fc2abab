"""Line dedup with levelled sorted runs of line hashes, in DataFrame functions only.

Documents come in batches. A batch's line keys are counted, anti-joined with
the runs kept so far, and what is new becomes a sorted run of its own; keys
that a run already holds are set down as recurrences. Runs of one level merge
into a run of the next, so there are about log(batches) of them. Keys are 96
bits of hash; a text is shuffled once, to meet the list of what it loses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagledger.llm.shared import SPACE_CHARS, store

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
KEY = ["h1", "h2"]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z only; the quick form serves where bytes and code points are as many."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashed(text: Column) -> Column:
    """Hashes of the line keys that are long enough, each once."""
    keys = F.filter(
        F.transform(F.array_distinct(_lines(ascii_lower(F.coalesce(text, F.lit(""))))),
                    lambda x: F.btrim(x, F.lit(SPACE_CHARS))),
        lambda k: F.char_length(k) >= MIN_CHARS)
    return F.array_distinct(F.transform(
        keys, lambda k: F.struct(F.xxhash64(k).alias("h1"), F.hash(k).alias("h2"))))


class Runs:
    """Disjoint runs of (h1, h2, n, last), sorted by key, by level."""

    def __init__(self):
        self.levels: list[DataFrame | None] = []

    def unseen(self, batch: DataFrame) -> DataFrame:
        for run in filter(None, self.levels):
            batch = batch.join(run.select(*KEY), KEY, "left_anti")
        return batch

    def seen(self, batch: DataFrame) -> DataFrame | None:
        """Each key is in one run at most."""
        found = None
        for run in filter(None, self.levels):
            part = batch.join(run.select(*KEY), KEY, "left_semi")
            found = part if found is None else found.unionByName(part)
        return found

    def add(self, run: DataFrame) -> None:
        level = 0
        while level < len(self.levels) and self.levels[level] is not None:
            run = run.unionByName(self.levels[level])
            self.levels[level] = None
            level += 1
        if level == len(self.levels):
            self.levels.append(None)
        self.levels[level] = store(run.repartition(*KEY).sortWithinPartitions(*KEY), f"run-{level}")

    def all(self) -> list[DataFrame]:
        return [r for r in self.levels if r is not None]


def repeated_lines(occurrences: DataFrame, batches: int = BATCHES, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2, last) of keys found in enough documents. ``occurrences`` is
    (batch, id, h1, h2), a key once per document."""
    runs, again = Runs(), []
    for b in range(batches):
        batch = occurrences.where(F.col("batch") == b).groupBy(*KEY).agg(
            F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
        if b:
            batch = store(batch, "batch")
            again.append(runs.seen(batch))
        runs.add(runs.unseen(batch))
    parts = runs.all() + again
    counted = parts[0]
    for part in parts[1:]:
        counted = counted.unionByName(part)
    return counted.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("last").alias("last")).where(
        F.col("n") >= min_docs).select(*KEY, "last")


def drop_repeated_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc_id, kept_text, n_lines, n_dropped) per row of documents.

    A line whose key (white space stripped, A-Z lower-cased) has at least 20 code
    points and stands in at least 3 documents goes, except from the largest
    doc_id that holds it. Rows that repeat a doc_id count as documents each and
    share what they lose; a null doc_id is below all others."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lowest = F.lit(-(2 ** 63))
    found = docs.select(F.coalesce("doc_id", lowest).alias("id"), F.explode(_hashed(F.col("text"))).alias("k"))
    occurrences = store(found.select(
        F.pmod(F.hash("id"), F.lit(batches)).alias("batch"), "id", "k.h1", "k.h2"), "lines")
    drop = store(repeated_lines(occurrences, batches), "repeated")
    lost = store(occurrences.join(drop, KEY).where("id <> last").select("id", "h1"), "lost").groupBy("id").agg(
        F.collect_set("h1").alias("lost"))
    both = docs.withColumn("id", F.coalesce("doc_id", lowest)).join(lost, "id", "left")
    lines = _lines(F.col("text"))
    kept = F.filter(lines, lambda x: ~F.array_contains(
        F.col("lost"), F.xxhash64(F.btrim(ascii_lower(x), F.lit(SPACE_CHARS)))))
    return both.select(
        "doc_id", F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("lost").isNotNull(), kept).alias("kept"), F.coalesce("text", F.lit("")).alias("text"),
    ).select(
        "doc_id", "n_lines",
        F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("kept_text"))
