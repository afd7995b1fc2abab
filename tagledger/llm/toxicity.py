"""Toxicity by maximum-scoring segments.

Units of text are words, backed off to their first 6, 4 and 3 letters. From a
bounded sample of labelled documents each unit gets a log-odds with an informative
Dirichlet prior (its own share of all sampled documents); units whose log-odds is
sure enough make the model. A document is a sequence of scores with a negative
drift, and one linear scan finds all of its maximal scoring segments. Segment
scores of clean documents fall off exponentially; from their rate, K and lambda of the
extreme-value law turn a segment's score into the number of such segments that a
clean text of that length has by chance. A document's evidence is the sum of the
logarithms for its significant segments, and a logistic curve over binned evidence of
other labelled documents turns it into a score from 0 to 1.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tagledger.llm.shared import TEXTS, map_batches, store

#: Labelled documents that the model is fitted on, about; drawn by hash of doc_id.
MAX_LABELLED = 20_000
HELD_OUT = 5
PREFIXES = (6, 4, 3)
#: Weight of the prior in documents, least documents of a unit, least deviate of its log-odds and least log-odds:
#: with many labels, words that all texts share get small odds that are sure, and would add up in long texts.
PRIOR, SUPPORT, SURE, LEAST = 50.0, 3, 3.5, 2.0
#: What a word without a sure unit adds; a scan needs a negative mean.
DRIFT = -0.25
#: Words whose scores a worker remembers.
REMEMBERED = 300_000
BINS = 200
WORD = re.compile(r"\w+")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HELD_OUT == 0, F.lit(False))


def units_of(word: str) -> list[str]:
    """The word itself and its beginnings, the longest first."""
    return ["=" + word] + [word[:n] for n in PREFIXES if len(word) > n]


@dataclass(frozen=True)
class Model:
    """Scores of units; K and lambda of chance segments; slope and offset of the curve."""

    weights: dict[str, float]
    k: float = 1e-4
    decay: float = 1.0
    slope: float = 0.0
    offset: float = -20.0

    def word(self, word: str) -> float:
        return next((self.weights[u] for u in units_of(word) if u in self.weights), DRIFT)

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> float:
        """Over segments rarer than one per clean text of this length, the sum of -log of how many there are by chance."""
        floor = math.log(max(self.k * n, 1e-9))
        return sum(max(0.0, self.decay * s - floor) for _, _, s in segments)

    def score(self, evidence: float) -> float:
        x = self.offset + self.slope * math.log1p(evidence)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, past the last, score), in one linear scan: a new
    positive stretch joins those before it for as long as that raises the score. Each segment is linked to the
    nearest earlier one it could join, so those between are never looked at again."""
    good = np.flatnonzero(scores > 0)
    if not len(good):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # first, past the last, sum before, sum through
    link: list[int] = []  # the nearest earlier one with a smaller sum before
    for i in good.tolist():
        cand, j = [i, i + 1, sums[i], sums[i + 1]], len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= cand[2]:
                j = link[j]
            if j < 0 or found[j][3] >= cand[3]:
                found.append(cand)
                link.append(j)
                break
            cand, before = [found[j][0], cand[1], found[j][2], cand[3]], link[j]
            del found[j:], link[j:]
            j = before
    return [(a, b, float(t - s)) for a, b, s, t in found]


class Scorer:
    """Scores of whole texts under a model; remembers words up to a bound."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def _new(self, word: str) -> float:
        score = self.model.word(word)
        if len(self.known) < REMEMBERED:
            self.known[word] = score
        return score

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        words = WORD.findall((text or "").lower())
        get, new = self.known.get, self._new
        scores = [s if (s := get(w)) is not None else new(w) for w in words]
        return len(words), segments(np.array(scores)) if words else []


def _count_units(batches):
    """(unit, toxic documents, clean documents) of each batch."""
    for batch in batches:
        counts = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[toxic].update({u for w in set(WORD.findall((text or "").lower())) for u in units_of(w)})
        units = sorted(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(units), pa.array([counts[1][u] for u in units], pa.int64()),
             pa.array([counts[0][u] for u in units], pa.int64())], names=["unit", "toxic", "clean"])


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic, second): about ``bound`` labelled documents that are not held out. The
    labels picked are few, so they go to the documents, not the other way round."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    share = min(1.0, bound / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))
    return store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(picked), "doc_id").select(
        "text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)) == 0).alias("second")), "sample")


def _weights(sample: DataFrame) -> dict[str, float]:
    """Sure log-odds per unit. Their number is bounded by the sample."""
    first = sample.where("NOT second")
    n1, n0 = (first.where(f"toxic = {t}").count() for t in (1, 0))
    if not n1 or not n0:
        return {}
    counts = map_batches(first.select("text", "toxic"), _count_units, "unit string, toxic long, clean long", TEXTS).groupBy(
        "unit").agg(F.sum("toxic").alias("y1"), F.sum("clean").alias("y0")).where(F.col("y1") + F.col("y0") >= SUPPORT)
    prior = PRIOR * (F.col("y1") + F.col("y0")) / (n1 + n0)
    a, b = F.col("y1") + prior, F.col("y0") + prior
    odds = F.log(a / (n1 + PRIOR + 1 - a)) - F.log(b / (n0 + PRIOR + 1 - b))
    sure = counts.select("unit", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z")).where(
        (F.abs("z") >= SURE) & (F.abs("odds") >= LEAST))
    return {r["unit"]: r["odds"] for r in sure.select("unit", "odds").collect()}


def _measured(rows: DataFrame, model: Model) -> DataFrame:
    """(toxic, n, found, total, evidence) of each labelled text."""
    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                n, found = scorer.scan(text)
                out.append((n, len(found), sum(s for _, _, s in found), model.evidence(n, found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1)] + [pa.array([o[i] for o in out], t) for i, t in enumerate(
                    (pa.int64(), pa.int64(), pa.float64(), pa.float64()))],
                names=["toxic", "n", "found", "total", "evidence"])

    return map_batches(rows.select("text", "toxic"), run,
                       "toxic int, n long, found long, total double, evidence double", TEXTS)


def _curve(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and offset of a logistic curve over (evidence, toxic, clean), slope held back by a weak prior."""
    x = np.log1p(np.array([b[0] for b in bins]))
    y1, y0 = (np.array([b[i] for b in bins], float) for i in (1, 2))
    design, theta = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -50, 50)))
        n = y1 + y0
        slope = design.T @ (y1 - n * p) - theta * [0.1, 1e-3]
        bend = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag([0.1, 1e-3])
        step = np.linalg.solve(bend, slope)
        theta += step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return float(theta[0]), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """With labels of one class only there is nothing to tell apart, and every score is near 0."""
    sample = labelled_sample(docs, labels)
    weights = _weights(sample)
    if not weights:
        return Model({})
    second = sample.where("second")
    clean = _measured(second, Model(weights)).where("toxic = 0").agg(
        F.sum("n").alias("n"), F.sum("found").alias("found"), F.sum("total").alias("total")).first()
    # no segment scores below LEAST, and above it their scores fall off; a made-up one keeps the law proper
    # where there are none
    found, n = (clean["found"] or 0) + 1, (clean["n"] or 0) + 1
    decay = found / ((clean["total"] or 0.0) - (found - 1) * LEAST + 1.0)
    model = Model(weights, k=found / n * math.exp(decay * LEAST), decay=decay)
    width = 0.25
    rows = _measured(second, model).groupBy(
        F.least(F.floor(F.col("evidence") / width), F.lit(BINS)).alias("bin")).agg(
        F.avg("evidence").alias("evidence"), F.count_if(F.col("toxic") == 1).alias("y1"), F.count_if(F.col("toxic") == 0).alias("y0")).collect()
    slope, offset = _curve([(r["evidence"], r["y1"], r["y0"]) for r in rows])
    return Model(weights, model.k, model.decay, slope, offset)


SCHEMA = "doc_id long, score double, n_passages long, worst double, passages array<struct<first:int,past:int,score:double>>"


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of documents the score and its significant passages (places of words). An empty
    text has no passage and the score of no evidence."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        scorer = Scorer(held.value)
        for batch in batches:
            scores, worst, passages = [], [], []
            for text in batch.column(1).to_pylist():
                n, found = scorer.scan(text)
                sure = [f for f in found if scorer.model.evidence(n, [f]) > 0]
                scores.append(scorer.model.score(scorer.model.evidence(n, sure)))
                worst.append(max((s for _, _, s in sure), default=0.0))
                passages.append([{"first": a, "past": b, "score": s} for a, b, s in sure])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([len(p) for p in passages], pa.int64()),
                 pa.array(worst, pa.float64()), pa.array(passages, passage)],
                names=["doc_id", "score", "n_passages", "worst", "passages"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA, TEXTS)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = score_documents(docs, fit(docs, labels))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                       "n_passages", "worst")


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, in one pass and without a join."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    place = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(held.value)
        for batch in batches:
            scans = (scorer.scan(t) for t in batch.column(place).to_pylist())
            yield batch.filter(pa.array([scorer.model.score(scorer.model.evidence(n, f)) < 0.5 for n, f in scans], pa.bool_()))

    return map_batches(docs, run, docs.schema, TEXTS)
