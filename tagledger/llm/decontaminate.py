"""Benchmark decontamination: a BM25 index of the test items, searched by block-max WAND.

Terms are pairs of adjacent words, so that common words alone match little. An item's
weights are divided by the score it would give itself: a score is the share of the
item's BM25 that a passage holds, and one threshold suits all. Passages
are overlapping windows of a document, twice as long as the longest item, so one of
them holds any copy whole. A window whose bounds cannot reach the threshold costs a
running sum; the others walk the postings. What is retrieved is verified: enough
five-word runs of the item's question and of its answer stand in the passage, or, as one
edit breaks most runs of a short part, enough of its words in order where the copy lies.
Items are indexed in shards of bounded size; each is broadcast on its own.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagledger.llm.licenses import WORD_BYTES
from tagledger.llm.shared import TEXTS, map_batches

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.5
SHINGLE = 5
BLOCK = 16
SHORTEST_PASSAGE = 64
#: Items and bytes of text in one index shard, which bound what is broadcast.
SHARD_ITEMS, SHARD_BYTES = 5_000, 8_000_000
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The last sentence is the answer; of a single sentence, the last quarter of its words."""
    parts = [w for w in map(words_of, SENTENCE.split(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - max(1, len(words) // 4)
    return words[:cut], words[cut:]


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    n = min(SHINGLE, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


class Postings:
    """Items and weights of one term in order of items, with the largest weight of each block."""

    __slots__ = ("items", "weights", "most", "block_most")

    def __init__(self, pairs: list[tuple[int, float]]):
        self.items = [p[0] for p in pairs]
        self.weights = [p[1] for p in pairs]
        self.block_most = [max(self.weights[i:i + BLOCK]) for i in range(0, len(pairs), BLOCK)]
        self.most = max(self.block_most)


class Index:
    """BM25 over word pairs of items (id, text). Items of fewer than two words have no pairs and are never found."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids, self.parts, self.whole, counts = [], [], [], []
        for item_id, text in items:
            words = words_of(text)
            if len(words) > 1:
                self.ids.append(item_id)
                question, answer = question_and_answer(text)
                self.parts.append((shingles(question), shingles(answer)))
                self.whole.append((question, answer))
                counts.append((len(words), Counter(zip(words, words[1:]))))
        df = Counter(t for _, c in counts for t in c)
        n, mean = len(counts), sum(x for x, _ in counts) / max(1, len(counts))
        idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        lists: dict[tuple[bytes, bytes], list[tuple[int, float]]] = {}
        for i, (size, terms) in enumerate(counts):
            weights = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean)) for t, f in terms.items()}
            whole = sum(weights.values())
            for t, w in weights.items():
                lists.setdefault(t, []).append((i, w / whole))
        self.words = {w: k for k, w in enumerate(sorted({w for t in lists for w in t}))}
        keyed = sorted((self.words[a] * len(self.words) + self.words[b], p) for (a, b), p in lists.items())
        self.keys = np.array([k for k, _ in keyed], np.int64)
        self.postings = [Postings(p) for _, p in keyed]
        self.most = np.array([p.most for p in self.postings] + [0.0])
        self.window = max(SHORTEST_PASSAGE, 2 * max((x for x, _ in counts), default=0))

    def terms(self, words: list[bytes]) -> np.ndarray:
        """The place in ``postings`` of each adjacent pair, or its length where there is none."""
        get = self.words.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        left, right = ids[:-1], ids[1:]
        out = np.full(len(left), len(self.keys), np.int64)
        both = np.flatnonzero((left >= 0) & (right >= 0))
        pair = left[both] * len(self.words) + right[both]
        place = np.searchsorted(self.keys, pair)
        place[place == len(self.keys)] = 0
        hit = self.keys[place] == pair
        out[both[hit]] = place[hit]
        return out

    def search(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """Every item whose score reaches the threshold, by block-max WAND."""
        low = threshold - 1e-9
        cursors = [[self.postings[t], 0] for t in terms]
        found = []
        while True:
            cursors = [c for c in cursors if c[1] < len(c[0].items)]
            cursors.sort(key=lambda c: c[0].items[c[1]])
            total, pivot = 0.0, None
            for k, (p, _) in enumerate(cursors):
                total += p.most
                if total >= low:
                    pivot = k
                    break
            if pivot is None:
                return found
            item = cursors[pivot][0].items[cursors[pivot][1]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0].items[cursors[pivot + 1][1]] == item:
                pivot += 1
            bound, stop = 0.0, None
            for p, at in cursors[: pivot + 1]:
                at = bisect_left(p.items, item, at)
                if at < len(p.items):
                    block = at // BLOCK
                    bound += p.block_most[block]
                    last = p.items[min(len(p.items), (block + 1) * BLOCK) - 1]
                    stop = last if stop is None else min(stop, last)
            if bound >= low:
                if cursors[0][0].items[cursors[0][1]] == item:
                    score = sum(p.weights[at] for p, at in cursors[: pivot + 1])
                    if score >= low:
                        found.append((item, score))
                    for c in cursors[: pivot + 1]:
                        c[1] += 1
                    continue
                goal = item
            else:  # nothing up to the end of these blocks can reach it, nor before the next list's item
                goal = stop + 1
                if pivot + 1 < len(cursors):
                    goal = min(goal, cursors[pivot + 1][0].items[cursors[pivot + 1][1]])
                goal = max(goal, item + 1)
            for c in cursors[: pivot + 1]:
                c[1] = bisect_left(c[0].items, goal, c[1])

    def leaks(self, text: str | None) -> dict[int, tuple[float, float, float, int]]:
        """item -> (score, question overlap, answer overlap, first word of the passage)."""
        words = words_of(text)
        if len(words) < 2 or not len(self.keys):
            return {}
        terms = self.terms(words)
        sums = np.concatenate([[0.0], np.cumsum(self.most[terms])])
        size, n = self.window - 1, len(terms)
        starts = np.arange(0, max(1, n - size // 2), size // 2)
        bounds = sums[np.minimum(starts + size, n)] - sums[starts]
        out: dict[int, tuple[float, float, float, int]] = {}
        for start in starts[bounds >= THRESHOLD - 1e-9].tolist():
            held = np.unique(terms[start:start + size])
            hits = self.search(held[held < len(self.keys)].tolist())
            if not hits:
                continue
            passage = words[start:start + size + 1]
            for item, score in hits:
                question, answer = (
                    (len(part & _runs(passage, part)) / len(part) if part else 1.0) for part in self.parts[item])
                if question < OVERLAP or answer < OVERLAP:
                    in_order = words_in_order(*self.whole[item], passage)
                    question, answer = max(question, in_order[0]), max(answer, in_order[1])
                best = out.get(item)
                if question >= OVERLAP and answer >= OVERLAP and (best is None or score > best[0]):
                    out[item] = (score, question, answer, start)
        return out


def _runs(words: list[bytes], like: set[tuple[bytes, ...]]) -> set[tuple[bytes, ...]]:
    """Runs of words as long as those of ``like``."""
    n = len(next(iter(like)))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def words_in_order(question: list[bytes], answer: list[bytes], passage: list[bytes]) -> tuple[float, float]:
    """The shares of the question's and of the answer's words that stand in order in the stretch of the passage
    where the copy lies: around the longest run of the item's words, an eighth longer on either side."""
    item = question + answer
    matcher = SequenceMatcher(None, item, passage, autojunk=False)
    best = matcher.find_longest_match()
    slack = max(2, len(item) // 8)
    low = max(0, best.b - best.a - slack)
    matcher.set_seq2(passage[low:best.b - best.a + len(item) + slack])
    counts = [0, 0]
    for block in matcher.get_matching_blocks():
        first = max(0, min(block.a + block.size, len(question)) - block.a)
        counts[0] += first
        counts[1] += block.size - first
    return tuple(n / len(part) if part else 1.0 for n, part in zip(counts, (question, answer)))


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def _shards(items: DataFrame):
    """The items in lists of bounded size, whatever their number."""
    sized = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = sized.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    count = max(1, -(-total["n"] // SHARD_ITEMS), -(-(total["b"] or 0) // SHARD_BYTES)) if total["n"] else 0
    for k in range(count):
        part = sized.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(count)) == k)
        yield sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, overlaps, first_word): one row per document row and item that it
    leaks, with its best passage. Items that repeat are each reported; empty texts leak nothing."""
    spark, texts, out = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for shard in _shards(items):
        index = spark.sparkContext.broadcast(Index(shard))

        def run(batches, index=index):
            held = index.value
            for batch in batches:
                rows = [(d, held.ids[i], *found) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                        for i, found in held.leaks(t).items()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], pa.float64() if 2 <= k <= 4 else pa.int64()) for k in range(6)],
                    names=[c.split()[0] for c in SCHEMA.split(", ")])

        part = map_batches(texts, run, SCHEMA, TEXTS)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that leak no item, in one pass per index shard and without a join."""
    place = docs.columns.index("text")
    for shard in _shards(items):
        index = docs.sparkSession.sparkContext.broadcast(Index(shard))

        def run(batches, index=index):
            held = index.value
            for batch in batches:
                yield batch.filter(pa.array([not held.leaks(t) for t in batch.column(place).to_pylist()], pa.bool_()))

        docs = map_batches(docs, run, docs.schema, TEXTS)
    return docs
