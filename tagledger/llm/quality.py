"""Quality rules as a learned decision list, in DataFrame functions only.

Per-text statistics are computed once and stored. Labelled rows are binned at
quantiles. Sequential covering then grows one rule after the other: each step
asks for the histogram of every statistic over the rows still in play (a
few hundred counts, however many rows) and adds the threshold of the highest
information gain; conditions that do not help on held-back rows are pruned from the end.
The list becomes one ordered CASE expression over the statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tagledger.llm.shared import SPACE_CHARS, SPACE_CLASS, store

SYMBOLS = "#*$%&|<>"
#: Places of words that fit beside a hash in one LONG; longer texts sort pairs.
PLACE_BITS = 20
WINDOW = 3
BINS = 24
MOST_RULES = 8
MOST_CONDITIONS = 3
#: A rule has to be right on this share of what it covers among the rows held back, and cover so many of them.
PRECISION = 0.8
SUPPORT = 5

#: What rules may ask about, as SQL over the statistics.
FEATURES = {
    "words": "CAST(n_words AS DOUBLE)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "stops": "n_stops / greatest(n_words, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
}


def _kept_length(text: Column, drop: str) -> Column:
    return F.char_length(F.regexp_replace(text, drop, "")).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """Counts of whole texts, one row per row of documents. An empty text has zeros and one
    line. A word counts as repeated if it lies in a window of 3 words that stands in the text
    twice or more."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
            F.split(trimmed, f"[{SPACE_CLASS}]+", -1)).alias("w"),
        F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "").alias("lines"))
    n = F.size("w")
    hashes = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(WINDOW)])))
    hashed = base.select(
        "doc_id", n.cast("long").alias("n_words"),
        _kept_length(F.col("text"), f"[{SPACE_CLASS}]+").alias("word_chars"),
        _kept_length(F.col("text"), f"[^{SYMBOLS}]+").alias("n_symbols"),
        _kept_length(F.col("text"), "[^0-9]+").alias("n_digits"),
        _kept_length(F.col("text"), r"[^\p{Lu}]+").alias("n_capitals"),
        _kept_length(F.col("text"), r"[^.!?]+").alias("n_stops"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), hashes.alias("h"))
    low = F.lit((1 << PLACE_BITS) - 1).cast("long")
    high = F.lit(-(1 << PLACE_BITS)).cast("long")
    small = F.col("n_words") < (1 << PLACE_BITS)
    packed = hashed.select("*", F.when(small, F.sort_array(F.transform(
        "h", lambda x, i: x.bitwiseAND(high).bitwiseOR(i.cast("long"))))).alias("s")).select(
        "*", F.when(~small, F.array_sort(F.transform(
            "h", lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))).alias("pairs"))

    def twin(x: Column, j: Column) -> Column:
        """The neighbour in order has the same hash."""
        y = F.get(F.col("s"), j)
        return F.coalesce((x.bitwiseAND(high) == y.bitwiseAND(high)) & (
            F.get(F.col("h"), x.bitwiseAND(low).cast("int")) == F.get(F.col("h"), y.bitwiseAND(low).cast("int"))),
            F.lit(False))

    def pair_twin(x: Column, j: Column) -> Column:
        return F.coalesce(x["h"] == F.get(F.col("pairs"), j)["h"], F.lit(False))

    places = F.when(small, F.transform(
        F.filter("s", lambda x, i: twin(x, i - 1) | twin(x, i + 1)), lambda x: x.bitwiseAND(low))).otherwise(
        F.transform(F.filter("pairs", lambda x, i: pair_twin(x, i - 1) | pair_twin(x, i + 1)), lambda x: x["i"]))
    placed = packed.select("*", F.sort_array(F.coalesce(places, F.array().cast("array<bigint>"))).alias("at"))
    gaps = F.transform("at", lambda x, i: F.coalesce(F.least(
        F.get(F.col("at"), i + 1) - x, F.lit(WINDOW).cast("long")), F.lit(WINDOW).cast("long")))
    return placed.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_digits", "n_capitals", "n_stops", "n_lines",
        "n_dup_lines", "n_distinct",
        F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.threshold if self.above else value <= self.threshold

    def binned(self, cuts: dict[str, list[float]]) -> Column:
        place = cuts[self.feature].index(self.threshold)
        bin_ = F.col(f"bin_{self.feature}")
        return bin_ > place if self.above else bin_ <= place


Rule = tuple[Condition, ...]


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p and p0 else 0.0


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    """Conditions by information gain until the rule covers no good text. Every step collects
    a histogram of at most features x (BINS + 1) counts."""
    rule: Rule = ()
    names = list(FEATURES)
    while len(rule) < MOST_CONDITIONS:
        inside = rows.where(_all(c.binned(cuts) for c in rule))
        cells = inside.select("bad", F.posexplode(F.array(*[F.col(f"bin_{f}") for f in names])).alias("f", "b")) \
            .groupBy("f", "b").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
        if not cells:
            break
        counts = {(c["f"], c["b"]): (c["p"], c["n"]) for c in cells}
        p0 = sum(v[0] for k, v in counts.items() if k[0] == 0)
        n0 = sum(v[1] for k, v in counts.items() if k[0] == 0)
        best, chosen = 0.0, None
        for f, name in enumerate(names):
            p = n = 0
            for place, cut in enumerate(cuts[name]):
                more = counts.get((f, place), (0, 0))
                p, n = p + more[0], n + more[1]
                for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                    if a >= SUPPORT and (gain := _gain(a, b, p0, n0)) > best + 1e-9:
                        best, chosen = gain, Condition(name, above, cut)
        if chosen is None:
            break
        rule += (chosen,)
        if n0 == 0:
            break
    return rule


def _prune(rows: DataFrame, rule: Rule, cuts) -> Rule | None:
    """The leading conditions that do best on rows held back; None if none is good enough."""
    counts = rows.agg(*[F.count_if(_all(c.binned(cuts) for c in rule[:k]) & (F.col("bad") == bad)).alias(f"{k}_{bad}")
                        for k in range(1, len(rule) + 1) for bad in (True, False)]).first()
    best = None
    for k in range(1, len(rule) + 1):
        p, n = counts[f"{k}_True"], counts[f"{k}_False"]
        if p >= SUPPORT and p / (p + n) >= PRECISION and (best is None or (p - n) / (p + n) > best[0] + 1e-9):
            best = ((p - n) / (p + n), k)
    return rule[: best[1]] if best else None


def learn(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules for low quality, in order. All rows with label 0 or 1 count; a third, by hash of
    doc_id, is held back for pruning. No labels, no rules."""
    marked = stats.join(labels.where("quality IN (0, 1)").select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 0).alias("bad")), "doc_id").where(~base_failed())
    rows = store(marked.select("bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held"),
                               *[F.expr(v).alias(f) for f, v in FEATURES.items()]), "labelled")
    quantiles = rows.agg(*[F.percentile_approx(f, [i / BINS for i in range(BINS)], 10_000).alias(f) for f in FEATURES]).first()
    if quantiles[0] is None:
        return []
    cuts = {f: sorted(set(quantiles[f])) for f in FEATURES}
    binned = store(rows.select("bad", "held", *[_bin(f, cuts[f]) for f in FEATURES]), "binned")
    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        left = binned.where(~_any(_all(c.binned(cuts) for c in r) for r in rules))
        grown = _grow(left.where(~F.col("held")), cuts)
        rule = _prune(left.where("held"), grown, cuts) if grown else None
        if rule is None:
            break
        rules.append(rule)
    return rules


def _bin(feature: str, cuts: list[float]) -> Column:
    """How many cuts the value exceeds."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: F.col(feature) > t)).alias(f"bin_{feature}")


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def verdict(rules: list[Rule]) -> Column:
    """The decision list: the first rule that holds decides, otherwise the text is kept."""
    column = F.when(base_failed(), False)
    for rule in rules:
        column = column.when(_all(c.column() for c in rule), False)
    return column.otherwise(True)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics of every row of documents, base_failed and kept."""
    stats = store(statistics(docs), "statistics")
    return stats.select("*", base_failed().alias("base_failed"), verdict(learn(stats, labels)).alias("kept"))
