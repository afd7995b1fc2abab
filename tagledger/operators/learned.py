"""Suggestions learned from workloads that are tagged already.

A multinomial naive Bayes over the words of a workload's name, its owner and its workspace, each word marked with
where it stands. Training is three aggregates; a workload is scored by joining its words with the words'
log-odds and summing per team, exactly, in decimals of nine places, so the order of rows never matters. Confidence is
calibrated: a quarter of the tagged workloads, chosen by a digest of their key, takes no part in training,
and a score of some height is worth as much as such scores were right there.

Nulls have no words. A word that no tagged workload has counts for nothing; a workload without known words is
``unknown`` with confidence 0, as is everything when nothing is tagged. Only the teams asked for are learned,
which bounds the rows that one word is joined with.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tagledger.functions.predicates import is_resource
from tagledger.operators.inventory import latest_scan
from tagledger.operators.summary import WORKLOAD_KEY

#: Bins that scores are calibrated in, and how many held-out workloads a bin's own height counts as.
BINS = 20
PRIOR_RIGHT = 2
FACTS = {"name": "workload_name", "owner": "owner", "workspace": "workspace_id"}
_EXACT = "decimal(18,9)"
KEY = list(WORKLOAD_KEY)


def words() -> Column:
    """Words of a workload's facts, in lower case, as ``fact:word``; repeated ones count each time."""
    def of(fact: str, column: str) -> Column:
        parts = F.filter(F.split(F.lower(F.coalesce(F.col(column), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        return F.transform(parts, lambda w: F.concat(F.lit(f"{fact}:"), w))

    return F.concat(*[of(fact, column) for fact, column in FACTS.items()])


def held_out() -> Column:
    """Is the workload in the quarter that training leaves out?"""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in KEY]).cast("binary"))
    return F.substring(digest, 1, 1).isin("0", "4", "8", "c")


def tagged_workloads(inventory: DataFrame, key: str, by: str = "time") -> DataFrame:
    """Resources of the latest scan that carry ``key``, with its value as ``team``."""
    value = F.try_element_at("tags", F.lit(key))
    return latest_scan(inventory, by).where(is_resource() & F.col("tag_read_ok")).select(
        *KEY, "workspace_id", "workload_name", "owner", value.alias("team")).where("team IS NOT NULL")


class Model:
    """Log-odds per word and team (``weights``), and per team its prior and what a word it never had
    counts (``classes``, a row per team that has tagged workloads)."""

    def __init__(self, tagged: DataFrame, teams: Sequence[str]):
        mine = tagged.where(F.col("team").isin(*teams))
        counts = mine.select("team", F.explode(words()).alias("word")).groupBy("word", "team").agg(F.count(F.lit(1)).alias("n"))
        size = counts.agg(F.count_distinct("word").alias("size")).scalar()
        docs = mine.groupBy("team").agg(F.count(F.lit(1)).alias("docs"))
        used = counts.groupBy("team").agg(F.sum("n").alias("used"))
        total = mine.agg(F.count(F.lit(1))).scalar()

        def exact(ratio: Column) -> Column:
            return F.round(F.log(ratio), 9).cast(_EXACT)

        self.weights = counts.select("word", "team", exact((F.col("n") + 1).cast("double")).alias("weight"))
        self.classes = docs.join(used, "team", "left").select(
            "team", exact(F.col("docs") / total).alias("prior"),
            exact(F.lit(1.0) / (F.coalesce("used", F.lit(0)) + size)).alias("unseen"))

    def scored(self, workloads: DataFrame) -> DataFrame:
        """(product, workload_id, team, posterior, word): the best team (the first by name of equal ones), its
        share of all teams' probability, and the word that speaks most for it. Workloads without known words are left out."""
        held = workloads.select(*KEY, F.explode(words()).alias("word"))
        known = self.weights.select("word").distinct().withColumn("_known", F.lit(1))
        lengths = held.join(known, "word").groupBy(*KEY).agg(F.count(F.lit(1)).alias("length"))
        hits = held.join(self.weights, "word").groupBy(*KEY, "team").agg(
            F.sum("weight").cast(_EXACT).alias("sum"), F.max(F.struct("weight", "word"))["word"].alias("word"))
        found = hits.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("team", F.struct("sum", "word")))).alias("hits"))
        classes = self.classes.agg(F.sort_array(F.collect_list(F.struct("team", "prior", "unseen")))).scalar()
        zero = F.lit(0).cast(_EXACT)

        def score(c: Column) -> Column:
            hit = F.try_element_at("hits", c["team"])
            total = c["prior"] + F.col("length").cast("decimal(9,0)") * c["unseen"] + F.coalesce(hit["sum"], zero)
            return F.struct((-total.cast("decimal(28,9)")).alias("loss"), c["team"].alias("team"), hit["word"].alias("word"))

        least = F.array_min("scores")
        odds = F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp((F.col("best.loss") - s["loss"]).cast("double")))
        return lengths.join(found, KEY).withColumn("classes", classes).withColumn("scores", F.transform("classes", score)) \
            .withColumn("best", least).select(
            *KEY, F.col("best.team").alias("team"), F.round(1 / odds, 9).alias("posterior"), F.col("best.word").alias("word"))


def _bin() -> Column:
    return F.least(F.floor(F.col("posterior") * BINS), F.lit(BINS - 1)).cast("int")


def reliability(model: Model, tagged: DataFrame) -> DataFrame:
    """(bin, n, confidence) of held-out workloads: how often a posterior of that height was right, where the height
    itself counts as ``PRIOR_RIGHT`` workloads."""
    truth = tagged.where(held_out()).select(*KEY, F.col("team").alias("truth"))
    judged = model.scored(tagged.where(held_out())).join(truth, KEY).withColumn("bin", _bin())
    middle = (F.col("bin") + 0.5) / BINS
    right = F.count_if(F.col("team") == F.col("truth"))
    return judged.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), right.alias("right")).select(
        "bin", "n", F.round((F.col("right") + PRIOR_RIGHT * middle) / (F.col("n") + PRIOR_RIGHT), 6).alias("confidence"))


def learned_suggestions(workloads: DataFrame, tagged: DataFrame, teams: Sequence[str], now: dt.datetime) -> DataFrame:
    """Suggestions table for workloads (of ``scoring_workloads``), learned from ``tagged`` ones, whose key occurs once."""
    model = Model(tagged.where(~held_out()), teams)
    worth = reliability(model, tagged).agg(F.map_from_entries(F.collect_list(F.struct("bin", "confidence")))).scalar()
    middle = (_bin() + 0.5) / BINS
    found = model.scored(workloads).withColumn("confidence", F.coalesce(F.try_element_at(worth, _bin()), F.round(middle, 6)))
    return workloads.join(found, KEY, "left").select(
        *KEY, "workload_name", "owner", "workspace_id", F.col("cost").alias("list_cost"),
        F.coalesce("team", F.lit("unknown")).alias("suggested_cost_center"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.when(F.col("team").isNull(), "no known word").otherwise(
            F.concat(F.lit("learned from "), F.coalesce("word", F.lit("the team's size")))).alias("rationale"),
        F.lit(now).alias("annotated_at"))


def accuracy(tagged: DataFrame, teams: Sequence[str], scorer=None) -> DataFrame:
    """(method, n, n_right) on the held-out workloads: of the learned teams and, if given, of a ``scorer`` of prompts."""
    test = tagged.where(held_out() & F.col("team").isin(*teams))
    model = Model(tagged.where(~held_out()), teams)
    guess = test.join(model.scored(test).select(*KEY, F.col("team").alias("guess")), KEY, "left").select(
        F.lit("learned").alias("method"), "team", "guess")
    if scorer is not None:
        from tagledger.operators.suggestions import ANSWER_SCHEMA, prompt

        asked = F.from_json(scorer(prompt(list(teams))), ANSWER_SCHEMA)
        guess = guess.unionByName(test.select(F.lit("words").alias("method"), "team", asked["cost_center"].alias("guess")))
    return guess.groupBy("method").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("guess") == F.col("team")).alias("n_right"))
