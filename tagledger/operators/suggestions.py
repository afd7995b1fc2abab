"""Scored suggestions: make them, and report what they would tag."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tagledger.constants import SCORING_DAYS
from tagledger.functions.predicates import confident, taggable
from tagledger.operators.guards import not_handled
from tagledger.operators.summary import WORKLOAD_KEY, workload_rollup

ANSWER_SCHEMA = "cost_center STRING, confidence DOUBLE, rationale STRING"

def scoring_workloads(summary: DataFrame, as_of: dt.date, key: str = "cost_center",
                      days: int = SCORING_DAYS) -> DataFrame:
    """Workloads worth scoring: cost in the window and the key still missing."""
    return (
        workload_rollup(summary, [key], as_of, days)
        .filter(F.col("is_untagged") & (F.col("cost") > 0))
        .select(*WORKLOAD_KEY, "workload_name", "owner", "workspace_id", "cost")
    )


def prompt(teams: Sequence[str]) -> Column:
    """The text a scorer reads for one workload: the teams to choose from and
    what is known, one fact per line (line breaks inside a fact become blanks)."""
    def fact(label: str, column: str) -> Column:
        known = F.coalesce(F.col(column), F.lit("(none)"))
        return F.concat(F.lit(f"{label}: "), F.regexp_replace(known, r"[\r\n]+", " "))

    return F.concat_ws(
        "\n", F.lit(f"Which of these teams runs the workload: {', '.join(teams)}?"),
        fact("workload", "workload_name"), fact("owner", "owner"), fact("product", "product"),
        F.lit('Reply as JSON with cost_center, confidence from 0 to 1 and rationale; '
              'if no team fits, cost_center is "unknown".'))


def keyword_scorer(team_words: Mapping[str, Sequence[str]]) -> Callable[[Column], Column]:
    """A scorer that looks for whole words in the prompt's facts: the first team
    with a word in the workload's name (0.8), else in the owner (0.6), else unknown (0.2).
    Plain expressions, no model. The words are the caller's, in lower case."""
    def answer(team: str, confidence: float, why: str) -> Column:
        return F.lit(json.dumps({"cost_center": team, "confidence": confidence, "rationale": why}))

    def score(text: Column) -> Column:
        scored = answer("unknown", 0.2, "no signal in name or owner")
        for label, confidence in (("owner", 0.6), ("workload", 0.8)):
            fact = F.lower(F.regexp_extract(text, rf"(?m)^{label}: (.*)$", 1))
            for team, words in reversed(team_words.items()):
                listed = "|".join(rf"\Q{w}\E" for w in words)
                hit = F.rlike(fact, F.lit(rf"(?:^|[^a-z0-9])(?:{listed})(?:[^a-z0-9]|$)"))
                scored = F.when(hit, answer(team, confidence, f"{label} mentions {team}")).otherwise(scored)
        return scored

    return score


def score_workloads(workloads: DataFrame, now: dt.datetime, teams: Sequence[str],
                    scorer: Callable[[Column], Column]) -> DataFrame:
    """Suggestions table. ``scorer`` turns the prompt column into a JSON answer;
    a pandas UDF does as well as a built-in expression. The answer is parsed
    once; one that is not valid JSON gives nulls."""
    answered = workloads.withColumn("answer", F.from_json(scorer(prompt(teams)), ANSWER_SCHEMA))
    return answered.select(
        *WORKLOAD_KEY, "workload_name", "owner", "workspace_id",
        F.col("cost").alias("list_cost"),
        F.col("answer.cost_center").alias("suggested_cost_center"),
        F.col("answer.confidence").alias("confidence"),
        F.col("answer.rationale").alias("rationale"),
        F.lit(now).alias("annotated_at"),
    )


def with_suggestion(workloads: DataFrame, suggestions: DataFrame, cutoff: float) -> DataFrame:
    """Join workloads to their confident suggestion. A workload rollup is
    already partitioned by the join key."""
    wanted = suggestions.filter(confident(cutoff)).select(
        *WORKLOAD_KEY, "suggested_cost_center", "confidence")
    return workloads.join(wanted, list(WORKLOAD_KEY))


def _untagged(summary: DataFrame, key: str, as_of: dt.date, days: int,
              workspaces: Sequence[str] | None, text: Sequence[str]) -> DataFrame:
    return (
        workload_rollup(summary, [key], as_of, days, workspaces, text)
        .filter(F.col("is_untagged") & (F.col("cost") > 0))
    )


def suggestion_candidates(summary: DataFrame, suggestions: DataFrame, queue: DataFrame, key: str,
                          cutoff: float, as_of: dt.date, days: int,
                          workspaces: Sequence[str] | None = None) -> DataFrame:
    """Untagged workloads with cost and a confident suggestion that take a
    direct tag and are not handled yet."""
    open_ = _untagged(summary, key, as_of, days, workspaces, ("workspace_id", "workload_name"))
    return not_handled(with_suggestion(open_.filter(taggable()), suggestions, cutoff), queue, key)


def suggestion_impact(candidates: DataFrame) -> DataFrame:
    return candidates.agg(
        F.count(F.lit(1)).alias("workloads"),
        F.round(F.sum("cost"), 0).alias("cost"),
        F.count_distinct("suggested_cost_center").alias("distinct_values"),
    )


def suggestion_list(candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """The candidates, costliest first, and the value each would get; up to ``limit`` if given."""
    found = (
        candidates.select(
            *WORKLOAD_KEY, "workspace_id", "is_serverless", "workload_name",
            F.round("cost", 0).alias("cost"), "last_seen",
            F.col("suggested_cost_center").alias("new_tag_value"),
            F.round("confidence", 2).alias("confidence"),
        )
        .orderBy(F.desc("cost"), "product", "workload_id")
    )
    return found if limit is None else found.limit(limit)


def policy_governed_impact(summary: DataFrame, suggestions: DataFrame, key: str, cutoff: float,
                           as_of: dt.date, days: int,
                           workspaces: Sequence[str] | None = None) -> DataFrame:
    """Confident suggestions that no direct tag can carry out."""
    governed = _untagged(summary, key, as_of, days, workspaces, ()).filter(~taggable())
    return with_suggestion(governed, suggestions, cutoff).agg(
        F.count(F.lit(1)).alias("workloads"), F.round(F.sum("cost"), 0).alias("cost"))
