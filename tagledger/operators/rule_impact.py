"""What a rule set would tag."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tagledger.functions.predicates import taggable
from tagledger.functions.rules import complete_rules, value_for_key, with_first_rule
from tagledger.operators import rule_index
from tagledger.operators.guards import not_handled
from tagledger.operators.summary import workload_rollup


def rule_candidates(summary: DataFrame, keys: Sequence[str], rules: Sequence | DataFrame, as_of: dt.date,
                    days: int, workspaces: Sequence[str] | None = None) -> DataFrame:
    """Untagged workloads with cost that take a direct tag, each with the
    position of its winning rule (-1 for none). ``rules`` is a list, which becomes part of
    the plan, or a rule table of any size (``rule_index``). The product half of
    ``taggable`` filters a grouping column, so it moves down to the scan. The
    summary holds no null ids; saying so here as well keeps plans that join
    these rows equal to plans that do not, so their shuffle can be reused."""
    workloads = (
        workload_rollup(summary, keys, as_of, days, workspaces)
        .filter(F.col("is_untagged") & (F.col("cost") > 0) & taggable())
        .filter(F.col("product").isNotNull() & F.col("workload_id").isNotNull())
    )
    if isinstance(rules, DataFrame):
        return rule_index.with_first_rule(workloads, rules)
    return with_first_rule(workloads, complete_rules(rules))


def rule_impact(summary: DataFrame, queue: DataFrame, keys: Sequence[str], rules: Sequence | DataFrame,
                as_of: dt.date, days: int,
                workspaces: Sequence[str] | None = None) -> DataFrame | None:
    """Untagged and matched workloads with their cost, in one conditional
    aggregate. None when no rule is complete."""
    if not isinstance(rules, DataFrame) and not complete_rules(rules):
        return None
    candidates = rule_candidates(summary, keys, rules, as_of, days, workspaces)
    matched = F.col("first_rule") >= 0
    return not_handled(candidates, queue, keys[0]).agg(
        F.count(F.lit(1)).alias("total_untagged"),
        F.round(F.sum("cost"), 0).alias("total_untagged_cost"),
        F.count_if(matched).alias("matched_count"),
        F.round(F.sum(F.when(matched, F.col("cost"))), 0).alias("matched_cost"),
    )


def rule_sample(summary: DataFrame, queue: DataFrame, keys: Sequence[str], rules: Sequence | DataFrame,
                as_of: dt.date, days: int, workspaces: Sequence[str] | None = None,
                limit: int | None = None) -> DataFrame | None:
    """The workloads the rules would tag, costliest first, and the value each
    gets for the first key; up to ``limit`` if given. None when no rule is complete."""
    table = isinstance(rules, DataFrame)
    wanted = None if table else complete_rules(rules)
    if not table and not wanted:
        return None
    matched = rule_candidates(summary, keys, rules, as_of, days, workspaces).filter("first_rule >= 0")
    open_ = not_handled(matched, queue, keys[0])
    if table:
        open_ = open_.join(rule_index.values_for_key(rules, keys[0]), "first_rule")
    found = (
        open_.select(
            "workload_id", "product", "workspace_id", "workload_name", "owner", "is_serverless",
            F.round("cost", 0).alias("cost"), "last_seen",
            F.col("new_tag_value") if table else value_for_key(wanted, keys[0]).alias("new_tag_value"),
        )
        .orderBy(F.desc("cost"), "product", "workload_id")
    )
    return found if limit is None else found.limit(limit)
