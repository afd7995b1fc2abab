"""Registered queries: what each returns, and how its columns are compared.

A column spec is ``name:kind``; both sides are cast the same way. Kinds: s text,
i whole number, m money (two decimals), d double, b boolean, t timestamp.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tagledger import capability, constants as C
from tagledger.operators import (
    apply as A, batches as B, guards as G, inventory as I, key_words as KW, learned as LS, queue as Q, reports as R,
    rollback as RB, rule_impact as RI, suggestions as SG, summary as S, validate as V,
)
from tagledger.operators.sequence import with_previous
from tagledger.operators.tag_plan import tag_plan
from tagledger.plans import flows
from tagledger.plans.ledger import Ledger
from tagledger.plans.session import work_folder
from tagledger.sources import tables
from tagledger.sources.bucketed import store_bucketed
from tagledger.streaming.status import current_queue, start_status_stream
from verification import fixtures as X
from verification.fixtures import AS_OF, NOW, RULES, TEAM_WORDS

KEY = "cost_center"
DAYS = 30
RUN = "run-1"
BATCH = "batch-0"

Query = Callable[[SparkSession, str], DataFrame]
SPECS: dict[str, str] = {}
BUILDERS: dict[str, Query] = {}


def register(spec: str, name: str | None = None):
    def keep(build: Query) -> Query:
        key = name or build.__name__
        SPECS[key], BUILDERS[key] = spec, build
        return build

    return keep


def columns(name: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in SPECS[name].split()]


def spark_query(name: str) -> Query:
    """The registered query with its columns cast for comparison."""
    casts: dict[str, Callable[[Column], Column]] = {
        "s": lambda c: c.cast("string"),
        "i": lambda c: c.cast("bigint"),
        "m": lambda c: c.cast("decimal(18,2)").cast("double"),
        "d": lambda c: c.cast("double"),
        "b": lambda c: c.cast("boolean"),
        "t": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"),
    }

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return BUILDERS[name](spark, sf).select(
            *[casts[kind](F.col(c)).alias(c) for c, kind in columns(name)])

    return run


def oracle_query(name: str, sql: str) -> str:
    """The SQL counterpart with the same casts."""
    casts = {
        "s": "CAST({c} AS VARCHAR)",
        "i": "CAST({c} AS BIGINT)",
        "m": "CAST(CAST({c} AS DECIMAL(18,2)) AS DOUBLE)",
        "d": "CAST({c} AS DOUBLE)",
        "b": "CAST({c} AS BOOLEAN)",
        "t": "strftime({c}, '%Y-%m-%d %H:%M:%S')",
    }
    outer = ", ".join(f"{casts[k].format(c=c)} AS {c}" for c, k in columns(name))
    return f"SELECT {outer} FROM (\n{sql}\n)"


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    return S.daily_summary(X.usage(spark, sf), X.list_prices(spark, sf), AS_OF)


def _joined_keys(df: DataFrame) -> DataFrame:
    return df.withColumn("tag_keys", F.array_join("tag_keys", ","))


def _stored(rows: DataFrame, table: str) -> DataFrame:
    path = work_folder(rows.sparkSession, table)
    tables.append_table(rows, table, path)
    return tables.read_table(rows.sparkSession, table, path)


# Sources and summary.

@register("usage_date:s workspace_id:s product:s workload_id:s workload_name:s owner:s "
          "is_serverless:i sku_name:s tag_keys:s dbus:m")
def usage_scan(spark, sf):
    return _joined_keys(S.workload_records(S.usage_window(X.usage(spark, sf), AS_OF)))


@register("sku_name:s rate:d")
def current_prices(spark, sf):
    return S.current_prices(X.list_prices(spark, sf))


@register("usage_date:s workspace_id:s product:s workload_id:s workload_name:s owner:s "
          "is_serverless:i tag_keys:s dbus:m list_cost:m unpriced_dbus:m")
def daily_summary(spark, sf):
    return _joined_keys(_summary(spark, sf))


@register("usage_date:s rows:i list_cost:m with_cost_center:i")
def summary_sink(spark, sf):
    path = work_folder(spark, "summary")
    tables.replace_table(_summary(spark, sf), "summary", path)
    stored = tables.read_table(spark, "summary", path)
    return S.summary_window(stored, AS_OF, 90).groupBy("usage_date").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("list_cost").alias("list_cost"),
        F.count_if(F.array_contains("tag_keys", KEY)).alias("with_cost_center"))


@register("product:s workload_id:s workspace_id:s workload_name:s owner:s is_serverless:i "
          "last_seen:s is_untagged:b cost:m")
def workload_rollup(spark, sf):
    return S.workload_rollup(_summary(spark, sf), [KEY], AS_OF, DAYS)


# Reports.

KPI = "total_cost:m untagged_cost:m pct_untagged:d untagged_workloads:i"


@register(KPI)
def kpi_summary(spark, sf):
    return R.kpi_summary(_summary(spark, sf), [KEY], AS_OF, DAYS)


@register(KPI)
def kpi_two_keys(spark, sf):
    return R.kpi_summary(_summary(spark, sf), [KEY, "team"], AS_OF, 90)


@register(KPI)
def kpi_no_keys(spark, sf):
    return R.kpi_summary(_summary(spark, sf), [], AS_OF, 60, ["1", "3", "5"])


def _kpi_of_words(spark, sf, keys, days, workspaces=None):
    summary = flows._stored(_summary(spark, sf), "summary")
    numbers = flows._stored(KW.key_numbers(summary), "key_numbers")
    daily = flows._stored(KW.daily_words(summary, numbers, numbers.count()), "key_words")
    return KW.kpi_of_rollup(flows._stored(KW.rollup_words(daily, AS_OF, days, workspaces), "key_rollup"), numbers, keys)


@register(KPI)
def kpi_two_keys_bits(spark, sf):
    """``kpi_two_keys`` from a stored rollup of key sets."""
    return _kpi_of_words(spark, sf, [KEY, "team"], 90)


@register(KPI)
def kpi_no_keys_bits(spark, sf):
    """``kpi_no_keys`` from a stored rollup of key sets."""
    return _kpi_of_words(spark, sf, [], 60, ["1", "3", "5"])


@register("product:s total_cost:m untagged_cost:m tagged_cost:m pct_untagged:d")
def by_product(spark, sf):
    return R.by_product(_summary(spark, sf), [KEY], AS_OF, DAYS)


@register("product:s risk:s bar:i")
def product_risk(spark, sf):
    return R.product_risk(by_product(spark, sf))


@register("workloads:i cost:m")
def tagged_live_adjustment(spark, sf):
    return R.tagged_live_adjustment(X.queue(spark, sf), KEY)


@register("total_cost:m untagged_cost:m untagged_workloads:i pct_untagged:d tagged_live_cost:m "
          "tagged_live_workloads:i pct_tagged_live:d")
def kpi_live(spark, sf):
    return R.kpi_live(_summary(spark, sf), X.queue(spark, sf), KEY, AS_OF, 90)


@register("total_cost:m untagged_cost:m untagged_workloads:i pct_untagged:d tagged_live_cost:m "
          "tagged_live_workloads:i pct_tagged_live:d")
def kpi_live_workspaces(spark, sf):
    return R.kpi_live(_summary(spark, sf), X.queue(spark, sf), KEY, AS_OF, 90, ["1", "3", "5"])


@register("product:s reason:s workloads:i cost:m")
def not_taggable_breakdown(spark, sf):
    return R.not_taggable_breakdown(_summary(spark, sf), KEY, AS_OF, DAYS)


@register("reason:s workloads:i cost:m")
def reason_rollup(spark, sf):
    return R.reason_rollup(not_taggable_breakdown(spark, sf))


@register("product:s is_serverless:i taggable:b reason:s workloads:i")
def taggable_by_reason(spark, sf):
    from tagledger.functions.predicates import not_taggable_reason, taggable

    return workload_rollup(spark, sf).groupBy(
        "product", "is_serverless", taggable().alias("taggable"), not_taggable_reason().alias("reason"),
    ).agg(F.count(F.lit(1)).alias("workloads"))


def _field_values(field: str) -> None:
    @register("value:s cost:m workloads:i", f"field_values_{field}")
    def values(spark, sf):
        return R.distinct_field_values(_summary(spark, sf), field, AS_OF, DAYS, limit=C.FIELD_VALUE_LIMIT)


for _field in ("owner", "workspace", "product", "name"):
    _field_values(_field)


@register("as_of:s rows:i")
def freshness(spark, sf):
    return S.summary_freshness(_summary(spark, sf))


@register("product:s workload_id:s workload_name:s owner:s cost:m last_seen:s")
def explore(spark, sf):
    return R.explore(workload_rollup(spark, sf), AS_OF, 10, 14, " ECO ", "latest")


# Rules.

@register("product:s workload_id:s first_rule:i")
def rule_matches(spark, sf):
    return RI.rule_candidates(_summary(spark, sf), [KEY], RULES, AS_OF, DAYS)


def _many_rules(spark, sf) -> list[dict]:
    """A rule for each part type and brand; there are as many as the tables have of those."""
    part, tags = X.table(spark, sf, "part"), {"cost_center": "x"}
    values = {c: sorted(r[0] for r in part.select(c).distinct().collect()) for c in ("p_type", "p_brand")}
    return [{"field": "owner", "op": "equals", "value": f"{v}@corp.example", "tags": tags} for v in values["p_type"]] + [
        {"field": "name", "op": "matches", "value": f"*{v}", "tags": tags} for v in values["p_brand"]]


@register("product:s workload_id:s first_rule:i")
def rule_matches_many(spark, sf):
    return RI.rule_candidates(_summary(spark, sf), [KEY], _many_rules(spark, sf), AS_OF, DAYS)


@register("total_untagged:i total_untagged_cost:m matched_count:i matched_cost:m")
def rule_impact(spark, sf):
    return RI.rule_impact(_summary(spark, sf), X.queue(spark, sf), [KEY], RULES, AS_OF, DAYS)


@register("product:s workload_id:s first_rule:i")
def rule_matches_indexed(spark, sf):
    return RI.rule_candidates(_summary(spark, sf), [KEY], X.rule_table(spark, sf), AS_OF, DAYS)


@register("total_untagged:i total_untagged_cost:m matched_count:i matched_cost:m")
def rule_impact_indexed(spark, sf):
    return RI.rule_impact(_summary(spark, sf), X.queue(spark, sf), [KEY], X.rule_table(spark, sf), AS_OF, DAYS)


@register("workload_id:s product:s workspace_id:s workload_name:s owner:s is_serverless:i cost:m "
          "last_seen:s new_tag_value:s")
def rule_sample_indexed(spark, sf):
    return RI.rule_sample(_summary(spark, sf), X.queue(spark, sf), [KEY], X.rule_table(spark, sf), AS_OF, DAYS,
                          limit=C.RULE_SAMPLE_LIMIT)


@register("workload_id:s product:s workspace_id:s workload_name:s owner:s is_serverless:i cost:m "
          "last_seen:s new_tag_value:s")
def rule_sample(spark, sf):
    return RI.rule_sample(_summary(spark, sf), X.queue(spark, sf), [KEY], RULES, AS_OF, DAYS,
                          limit=C.RULE_SAMPLE_LIMIT)


@register("product:s open_workloads:i")
def handled_guard(spark, sf):
    return G.not_handled(X.suggestions(spark, sf), X.queue(spark, sf), KEY).groupBy("product").agg(
        F.count(F.lit(1)).alias("open_workloads"))


# Suggestions.

@register("product:s workload_id:s prompt:s")
def scoring_prompts(spark, sf):
    return SG.scoring_workloads(_summary(spark, sf), AS_OF).withColumn("prompt", SG.prompt(list(TEAM_WORDS)))


@register("product:s workload_id:s workload_name:s owner:s workspace_id:s list_cost:m "
          "suggested_cost_center:s confidence:d rationale:s")
def score_workloads(spark, sf):
    return SG.score_workloads(SG.scoring_workloads(_summary(spark, sf), AS_OF), NOW, list(TEAM_WORDS),
                              SG.keyword_scorer(TEAM_WORDS))


@register("product:s workload_id:s workload_name:s owner:s workspace_id:s list_cost:m "
          "suggested_cost_center:s confidence:d rationale:s")
def score_learned(spark, sf):
    return LS.learned_suggestions(SG.scoring_workloads(_summary(spark, sf), AS_OF), X.tagged_workloads(spark, sf),
                                  list(TEAM_WORDS), NOW)


@register("method:s n:i n_right:i")
def learned_accuracy(spark, sf):
    return LS.accuracy(X.tagged_workloads(spark, sf), list(TEAM_WORDS), SG.keyword_scorer(TEAM_WORDS))


@register("suggested_cost_center:s rows:i list_cost:m")
def suggestions_sink(spark, sf):
    path = work_folder(spark, "suggestions")
    tables.replace_table(score_workloads(spark, sf), "suggestions", path)
    return tables.read_table(spark, "suggestions", path).groupBy("suggested_cost_center").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("list_cost").alias("list_cost"))


def _candidates(spark, sf):
    return SG.suggestion_candidates(
        _summary(spark, sf), X.suggestions(spark, sf), X.queue(spark, sf), KEY, 0.8, AS_OF, DAYS)


@register("workloads:i cost:m distinct_values:i")
def suggestion_impact(spark, sf):
    return SG.suggestion_impact(_candidates(spark, sf))


@register("product:s workload_id:s workspace_id:s is_serverless:i workload_name:s cost:m last_seen:s "
          "new_tag_value:s confidence:d")
def suggestion_list(spark, sf):
    return SG.suggestion_list(_candidates(spark, sf), C.SUGGESTION_LIMIT)


@register("workloads:i cost:m")
def policy_governed_impact(spark, sf):
    return SG.policy_governed_impact(
        _summary(spark, sf), X.suggestions(spark, sf), KEY, 0.8, AS_OF, DAYS)


# Queue.

NEW_ROWS = ("batch_id:s enqueued_at:t requested_by:s workspace_id:s product:s workload_id:s workload_name:s is_serverless:i tag_key:s "
            "tag_value:s list_cost:m status:s attempts:i")


def _enqueue_rules(spark, sf, skip_handled):
    return Q.enqueue_rules(_summary(spark, sf), X.queue(spark, sf), RULES, [KEY], AS_OF, DAYS,
                           "batch-new", "me", NOW, skip_handled=skip_handled)


@register(NEW_ROWS)
def enqueue_rules(spark, sf):
    return _enqueue_rules(spark, sf, False)


@register(NEW_ROWS)
def enqueue_rules_skip_handled(spark, sf):
    return _enqueue_rules(spark, sf, True)


@register(NEW_ROWS)
def enqueue_rules_indexed(spark, sf):
    return Q.enqueue_rules(_summary(spark, sf), X.queue(spark, sf), X.rule_table(spark, sf), [KEY], AS_OF, DAYS,
                           "batch-new", "me", NOW)


@register(NEW_ROWS)
def enqueue_single(spark, sf):
    return Q.enqueue_single(X.requests(spark, sf), "batch-new", "me", NOW)


@register(NEW_ROWS)
def enqueue_selected(spark, sf):
    return Q.enqueue_selected(X.requests(spark, sf), KEY, "batch-new", "me", NOW)


@register(NEW_ROWS)
def enqueue_suggestions(spark, sf):
    return Q.enqueue_suggestions(
        _candidates(spark, sf), X.queue(spark, sf), KEY, "batch-new", "me", NOW, exclude_batch=BATCH)


@register("workspace_id:s product:s workload_id:s tag_key:s tag_value:s origin:s")
def auto_tag(spark, sf):
    return Q.auto_tag(_summary(spark, sf), X.suggestions(spark, sf), X.queue(spark, sf), KEY, AS_OF,
                      DAYS, "batch-new", "me", NOW, rules=RULES)


@register("rule_rows:i suggestion_rows:i total_rows:i")
def auto_tag_counts(spark, sf):
    return Q.auto_tag_counts(auto_tag(spark, sf))


@register("product:s is_serverless:i supported:b id_kind:s resource_type:s call_hint:s warning:s requests:i", "tag_plan")
def plan_requests(spark, sf):
    return tag_plan(X.requests(spark, sf)).groupBy(
        "product", "is_serverless", "supported", "id_kind", "resource_type", "call_hint", "warning",
    ).agg(F.count(F.lit(1)).alias("requests"))


MATRIX = ("product:s label:s read_path:s write_path:s tag_method:s direct_tag:b create_time_only:b policy_driven:b "
          "ui_only:b rollback:b fallback:s reason:s serverless_differs:b")


@register(MATRIX + " dbus:m")
def capability_of_usage(spark, sf):
    """All usage, also of products that the matrix does not know."""
    cost = _summary(spark, sf).groupBy("product").agg(F.sum("dbus").alias("dbus"))
    return cost.join(F.broadcast(capability.capability_matrix(spark)), "product", "left")


@register(MATRIX + " parts:i")
def capability_matrix(spark, sf):
    """Every product with the number of parts that stand for it, pools included."""
    parts = X.table(spark, sf, "part").select(X.product(F.col("p_partkey")).alias("product"))
    parts = parts.withColumn("product", F.when(F.col("product") == "AGENT_BRICKS", "POOL").otherwise(F.col("product")))
    found = parts.groupBy("product").agg(F.count(F.lit(1)).alias("parts"))
    return capability.capability_matrix(spark).join(found, "product", "left").withColumn(
        "parts", F.coalesce("parts", F.lit(0)))


@register("batch_id:s workload_id:s product:s tag_key:s status:s last_error:s executed_at:t")
def claim(spark, sf):
    return Q.claim(X.queue(spark, sf), NOW, RUN)


CLAIMED = "batch_id:s workspace_id:s workload_id:s product:s tag_key:s status:s last_error:s executed_at:t"


@register(CLAIMED)
def claim_workspace(spark, sf):
    return Q.claim(X.queue(spark, sf), NOW, RUN, workspace_id="3")


@register(CLAIMED)
def claim_batch(spark, sf):
    return Q.claim(X.queue(spark, sf), NOW, RUN, batch_id=BATCH)


@register("batch_id:s workload_id:s product:s tag_key:s list_cost:m")
def drain_order(spark, sf):
    claimed = Q.claim(X.queue(spark, sf), NOW, RUN)
    return Q.drain_order(Q.claimed_rows(claimed, RUN))


# Apply.

def _attempts(spark, sf, dry_run=False):
    claimed = Q.claimed_rows(Q.claim(X.queue(spark, sf), NOW, RUN), RUN)
    return A.attempts(claimed, X.tag_state(spark, sf), dry_run)


def _tag_rows(state: DataFrame) -> DataFrame:
    return state.select("workspace_id", "product", "workload_id",
                        F.explode("tags").alias("tag_key", "tag_value"))


ATTEMPT = "batch_id:s workload_id:s product:s tag_key:s status:s error:s old_value:s new_value:s noop:b"


@register("batch_id:s workspace_id:s product:s workload_id:s tag_key:s tag_value:s previous:s")
def queue_history(spark, sf):
    """What each queued value follows on its resource and key."""
    return with_previous(X.queue(spark, sf), ["workspace_id", "product", "workload_id", "tag_key"], "tag_value", "enqueued_at", "batch_id")


@register(ATTEMPT)
def apply_attempts(spark, sf):
    return _attempts(spark, sf)


@register(ATTEMPT)
def apply_scanned(spark, sf):
    """On the state that the latest scan shows, with its failed listings and unreadable tags."""
    claimed = Q.claimed_rows(Q.claim(X.queue(spark, sf), NOW, RUN), RUN)
    return A.attempts(claimed, I.tag_state(X.inventory(spark, sf)), False)


@register("batch_id:s workload_id:s product:s tag_key:s status:s attempts:i executed_at:t")
def apply_queue_bucketed(spark, sf):
    """The status merge on a queue that is stored in buckets of the merge key."""
    name = f"queue_{uuid.uuid4().hex}"
    queue = store_bucketed(X.queue(spark, sf), "write_queue", name, work_folder(spark, name), 16)
    return A.apply_outcomes(queue, A.outcomes(_attempts(spark, sf), NOW))


@register("batch_id:s workload_id:s product:s tag_key:s status:s")
def apply_dry_run(spark, sf):
    return A.outcomes(_attempts(spark, sf, dry_run=True), NOW)


def _writer(spark, sf):
    return flows.run_writer(X.queue(spark, sf), X.tag_state(spark, sf), NOW, RUN, "me", dry_run=False)


@register("batch_id:s workload_id:s product:s tag_key:s status:s attempts:i executed_at:t")
def apply_queue(spark, sf):
    return _writer(spark, sf).queue


AUDIT_ROW = ("audit_id:s batch_id:s executed_at:t executed_by:s workspace_id:s product:s workload_id:s tag_key:s "
             "old_value:s new_value:s action:s status:s error:s")


@register(AUDIT_ROW)
def apply_audit(spark, sf):
    return _writer(spark, sf).audit


@register("workspace_id:s product:s workload_id:s tag_key:s tag_value:s")
def apply_state(spark, sf):
    return _tag_rows(_writer(spark, sf).tag_state)


@register("status:s rows:i")
def run_summary(spark, sf):
    return A.run_summary(_attempts(spark, sf))


# Rollback.

PLAN = ("batch_id:s workspace_id:s product:s workload_id:s tag_key:s old_value:s new_value:s")


@register(PLAN)
def rollback_plan(spark, sf):
    return RB.rollback_plan(X.audit(spark, sf), BATCH)


@register(PLAN)
def rollback_plan_earliest(spark, sf):
    return RB.rollback_plan(X.audit(spark, sf), BATCH, anchor="earliest")


@register(PLAN)
def rollback_plan_remaining(spark, sf):
    return RB.rollback_plan(X.audit(spark, sf), BATCH, skip_rolled_back=True)


def _rollback(spark, sf):
    return flows.run_rollback(X.queue(spark, sf), X.tag_state(spark, sf), X.audit(spark, sf), BATCH,
                              NOW, RUN, "me", dry_run=False)


@register(PLAN + " status:s error:s")
def rollback_trial(spark, sf):
    return RB.rollback_attempts(RB.rollback_plan(X.audit(spark, sf), BATCH), X.tag_state(spark, sf))


@register(AUDIT_ROW)
def rollback_audit(spark, sf):
    return _rollback(spark, sf).audit


@register("workspace_id:s product:s workload_id:s tag_key:s tag_value:s")
def rollback_state(spark, sf):
    return _tag_rows(_rollback(spark, sf).tag_state)


@register("batch_id:s workload_id:s product:s tag_key:s status:s executed_at:t")
def rollback_queue(spark, sf):
    return _rollback(spark, sf).queue


# Batches.

@register("batch_id:s enqueued_at:t requested_by:s rows:i workloads:i cost:m pending:i running:i "
          "succeeded:i failed:i unsupported:i dry_run:i rolled_back:i")
def recent_batches(spark, sf):
    return B.recent_batches(X.queue(spark, sf), C.BATCH_LIMIT)


@register("batch_id:s rows:i cost:m pct:i reverting:b in_flight:b residual:b not_tagged:i")
def batch_progress(spark, sf):
    return B.batch_progress(recent_batches(spark, sf))


@register("product:s status:s reason:s rows:i cost:m sample_reason:s")
def batch_failure_breakdown(spark, sf):
    return B.batch_failure_breakdown(X.queue(spark, sf), BATCH, C.FAILURE_REASON_LIMIT)


@register("n:i")
def count_queue_rows(spark, sf):
    return B.count_queue_rows(X.queue(spark, sf), BATCH)


# Inventory.

INVENTORY_ROW = ("scan_id:s scanned_at:t workspace_id:s product:s workload_id:s workload_name:s owner:s tags:s "
                 "tag_count:i direct_tag:b fallback:s tag_read_ok:b read_error:s")


def _shown_tags(rows: DataFrame) -> DataFrame:
    shown = F.transform(F.array_sort(F.map_entries("tags")),
                        lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.withColumn("tags", F.array_join(shown, ","))


@register(INVENTORY_ROW)
def inventory_rows(spark, sf):
    return _shown_tags(X.inventory(spark, sf))


INVENTORY_SUMMARY = "product:s resources:i untagged:i tagged:i read_failed:i fallback:s"


@register(INVENTORY_SUMMARY)
def inventory_summary(spark, sf):
    return I.inventory_summary(X.inventory(spark, sf))


@register(INVENTORY_SUMMARY)
def inventory_summary_by_id(spark, sf):
    return I.inventory_summary(X.inventory(spark, sf), by="id")


@register("scan_id:s scanned_at:t resources:i")
def inventory_meta(spark, sf):
    return I.inventory_meta(X.inventory(spark, sf))


@register("scan_id:s product:s resources:i untagged:i tagged:i")
def inventory_report(spark, sf):
    return I.inventory_report(X.inventory(spark, sf))


@register("product:s resources:i tagged:i coverage_pct:i")
def inventory_coverage(spark, sf):
    return I.coverage(inventory_summary(spark, sf))


@register("resources:i untagged:i")
def inventory_totals(spark, sf):
    return I.coverage_totals(inventory_summary(spark, sf))


@register("product:s resources:i untagged:i")
def sweep_counts(spark, sf):
    return I.sweep_counts(I.inventory_sweep(
        X.listings(spark, sf), *X.NEW_SCAN, errors=X.listing_errors(spark, sf)))


# Validation.

@register("doc_id:i tag_key:s rule:s")
def tag_violations(spark, sf):
    return V.tag_violations(X.tag_payloads(spark, sf), ["doc_id"])


# Sinks and the stream.

@register(NEW_ROWS + " last_error:s executed_at:t")
def queue_append(spark, sf):
    path = work_folder(spark, "write_queue")
    tables.append_table(X.queue(spark, sf), "write_queue", path)
    tables.append_table(Q.enqueue_rules(
        _summary(spark, sf), X.queue(spark, sf), RULES, [KEY], AS_OF, DAYS, "batch-new", "me", NOW), "write_queue", path)
    return tables.read_table(spark, "write_queue", path)


@register(AUDIT_ROW)
def audit_append(spark, sf):
    path = work_folder(spark, "audit")
    tables.append_table(X.audit(spark, sf), "audit", path)
    tables.append_table(_rollback(spark, sf).audit, "audit", path)
    return tables.read_table(spark, "audit", path)


@register(INVENTORY_ROW)
def inventory_append(spark, sf):
    return _shown_tags(_stored(X.inventory(spark, sf), "inventory"))


@register("batch_id:s workload_id:s product:s tag_key:s status:s attempts:i")
def status_stream(spark, sf):
    """Two rounds of outcome files: first everything reported RUNNING, then the
    final status. The stream stops in between and resumes from its checkpoint."""
    base = work_folder(spark, "stream")
    final = A.outcomes(_attempts(spark, sf), NOW)
    first = final.withColumns({"status": F.lit("RUNNING"), "executed_at": F.lit(NOW - dt.timedelta(minutes=1))})
    for outcomes in (first, final):
        tables.append_table(outcomes, "outcomes", f"{base}/arriving")
        start_status_stream(spark, f"{base}/arriving", f"{base}/rounds", f"{base}/checkpoint",
                            every=None).awaitTermination()
    return current_queue(X.queue(spark, sf), f"{base}/rounds")


@register("kind:s batch_id:s workspace_id:s product:s workload_id:s tag_key:s status:s old_value:s new_value:s")
def ledger_run(spark, sf):
    """Two runs that overlap, an enqueue between them and a rollback, on stored tables."""
    ledger = Ledger(spark, work_folder(spark, "ledger"))
    ledger.create()
    ledger.store_state(X.tag_state(spark, sf))
    ledger.append("write_queue", X.queue(spark, sf))
    ledger.claim(NOW, "run-1", batch_id="batch-0")
    ledger.claim(NOW, "run-2", batch_id="batch-1")
    ledger.apply_claimed(NOW, "run-2", "me", dry_run=False)
    late = ledger.read("write_queue").filter("batch_id = 'batch-0' AND status = 'ROLLED_BACK'")
    ledger.enqueue(late.withColumns({"batch_id": F.lit("late"), "status": F.lit("PENDING")}))
    ledger.apply_claimed(NOW, "run-1", "me", dry_run=False)
    ledger.compact()
    ledger.rollback("batch-1", NOW + dt.timedelta(minutes=1), "run-3", "me", dry_run=False)
    none = F.lit(None).cast("string")
    shown = ("batch_id", "workspace_id", "product", "workload_id", "tag_key", "status", "old_value", "new_value")
    queue = ledger.read("write_queue").withColumns({"old_value": none, "new_value": none}).select(F.lit("queue").alias("kind"), *shown)
    state = _tag_rows(ledger.read("tag_state")).withColumns(
        {"batch_id": none, "status": none, "old_value": none, "new_value": F.col("tag_value")}).select(F.lit("state").alias("kind"), *shown)
    audit = ledger.read("audit").select(F.col("action").alias("kind"), *shown)
    return queue.unionByName(state).unionByName(audit)
