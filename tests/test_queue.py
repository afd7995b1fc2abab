import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF, NOW, rows
from tagledger import constants as C
from tagledger.operators import guards as G, queue as Q, rule_impact as RI, suggestions as SG
from tagledger.schemas import WRITE_QUEUE

KEY = "cost_center"
RULES = [
    {"field": "owner", "op": "contains", "value": "eng", "tags": {KEY: "data-eng", "team": "de"}},
    {"field": "product", "op": "equals", "value": "SQL", "tags": {"team": "bi"}},
]


@pytest.fixture(scope="module")
def summary(make):
    def row(product, wid, cost, owner=None, keys=(), serverless=0):
        return dict(usage_date=AS_OF, workspace_id="1", product=product, workload_id=wid, owner=owner,
                    workload_name=f"n{wid}", is_serverless=serverless, tag_keys=list(keys), list_cost=D(cost))

    return make("summary", row("JOBS", "1", "10", "eng"), row("JOBS", "2", "20"),
                row("SQL", "1", "30"), row("SQL", "3", "40", "eng", serverless=1),
                row("APPS", "4", "50", "eng"), row("JOBS", "5", "60", "eng", [KEY]), row("JOBS", "6", "0", "eng"))


@pytest.fixture(scope="module")
def suggestions(make):
    def row(product, wid, value, confidence):
        return dict(product=product, workload_id=wid, suggested_cost_center=value, confidence=confidence)

    return make("suggestions", row("JOBS", "1", "ai", 0.9), row("JOBS", "2", "ai", 0.8),
                row("SQL", "1", "ai", 0.8), row("SQL", "3", "ai", 0.9), row("JOBS", "9", "ai", 0.9))


def queued(make, *cells):
    return make("write_queue", *[
        dict(batch_id=b, product=p, workload_id=w, tag_key=k, status=s) for b, p, w, k, s in cells])


@pytest.fixture(scope="module")
def empty(make):
    return make("write_queue")


@pytest.mark.parametrize("status", C.QUEUE_STATUSES)
def test_guard_by_status(make, status):
    workloads = make("suggestions", {"product": "JOBS", "workload_id": "1"}, {"product": "SQL", "workload_id": "1"})
    left = G.not_handled(workloads, queued(make, ("b", "JOBS", "1", KEY, status)), KEY)
    blocked = status in (C.SUCCEEDED, C.PENDING, C.RUNNING, C.FAILED, C.UNSUPPORTED)
    assert left.count() == (1 if blocked else 2)
    assert G.not_handled(workloads, queued(make, ("b", "JOBS", "1", "team", status)), KEY).count() == 2


def test_rules_write_all_their_tags(summary, empty):
    found = Q.enqueue_rules(summary, empty, RULES, [KEY], AS_OF, 30, "b", "me", NOW)
    assert found.columns == WRITE_QUEUE.fieldNames()
    assert rows(found, "product", "workload_id", "tag_key", "tag_value", "list_cost", "status", "attempts") == [
        ("JOBS", "1", KEY, "data-eng", D("10.000000"), C.PENDING, 0),
        ("JOBS", "1", "team", "de", D("10.000000"), C.PENDING, 0),
        ("SQL", "1", "team", "bi", D("30.000000"), C.PENDING, 0)]


def test_preview_agrees_with_enqueue_when_handled_rows_are_skipped(summary, make):
    handled = queued(make, ("old", "JOBS", "1", KEY, C.FAILED), ("old", "SQL", "1", "team", C.SUCCEEDED))
    impact = RI.rule_impact(summary, handled, [KEY], RULES, AS_OF, 30)
    assert rows(impact) == [(2, D("50"), 1, D("30"))]
    skip = Q.enqueue_rules(summary, handled, RULES, [KEY], AS_OF, 30, "b", "me", NOW, skip_handled=True)
    assert skip.select("product", "workload_id").distinct().count() == 1
    keep = Q.enqueue_rules(summary, handled, RULES, [KEY], AS_OF, 30, "b", "me", NOW)
    assert keep.select("product", "workload_id").distinct().count() == 2
    sample = RI.rule_sample(summary, handled, [KEY], RULES, AS_OF, 30)
    assert rows(sample, "workload_id", "product", "new_tag_value", "cost") == [("1", "SQL", "", D("30"))]


def test_no_complete_rule_means_no_result(summary, empty):
    nothing = [{"field": "owner", "op": "equals", "value": "", "tags": {KEY: "x"}}]
    assert RI.rule_impact(summary, empty, [KEY], nothing, AS_OF, 30) is None
    assert RI.rule_sample(summary, empty, [KEY], [], AS_OF, 30) is None
    assert Q.enqueue_rules(summary, empty, nothing, [KEY], AS_OF, 30, "b", "me", NOW) is None


def test_suggestions(summary, suggestions, make, empty):
    found = SG.suggestion_candidates(summary, suggestions, empty, KEY, 0.8, AS_OF, 30)
    assert rows(found, "product", "workload_id") == [("JOBS", "1"), ("JOBS", "2"), ("SQL", "1")]
    assert rows(SG.suggestion_impact(found)) == [(3, D("60"), 1)]
    assert [r["workload_id"] for r in SG.suggestion_list(found, 2).collect()] == ["1", "2"]
    assert rows(SG.policy_governed_impact(summary, suggestions, KEY, 0.8, AS_OF, 30)) == [(1, D("40"))]
    busy = queued(make, ("b1", "JOBS", "2", KEY, C.ROLLED_BACK))
    assert rows(Q.enqueue_suggestions(found, busy, KEY, "b2", "me", NOW), "workload_id") == [("1",), ("1",), ("2",)]
    assert rows(Q.enqueue_suggestions(found, busy, KEY, "b2", "me", NOW, exclude_batch="b1"),
                "product", "workload_id") == [("JOBS", "1"), ("SQL", "1")]


def test_auto_tag_rules_first(summary, suggestions, empty):
    def run(**options):
        return Q.auto_tag(summary, suggestions, empty, KEY, AS_OF, 30, "b", "me", NOW, **options)

    columns = ("product", "workload_id", "tag_key", "tag_value", "origin")
    both = run(rules=RULES)
    assert rows(both, *columns) == [
        ("JOBS", "1", KEY, "data-eng", "rule"), ("JOBS", "1", "team", "de", "rule"),
        ("JOBS", "2", KEY, "ai", "suggestion"), ("SQL", "1", KEY, "ai", "suggestion"),
        ("SQL", "1", "team", "bi", "rule")]
    assert rows(Q.auto_tag_counts(both)) == [(3, 2, 5)]
    assert rows(Q.auto_tag_counts(run(rules=RULES, use_suggestions=False))) == [(3, 0, 3)]
    assert rows(Q.auto_tag_counts(run())) == [(0, 3, 3)]
    assert rows(Q.auto_tag_counts(run(use_suggestions=False))) == [(0, 0, 0)]


def test_single_and_selected(spark, make):
    requests = spark.createDataFrame([
        ("1", "JOBS", "7", None, True, {"a": "1", "b": "2"}, None), ("1", "APPS", "8", "x", False, {"a": "1"}, None),
    ], "workspace_id string, product string, workload_id string, workload_name string, "
       "is_serverless boolean, tags map<string,string>, list_cost decimal(38,6)")
    assert rows(Q.enqueue_single(requests, "b", "me", NOW),
                "workload_id", "workload_name", "is_serverless", "tag_key", "tag_value", "list_cost") == [
        ("7", "7", 1, "a", "1", None), ("7", "7", 1, "b", "2", None)]
    nasty = "Zoë's 5%_off\\--;"
    selection = spark.createDataFrame([
        (None, "JOBS", "7", "", 1, nasty, 1.5), ("1", "JOBS", "", "n", 0, "v", 1.0),
        ("1", "JOBS", None, "n", 0, "v", 1.0), ("1", "JOBS", "8", "n", 0, "", 1.0), ("1", "JOBS", "9", "n", None, "v", None),
    ], "workspace_id string, product string, workload_id string, workload_name string, "
       "is_serverless int, tag_value string, cost double")
    assert rows(Q.enqueue_selected(selection, KEY, "b", "me", NOW),
                "workspace_id", "workload_id", "workload_name", "is_serverless", "tag_value", "list_cost") == [
        ("", "7", "7", 1, nasty, D("1.500000")), ("1", "9", "n", 0, "v", None)]


def test_claim(make):
    def row(wid, status, minutes=None, **more):
        at = None if minutes is None else NOW - dt.timedelta(minutes=minutes)
        return dict(dict(batch_id="b", workspace_id="1", workload_id=wid, status=status, executed_at=at,
                         product="JOBS", tag_key=KEY, list_cost=None), **more)

    queue = make("write_queue", row("1", C.PENDING, list_cost=D(1)), row("2", C.RUNNING, 31, list_cost=D(5)),
                 row("3", C.RUNNING, 30), row("4", C.FAILED, 99), row("5", C.PENDING, batch_id="c"),
                 row("6", C.PENDING, workspace_id="2"), row("7", C.RUNNING))

    def taken(**scope):
        after = Q.claim(queue, NOW, "run", **scope)
        assert after.count() == queue.count()
        mine = [r["workload_id"] for r in Q.drain_order(Q.claimed_rows(after, "run")).collect()]
        assert sorted(mine) == sorted(r[0] for r in queue.filter(Q.claimable(NOW, **scope)).select("workload_id").collect())
        return mine

    assert taken() == ["2", "1", "6", "5"]
    assert taken(batch_id="b", workspace_id="1") == ["2", "1"]
    after = Q.claim(queue, NOW, "run")
    again = Q.claim(after, NOW, "other")
    assert Q.claimed_rows(again, "other").count() == 0


def test_scoring(spark, summary):
    workloads = SG.scoring_workloads(summary, AS_OF)
    assert rows(workloads, "product", "workload_id") == [
        ("APPS", "4"), ("JOBS", "1"), ("JOBS", "2"), ("SQL", "1"), ("SQL", "3")]
    named = spark.createDataFrame(
        [("JOBS", "1", "Nightly ETL", None, "1", D(1)), ("JOBS", "2", None, "crm-bot", "1", D(1)),
         ("JOBS", "3", None, None, "1", D(1))],
        "product string, workload_id string, workload_name string, owner string, workspace_id string, "
        "cost decimal(38,10)")
    words = {"loaders": ("etl", "a.b"), "sellers": ("crm", "tl")}
    assert rows(SG.score_workloads(named, NOW, list(words), SG.keyword_scorer(words)),
                "workload_id", "suggested_cost_center", "confidence") == [
        ("1", "loaders", 0.8), ("2", "sellers", 0.6), ("3", "unknown", 0.2)]
    prompts = [r[0] for r in named.select(SG.prompt(list(words))).collect()]
    assert "workload: (none)\nowner: (none)\nproduct: JOBS" in prompts[2] and "loaders, sellers" in prompts[0]
    parts = named.withColumn("workload_name", F.lit("petlands axb"))
    assert rows(SG.score_workloads(parts.limit(1), NOW, list(words), SG.keyword_scorer(words)),
                "suggested_cost_center") == [("unknown",)], "parts of words do not count"


def test_own_scorer_and_bad_answers(spark, summary):
    @F.pandas_udf("string")
    def scorer(prompts):
        return prompts.map(lambda p: '{"cost_center": "x", "confidence": 0.9}' if "JOBS" in p else "sorry, no")

    found = SG.score_workloads(SG.scoring_workloads(summary, AS_OF), NOW, ["x"], scorer)
    assert rows(found.distinct(), "product", "suggested_cost_center", "confidence") == [
        ("APPS", None, None), ("JOBS", "x", 0.9), ("JOBS", "x", 0.9), ("SQL", None, None), ("SQL", None, None)]
