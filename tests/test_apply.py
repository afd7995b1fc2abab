import datetime as dt
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from conftest import NOW, rows
from tagledger import constants as C
from tagledger.functions import tagmaps as M
from tagledger.operators import apply as A, rollback as RB
from tagledger.operators.sequence import with_previous
from tagledger.plans import flows

KEY = "cost_center"


def intent(wid="1", value="new", product="JOBS", key=KEY, batch="b1", minutes=0, serverless=0, status=C.PENDING):
    return dict(batch_id=batch, enqueued_at=NOW + dt.timedelta(minutes=minutes), workspace_id="1",
                product=product, workload_id=wid, is_serverless=serverless, tag_key=key, tag_value=value,
                status=status, attempts=None)


def state(wid="1", product="JOBS", **tags):
    return dict(workspace_id="1", product=product, workload_id=wid, tags=tags)


def tags_of(frame):
    return {(r["product"], r["workload_id"]): r["tags"] for r in frame.collect()}


@pytest.mark.parametrize("tags,value,after", [
    ({"a": "1", "k": "old"}, "new", {"a": "1", "k": "new"}),
    ({}, "new", {"k": "new"}),
    (None, "new", {"k": "new"}),
    ({"a": "1", "k": "old"}, None, {"a": "1"}),
    ({"a": "1"}, None, {"a": "1"}),
])
def test_merge_one_key(spark, tags, value, after):
    df = spark.createDataFrame([(tags, "k", value)], "tags map<string,string>, k string, v string")
    assert df.select(M.merge_one(F.col("tags"), F.col("k"), F.col("v"))).first()[0] == after


def test_every_verdict(make):
    queue = make(
        "write_queue", intent("1"), intent("x2"), intent("3"), intent("4", product="SQL"),
        intent("5", product="SQL", serverless=1), intent("6", product="APPS"), intent("7", product="DLT"),
        intent("8", product="NEW"), intent("9", product="VECTOR_SEARCH"), intent(" +12 "),
        intent("123456789012345678901234567890"))
    there = make("tag_state", state("1"), state("x2"), state("4", "SQL", cost_center="new"),
                 state("5", "SQL"), state("6", "APPS"), state("7", "DLT"), state("8", "NEW"),
                 state("9", "VECTOR_SEARCH", cost_center="new"), state(" +12 "),
                 state("123456789012345678901234567890"))
    found = {r["workload_id"]: r for r in A.attempts(queue, there, False).collect()}
    assert {k: r["status"] for k, r in found.items()} == {
        "1": C.SUCCEEDED, "x2": C.FAILED, "3": C.FAILED, "4": C.SUCCEEDED, "5": C.UNSUPPORTED,
        "6": C.UNSUPPORTED, "7": C.UNSUPPORTED, "8": C.UNSUPPORTED, "9": C.SUCCEEDED, " +12 ": C.SUCCEEDED,
        "123456789012345678901234567890": C.SUCCEEDED}
    assert found["3"]["error"].startswith("ResourceDoesNotExist:")
    assert found["x2"]["error"].startswith("InvalidId:")
    assert all(r["error"] for r in found.values() if r["status"] != C.SUCCEEDED)
    assert found["4"]["noop"] and not found["1"]["noop"]
    assert found["9"]["old_value"] is None and not found["9"]["noop"]
    assert found["x2"]["new_value"] is None


def test_rows_for_one_key_follow_each_other(make):
    queue = make("write_queue", intent(value="b", batch="b2", minutes=1), intent(value="a", batch="b1"),
                 intent(value="b", batch="b3", minutes=1), intent(value="c", batch="b4", minutes=5),
                 intent(value="t", key="team", batch="b1"), intent(value="u", key="team", batch="b2", minutes=9))
    there = make("tag_state", state(cost_center="a", env="prod"))
    tried = A.attempts(queue, there, False)
    assert rows(tried, "tag_key", "batch_id", "old_value", "new_value", "noop") == [
        (KEY, "b1", "a", "a", True), (KEY, "b2", "a", "b", False), (KEY, "b3", "b", "b", True),
        (KEY, "b4", "b", "c", False), ("team", "b1", None, "t", False), ("team", "b2", "t", "u", False)]
    assert tags_of(A.applied_state(there, tried)) == {
        ("JOBS", "1"): {"env": "prod", "cost_center": "c", "team": "u"}}


def test_trial_run_changes_nothing(make):
    queue = make("write_queue", intent(value="x"), intent(value="y", batch="b2"), intent("2", "same"), intent("z"))
    there = make("tag_state", state("1", cost_center="old"), state("2", cost_center="same"))
    tried = A.attempts(queue, there)
    assert rows(A.outcomes(tried, NOW), "workload_id", "batch_id", "status") == [
        ("1", "b1", C.SKIPPED_DRYRUN), ("1", "b2", C.SKIPPED_DRYRUN), ("2", "b1", C.SUCCEEDED), ("z", "b1", C.FAILED)]
    assert rows(tried.filter("workload_id = '1'"), "old_value") == [("old",), ("old",)]
    assert tags_of(A.applied_state(there, tried)) == tags_of(there)
    assert rows(A.audit_rows(tried, NOW, "me", "run"), "workload_id", "status") == [("z", C.FAILED)]


def test_audit_is_of_changes_and_failures_only_and_repeatable(make):
    queue = make("write_queue", intent("1"), intent("2"), intent("3"), intent("4", product="APPS"))
    there = make("tag_state", state("1", cost_center="old"), state("2", cost_center="new"))
    tried = A.attempts(queue, there, False)
    audit = A.audit_rows(tried, NOW, "me", "run")
    assert rows(audit, "workload_id", "old_value", "new_value", "action", "status") == [
        ("1", "old", "new", C.SET, C.SUCCEEDED), ("3", None, None, C.SET, C.FAILED)]
    assert rows(audit, "audit_id") == rows(A.audit_rows(tried, NOW, "you", "run"), "audit_id")
    assert audit.select("audit_id").distinct().count() == 2
    assert rows(A.run_summary(tried)) == [(C.FAILED, 1), (C.SUCCEEDED, 2), (C.UNSUPPORTED, 1)]
    assert rows(A.run_summary(tried, "product")) == [("APPS", 1), ("JOBS", 3)]


def test_queue_keeps_its_rows_and_counts_attempts(make):
    queue = make("write_queue", intent("1"), intent("2"), dict(intent("3"), attempts=4, last_error="e"))
    found = make("outcomes", *[
        dict(batch_id="b1", workload_id=w, product="JOBS", tag_key=KEY, status=s, last_error=e,
             executed_at=NOW + dt.timedelta(seconds=at))
        for w, s, e, at in (("1", C.FAILED, "x", 0), ("1", C.SUCCEEDED, None, 5), ("3", C.FAILED, "y", 1))])
    after = A.apply_outcomes(queue, found)
    assert after.columns == queue.columns
    assert rows(after, "workload_id", "status", "attempts", "last_error") == [
        ("1", C.SUCCEEDED, 1, None), ("2", C.PENDING, None, None), ("3", C.FAILED, 5, "y")]
    some = A.apply_outcomes(queue, found, among=F.col("last_error") == "e")
    assert some.columns == queue.columns
    assert rows(some, "workload_id", "status", "attempts") == [
        ("1", C.PENDING, None), ("2", C.PENDING, None), ("3", C.FAILED, 5)]


def test_second_run_is_all_noops_and_rollback_restores(make):
    queue = make("write_queue", intent("1"), intent("2"), intent("2", "t", key="team"), intent("3"))
    there = make("tag_state", state("1", cost_center="old", env="e"), state("2"), state("9", env="e"))
    first = flows.run_writer(queue, there, NOW, "run-1", "me", dry_run=False)
    assert first.queue.count() == queue.count()
    assert tags_of(first.tag_state)["JOBS", "2"] == {"cost_center": "new", "team": "t"}
    second = flows.run_writer(queue, first.tag_state, NOW, "run-2", "me", dry_run=False)
    assert second.tried.filter("status = 'SUCCEEDED' AND NOT noop").count() == 0
    assert second.audit.filter("status = 'SUCCEEDED'").count() == 0
    assert tags_of(second.tag_state) == tags_of(first.tag_state)

    later = NOW + dt.timedelta(hours=1)
    trial = flows.run_rollback(first.queue, first.tag_state, first.audit, "b1", later, "run-3", "me")
    assert rows(trial.tried, "status") == [(C.DRY_RUN,)] * 3 and trial.audit.count() == 0
    assert tags_of(trial.tag_state) == tags_of(first.tag_state)
    undone = flows.run_rollback(first.queue, first.tag_state, first.audit, "b1", later, "run-3", "me", dry_run=False)
    assert tags_of(undone.tag_state) == tags_of(there)
    assert undone.queue.columns == queue.columns
    assert rows(undone.queue, "workload_id", "tag_key", "status") == [
        ("1", KEY, C.ROLLED_BACK), ("2", KEY, C.ROLLED_BACK), ("2", "team", C.ROLLED_BACK), ("3", KEY, C.FAILED)]
    assert rows(undone.audit, "workload_id", "tag_key", "old_value", "new_value", "action") == [
        ("1", KEY, "new", "old", C.ROLLBACK), ("2", KEY, "new", None, C.ROLLBACK),
        ("2", "team", "t", None, C.ROLLBACK)]
    both = first.audit.unionByName(undone.audit)
    assert RB.rollback_plan(both, "b1", skip_rolled_back=True).count() == 0
    assert RB.rollback_plan(both, "b1").count() == 3


def test_rollback_anchor_and_missing_resource(make):
    def record(at, old, new, product="JOBS", **more):
        return dict(dict(audit_id=f"a{at}", batch_id="b", executed_at=NOW + dt.timedelta(minutes=at),
                         workspace_id="1", product=product, workload_id="1", tag_key=KEY, old_value=old,
                         new_value=new, action=C.SET, status=C.SUCCEEDED), **more)

    audit = make("audit", record(0, "zero", "one"), record(5, "one", "two"), record(9, "x", "y", status=C.FAILED),
                 record(9, "x", "y", batch_id="other"), record(3, None, "s", "SQL"))
    assert rows(RB.rollback_plan(audit, "b"), "product", "old_value", "new_value") == [
        ("JOBS", "one", "two"), ("SQL", None, "s")]
    assert rows(RB.rollback_plan(audit, "b", anchor="earliest"), "product", "old_value", "new_value") == [
        ("JOBS", "zero", "two"), ("SQL", None, "s")]
    tried = RB.rollback_attempts(RB.rollback_plan(audit, "b"), make("tag_state", state("1", "SQL", cost_center="s")), False)
    assert rows(tried, "product", "status") == [("JOBS", C.FAILED), ("SQL", C.SUCCEEDED)]
    queue = make("write_queue", intent("1", batch="b", status=C.SUCCEEDED),
                 intent("1", batch="b", product="SQL", status=C.SUCCEEDED),
                 intent("1", batch="b", product="SQL", key="team", status=C.SUCCEEDED),
                 intent("1", batch="c", product="SQL", status=C.SUCCEEDED))
    after = RB.mark_rolled_back(queue, "b", tried, NOW)
    assert rows(after.filter(F.col("status") == C.ROLLED_BACK), "batch_id", "product", "tag_key") == [("b", "SQL", KEY)]
    assert after.count() == 4


def test_history_of_a_hot_key_equals_walking_it_in_order(spark):
    rng = random.Random(7)
    made = [(("hot" if i % 3 else f"k{i % 50}"), NOW + dt.timedelta(seconds=rng.randrange(4000)), f"b{i:05}",
             str(rng.randrange(3))) for i in range(6000)]
    df = spark.createDataFrame(made, "k string, at timestamp, tie string, v string")
    found = {r["tie"]: r["p"] for r in with_previous(df, ["k"], "v", "at", "tie", "p").collect()}
    last, expected = {}, {}
    for k, _, tie, v in sorted(made, key=lambda r: (r[1], r[2])):
        expected[tie] = last.get(k)
        last[k] = v
    assert found == expected


def test_amounts_do_not_change(make):
    queue = make("write_queue", dict(intent("1"), list_cost=D("12.345678")))
    run = flows.run_writer(queue, make("tag_state", state("1")), NOW, "run", "me", dry_run=False)
    assert rows(run.queue, "list_cost", "status", "attempts") == [(D("12.345678"), C.SUCCEEDED, 1)]
