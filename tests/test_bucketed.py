"""Merges on tables stored in buckets of the merge key: no shuffle of the table."""

import uuid

import pytest

from conftest import NOW, SF, rows
from tagledger.operators import apply as A, rollback as RB
from tagledger.plans import flows
from tagledger.plans.session import work_folder
from tagledger.sources.bucketed import store_bucketed
from verification import fixtures as X


@pytest.fixture(scope="module")
def queue(spark):
    name = f"queue_{uuid.uuid4().hex}"
    return store_bucketed(X.queue(spark, SF), "write_queue", name, work_folder(spark, name), 8)


@pytest.fixture
def sorted_joins(spark):
    """As with tables too large to broadcast."""
    for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(k, "-1")
    yield
    for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.unset(k)


def side_of_the_table(df):
    """Operators above the bucketed scan, up to the join."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line)
    join = max(i for i in range(at) if "Join" in lines[i])
    return [line.lstrip(" :+-").split(" ")[0] for line in lines[join + 1:at]]


def outcomes(spark):
    tried = A.attempts(X.queue(spark, SF).where("status = 'PENDING'"), X.tag_state(spark, SF))
    return flows._stored(A.outcomes(tried, NOW), "outcomes")


def test_status_merge(spark, queue, sorted_joins):
    found = outcomes(spark)
    merged = A.apply_outcomes(queue, found)
    assert rows(merged) == rows(A.apply_outcomes(X.queue(spark, SF), found))
    assert not {x for x in side_of_the_table(merged) if "Exchange" in x}


def test_rollback_merge(spark, queue, sorted_joins):
    batch = queue.select("batch_id").first()[0]
    tried = queue.where("status = 'SUCCEEDED' AND pmod(hash(workload_id), 2) = 0").where(f"batch_id = '{batch}'").select(
        "batch_id", "workload_id", "product", "tag_key", "status")
    tried = flows._stored(tried, "tried")
    merged = RB.mark_rolled_back(queue, batch, tried, NOW)
    assert rows(merged) == rows(RB.mark_rolled_back(X.queue(spark, SF), batch, tried, NOW))
    assert 0 < merged.where("status = 'ROLLED_BACK' AND executed_at = TIMESTAMP '2024-04-29 12:00:00'").count() == tried.count()
    joined = RB.mark_rolled_back(queue, batch, tried, NOW)._jdf.queryExecution().executedPlan().toString()
    assert joined.count("Exchange") <= 2, joined  # the restored rows only


def test_counts_come_with_the_write(spark, make):
    run = flows.run_writer(X.queue(spark, SF), X.tag_state(spark, SF), NOW, "r", "me", dry_run=False)
    counted = {r["status"]: r["rows"] for r in A.run_summary(run.tried).collect()}
    assert {k: n for k, n in run.counts.items() if k != "rows"} == counted and run.counts["rows"] == sum(counted.values()) > 0
    none = flows.run_writer(make("write_queue"), X.tag_state(spark, SF), NOW, "r", "me")
    assert none.counts == {"rows": 0}
