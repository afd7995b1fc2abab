import datetime as dt
from decimal import Decimal as D

import pytest

from conftest import AS_OF, rows
from tagledger import constants as C
from tagledger.functions.predicates import (
    confidence_floor, confident, is_resource, not_taggable_reason, taggable, untagged,
)
from tagledger.operators import reports as R


@pytest.fixture(scope="module")
def summary(make):
    def row(product, wid, cost, keys=(), **more):
        return dict(usage_date=AS_OF, workspace_id="1", product=product, workload_id=wid,
                    is_serverless=0, tag_keys=list(keys), list_cost=D(str(cost)), **more)

    return make(
        "summary", row("JOBS", "1", 60, workload_name="etl", owner="ann"), row("JOBS", "2", 40, ["cost_center"]),
        row("SQL", "1", 20), row("APPS", "3", 30, ["team"]), row("DLT", "4", "0.4"),
        row("FREE", "5", 0))


def test_kpi(summary):
    assert rows(R.kpi_summary(summary, ["cost_center"], AS_OF, 30)) == [
        (D("150"), D("110"), D("73.4"), 4)]
    assert rows(R.kpi_summary(summary, ["cost_center"], AS_OF, 30, ["none"])) == [(None, None, None, 0)]
    free = summary.filter("product = 'FREE'")
    assert rows(R.kpi_summary(free, ["cost_center"], AS_OF, 30), "pct_untagged", "untagged_workloads") == [(None, 1)]


def test_by_product_drops_products_that_round_to_nothing(summary):
    found = R.by_product(summary, ["cost_center"], AS_OF, 30)
    assert [tuple(r) for r in found.collect()] == [
        ("JOBS", D("100"), D("60"), D("40"), D("60.0")),
        ("APPS", D("30"), D("30"), D("0"), D("100.0")),
        ("SQL", D("20"), D("20"), D("0"), D("100.0"))]
    assert rows(R.product_risk(found), "product", "risk", "bar") == [
        ("APPS", "high", 50), ("JOBS", "low", 100), ("SQL", "high", 33)]


def test_risk_when_nothing_is_untagged(summary):
    found = R.by_product(summary.filter("product = 'APPS'"), ["team"], AS_OF, 30)
    assert rows(R.product_risk(found), "risk", "bar") == [("low", 2)]


def queue(make, *cells):
    return make("write_queue", *[
        dict(batch_id=f"b{i}", product=p, workload_id=w, tag_key=k, status=s, list_cost=None if c is None else D(c))
        for i, (p, w, k, s, c) in enumerate(cells)])


def test_live_credit_counts_an_id_once_and_never_goes_below_zero(summary, make):
    tagged = queue(make, ("JOBS", "1", "cost_center", C.SUCCEEDED, "50"),
                   ("SQL", "1", "cost_center", C.SUCCEEDED, "45"), ("X", "9", "cost_center", C.SUCCEEDED, None),
                   ("JOBS", "3", "team", C.SUCCEEDED, "5"), ("JOBS", "4", "cost_center", C.FAILED, "5"))
    assert rows(R.tagged_live_adjustment(tagged, "cost_center")) == [(2, D("50"))]
    live = R.kpi_live(summary, tagged, "cost_center", AS_OF, 30)
    assert rows(live) == [(D("150"), D("60"), 2, D("40.0"), D("50"), 2, D("45.5"))]
    much = queue(make, *[("JOBS", str(i), "cost_center", C.SUCCEEDED, "500") for i in range(9)])
    assert rows(R.kpi_live(summary, much, "cost_center", AS_OF, 30), "untagged_cost", "untagged_workloads",
                "pct_untagged") == [(D("0"), 0, D("0.0"))]
    none = R.kpi_live(summary, queue(make), "cost_center", AS_OF, 30)
    assert rows(none, "untagged_cost", "untagged_workloads", "tagged_live_cost") == [(D("110"), 4, D("0"))]


def test_not_taggable(summary):
    found = R.not_taggable_breakdown(summary, "cost_center", AS_OF, 30)
    assert rows(found) == [("APPS", "POLICY_GOVERNED", 1, D("30")), ("DLT", "UI_ONLY", 1, D("0"))]
    assert rows(R.reason_rollup(found), "reason", "workloads") == [("POLICY_GOVERNED", 1), ("UI_ONLY", 1)]


def test_taggable_and_reason_disagree_only_where_meant(spark):
    df = spark.createDataFrame(
        [("SQL", 0), ("SQL", 1), ("SQL", None), ("DLT", 0), ("NEW", 0), ("APPS", 0), ("JOBS", 1)],
        "product string, is_serverless int")
    found = rows(df.select("product", "is_serverless", taggable(), not_taggable_reason()))
    assert found == [
        ("APPS", 0, False, "POLICY_GOVERNED"), ("DLT", 0, True, "UI_ONLY"), ("JOBS", 1, True, "TAGGABLE"),
        ("NEW", 0, True, "NO_API"), ("SQL", 0, True, "TAGGABLE"), ("SQL", 1, False, "POLICY_GOVERNED"),
        ("SQL", None, None, "NO_API")]


def test_untagged_predicate(spark):
    df = spark.createDataFrame([(["a"],), ([],), (None,)], "tag_keys array<string>")
    assert [r[0] for r in df.select(untagged(["a", "b"])).collect()] == [False, True, True]
    assert [r[0] for r in df.select(untagged([])).collect()] == [False, True, True]


def test_confidence_floor_takes_in_the_boundary_only(spark):
    assert 0.7 < confidence_floor(0.8) < 0.8 and confidence_floor(0.7) > 0.6
    df = spark.createDataFrame(
        [("x", 0.8), ("x", 0.7999999), ("x", 0.7), ("Unknown", 0.9), (None, 0.9), ("x", None)],
        "suggested_cost_center string, confidence double")
    assert df.filter(confident(0.8)).count() == 2


def test_sentinels(spark):
    df = spark.createDataFrame([("__x", False), ("_x", None), ("__y", True)], "workload_id string, listing_failed boolean")
    assert rows(df.filter(is_resource()), "workload_id") == [("__x",), ("_x",)]


def test_field_values(summary):
    assert rows(R.distinct_field_values(summary, "name", AS_OF, 30)) == [("etl", D("60"), 1)]
    assert rows(R.distinct_field_values(summary, "nonsense", AS_OF, 30)) == [("ann", D("60"), 1)]
    two = R.distinct_field_values(summary, "product", AS_OF, 30, limit=2)
    assert [r["value"] for r in two.collect()] == ["APPS", "DLT"]


def test_explore(spark):
    listed = spark.createDataFrame([
        ("JOBS", "1", "beta", "ann", 5.0, AS_OF), ("JOBS", "2", None, "bob", 9.0, AS_OF - dt.timedelta(days=8)),
        ("JOBS", "x3", None, None, None, None), ("SQL", "4", "Alpha", "x", 1.0, AS_OF - dt.timedelta(days=7)),
    ], "product string, workload_id string, workload_name string, owner string, cost double, last_seen date")

    def ids(**options):
        return [r["workload_id"] for r in R.explore(listed, AS_OF, **options).collect()]

    assert ids() == ["2", "1", "4", "x3"]
    assert ids(min_cost=5) == ["2", "1"]
    assert ids(active_within=7, sort_by="latest") == ["1", "4"]
    assert ids(text=" X ") == ["4", "x3"]
    assert ids(text="BOB") == ["2"]
    assert ids(sort_by="name")[-2:] == ["4", "1"]
    assert [r["workload_id"] for r in R.explore(listed.drop("owner"), AS_OF, text="bob").collect()] == []
