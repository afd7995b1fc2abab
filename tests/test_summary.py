import datetime as dt
from decimal import Decimal as D

import pytest

from conftest import AS_OF, rows
from tagledger.operators import summary as S


def usage_row(**change):
    row = dict(usage_date=AS_OF, workspace_id="1", billing_origin_product="JOBS",
               usage_metadata={"job_id": "10"}, identity_metadata={}, product_features={},
               sku_name="A", usage_quantity=D("2"), usage_unit="DBU", custom_tags=None)
    row.update(change)
    for name, fields in (("usage_metadata", META), ("identity_metadata", WHO), ("product_features", ("is_serverless",))):
        row[name] = tuple(row[name].get(f) for f in fields)
    return row


META = ("job_id", "warehouse_id", "dlt_pipeline_id", "endpoint_id", "app_id", "index_id",
        "database_instance_id", "cluster_id", "job_name", "endpoint_name", "app_name", "run_name")
WHO = ("owned_by", "run_as", "created_by")


@pytest.fixture(scope="module")
def prices(make):
    return make("list_prices",
                {"sku_name": "A", "pricing": (D("0.5"),), "price_start_time": dt.datetime(2024, 1, 1)},
                {"sku_name": "A", "pricing": (D("9"),), "price_start_time": dt.datetime(2023, 1, 1),
                 "price_end_time": dt.datetime(2024, 1, 1)})


def build(make, prices, *usage, **options):
    return S.daily_summary(make("usage", *[usage_row(**u) for u in usage]), prices, AS_OF, **options)


def test_first_non_null_id_name_and_owner(make, prices):
    found = build(
        make, prices,
        dict(usage_metadata={"cluster_id": "c", "job_id": "j", "run_name": "run"},
             identity_metadata={"run_as": "r", "created_by": "c"}),
        dict(usage_metadata={"cluster_id": "c", "index_id": "i", "warehouse_id": "w"},
             identity_metadata={"owned_by": "o", "run_as": "r"}),
        dict(usage_metadata={"endpoint_id": "e", "app_name": "app", "endpoint_name": "ep"}),
        dict(usage_metadata={"job_name": "no id at all"}),
    )
    assert rows(found, "workload_id", "workload_name", "owner") == [
        ("e", "ep", None), ("j", "run", "r"), ("w", "w", "o")]


def test_window_is_inclusive_and_only_dbu_counts(make, prices):
    day = AS_OF - dt.timedelta(days=90)
    found = build(make, prices, dict(usage_date=day), dict(usage_date=day - dt.timedelta(days=1)),
                  dict(usage_unit="GB"))
    assert rows(found, "usage_date") == [(day,)]


def test_cost_tags_and_serverless_of_one_workload_day(make, prices):
    found = build(
        make, prices,
        dict(custom_tags={"b": "1", "a": "1"}, product_features={"is_serverless": False}),
        dict(custom_tags={"c": "1"}, usage_quantity=D("0.000001"), product_features={"is_serverless": True}),
        dict(custom_tags=None), dict(custom_tags={}), dict(sku_name="unknown", usage_quantity=D("5")),
    ).collect()
    assert len(found) == 1
    row = found[0]
    assert row["tag_keys"] == ["a", "b", "c"] and row["is_serverless"] == 1
    assert row["dbus"] == D("11.000001") and row["unpriced_dbus"] == D("5")
    assert row["list_cost"] == D("3.0000005")


def test_untagged_workload_has_an_empty_key_set(make, prices):
    assert build(make, prices, {}).collect()[0]["tag_keys"] == []


def test_two_open_prices(make, prices):
    double = prices.unionByName(make("list_prices", {
        "sku_name": "A", "pricing": (D("0.7"),), "price_start_time": dt.datetime(2024, 2, 1)}))
    with pytest.raises(Exception, match="more than one open price for SKU A"):
        build(make, double, {}).collect()
    assert build(make, double, {}, on_duplicate="latest").collect()[0]["list_cost"] == D("1.4")
    assert build(make, double, {}, on_duplicate="keep").collect()[0]["list_cost"] == D("2.4")
    with pytest.raises(ValueError):
        S.current_prices(double, "guess")


def test_rollup_and_window(make):
    base = dict(workspace_id="1", product="JOBS", workload_id="1", is_serverless=0, list_cost=D("1"))
    summary = make(
        "summary",
        dict(base, usage_date=AS_OF, workload_name="n2", tag_keys=["team"], is_serverless=1),
        dict(base, usage_date=AS_OF - dt.timedelta(days=30), workload_name="n1", owner="o", tag_keys=None),
        dict(base, usage_date=AS_OF - dt.timedelta(days=31), tag_keys=["cost_center"]),
        dict(base, usage_date=AS_OF, product="SQL", workspace_id="2", tag_keys=[]),
    )
    one = S.workload_rollup(summary, ["cost_center", "x"], AS_OF, 30)
    columns = ("product", "workload_name", "owner", "is_serverless", "last_seen", "cost", "is_untagged")
    assert rows(one, *columns) == [
        ("JOBS", "n2", "o", 1, AS_OF, D("2.0000000000"), True),
        ("SQL", None, None, 0, AS_OF, D("1.0000000000"), True)]
    assert rows(S.workload_rollup(summary, ["x", "team"], AS_OF, 30), "product", "is_untagged") == [
        ("JOBS", False), ("SQL", True)]
    assert rows(S.workload_rollup(summary, [], AS_OF, 30), "product", "is_untagged") == [
        ("JOBS", False), ("SQL", True)]
    assert rows(S.workload_rollup(summary, ["x"], AS_OF, 31, ["1"], text=()), "product", "cost") == [
        ("JOBS", D("3.0000000000"))]
    assert rows(S.summary_freshness(summary)) == [(AS_OF, 4)]


def test_hot_workload_gives_the_same_sums(spark, make, prices):
    many = make("usage", usage_row(), usage_row(usage_metadata={"job_id": "11"}))
    hot = many.filter("usage_metadata.job_id = '10'").crossJoin(spark.range(5000)).drop("id")
    found = S.daily_summary(many.unionByName(hot), prices, AS_OF)
    assert rows(found, "workload_id", "dbus") == [("10", D("10002")), ("11", D("2"))]


def test_other_quantity_types(make, prices):
    usage = make("usage", usage_row(usage_quantity=D("2.000001")), usage_row())
    for kind, cost in (("decimal(38,18)", D("2.0000005")), ("double", D("2.0000005"))):
        cast = usage.withColumn("usage_quantity", usage["usage_quantity"].cast(kind))
        assert S.daily_summary(cast, prices, AS_OF).first()["list_cost"] == cost
