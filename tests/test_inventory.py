import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tagledger.operators import inventory as I

SCAN = ("scan-a", dt.datetime(2024, 4, 29))
PLAIN = "workspace_id string, workload_id string, workload_name string, owner string, {tags}, read_error string"


def listing(spark, tags, *cells):
    return spark.createDataFrame([("1", w, f"n{w}", None, t, e) for w, t, e in cells], PLAIN.format(tags=tags))


@pytest.fixture(scope="module")
def sweep(spark):
    pair = "tags array<struct<key:string,value:string>>"
    listings = {
        "JOBS": listing(spark, "tags map<string,string>", ("1", {"b": "2", "a": "1"}, None), ("2", {}, None), ("3", None, None)),
        "SQL": listing(spark, pair, ("1", [("a", "1"), ("b", "2"), ("a", "3")], None), ("2", [], None), ("3", None, None)),
        "DLT": listing(spark, "tags array<map<string,string>>", ("1", [{"a": "1"}, None, {"a": "2", "c": "3"}], None),
                       ("2", [{"a": "1"}], "boom")),
        "ALL_PURPOSE": spark.createDataFrame(
            [("1", "c1", "n", None, {"a": "1"}, None, s) for s in ("UI", "API", "JOB", "PIPELINE", None)],
            PLAIN.format(tags="tags map<string,string>") + ", cluster_source string"),
    }
    errors = spark.createDataFrame([("1", "POOL", "timeout"), ("2", None, "no route")],
                                   "workspace_id string, product string, error string")
    return I.inventory_sweep(listings, *SCAN, errors=errors)


def test_tag_shapes(sweep):
    found = {(r["product"], r["workload_id"]): r for r in sweep.filter("product <> 'ALL_PURPOSE'").collect()}
    assert found["JOBS", "1"]["tags"] == {"a": "1", "b": "2"} and found["JOBS", "1"]["tag_keys"] == ["a", "b"]
    assert found["JOBS", "3"]["tags"] == {} and found["JOBS", "3"]["tag_read_ok"]
    assert found["SQL", "1"]["tags"] == {"a": "3", "b": "2"} and found["SQL", "3"]["tag_count"] == 0
    assert found["DLT", "1"]["tags"] == {"a": "2", "c": "3"}
    assert not found["DLT", "2"]["tag_read_ok"] and found["DLT", "2"]["tags"] == {}
    assert (found["DLT", "1"]["direct_tag"], found["DLT", "1"]["fallback"]) == (False, "UI_ONLY")
    assert found["POOL", "__list_error__POOL"]["read_error"] == "list failed: timeout"
    assert found["POOL", "__list_error__POOL"]["direct_tag"]
    assert found["__workspace__", "__unreachable__2"]["fallback"] is None
    assert not found["__workspace__", "__unreachable__2"]["direct_tag"]


def test_only_clusters_started_by_people_or_the_api(sweep):
    assert sweep.filter("product = 'ALL_PURPOSE'").count() == 2


def test_reports(sweep):
    summary = I.inventory_summary(sweep)
    assert rows(summary) == [
        ("ALL_PURPOSE", 2, 0, 2, 0, "DIRECT"), ("DLT", 2, 0, 1, 1, "UI_ONLY"),
        ("JOBS", 3, 2, 1, 0, "DIRECT"), ("SQL", 3, 2, 1, 0, "DIRECT")]
    assert rows(I.inventory_meta(sweep)) == [("scan-a", SCAN[1], 12)]
    assert ("__meta__", 12) in rows(I.inventory_report(sweep), "product", "resources")
    assert rows(I.coverage(summary), "product", "coverage_pct") == [
        ("ALL_PURPOSE", 100), ("DLT", 50), ("JOBS", 33), ("SQL", 33)]
    assert rows(I.coverage_totals(summary)) == [(10, 4)]
    state = {(r["workspace_id"], r["product"], r["workload_id"]): r for r in I.tag_state(sweep).collect()}
    assert state["1", "DLT", "2"]["problem"] == "boom" and state["1", "DLT", "2"]["tags"] is None
    assert state["1", "POOL", None]["problem"] == "list failed: timeout"
    assert state["2", None, None]["problem"] == "workspace unreachable: no route"
    assert state["1", "JOBS", "1"]["tags"] == {"a": "1", "b": "2"} and len(state) == 11
    assert ("POOL", 1, 0) in rows(I.sweep_counts(sweep))


def test_latest_scan_by_time_or_by_id(spark, sweep):
    older = sweep.filter("product = 'JOBS'").selectExpr(
        "* EXCEPT (scan_id, scanned_at)", "'scan-z' AS scan_id", "TIMESTAMP '2024-04-01' AS scanned_at")
    both = sweep.unionByName(older)
    assert rows(I.inventory_meta(both), "scan_id", "resources") == [("scan-a", 12)]
    assert rows(I.inventory_meta(both, by="id"), "scan_id", "resources") == [("scan-z", 3)]
    assert rows(I.inventory_meta(both.filter("false"))) == []


def test_ids_that_look_like_markers_are_resources(spark):
    found = I.inventory_sweep({"JOBS": listing(spark, "tags map<string,string>", ("__real", {"a": "1"}, None))}, *SCAN)
    assert rows(I.inventory_summary(found), "product", "resources") == [("JOBS", 1)]
    assert rows(I.tag_state(found), "workload_id", "problem") == [("__real", None)]


def test_a_resource_listed_twice_counts_once_in_the_state(spark):
    twice = listing(spark, "tags map<string,string>", ("1", {"a": "1"}, None), ("1", None, "boom"))
    assert rows(I.tag_state(I.inventory_sweep({"JOBS": twice}, *SCAN)), "workload_id", "problem") == [("1", None)]


def test_products_that_hide_their_tags_are_known_all_the_same(spark):
    hidden = listing(spark, "tags string", ("9", None, None))
    state = I.tag_state(I.inventory_sweep({"VECTOR_SEARCH": hidden}, *SCAN)).first()
    assert state["workload_id"] == "9" and state["tags"] is None and state["problem"] == I.UNREADABLE


def test_pairs_without_a_key_do_not_count(spark):
    from tagledger.functions.tagmaps import tags_from_maps, tags_from_pairs

    df = spark.sql("SELECT array(named_struct('key', 'a', 'value', '1'), named_struct('key', CAST(NULL AS STRING), 'value', '2'), "
                   "named_struct('key', 'a', 'value', '3')) AS p, array(map('x', '1'), NULL, map('x', '2')) AS m")
    row = df.select(tags_from_pairs(F.col("p")).alias("p"), tags_from_maps(F.col("m")).alias("m")).first()
    assert row["p"] == {"a": "3"} and row["m"] == {"x": "2"}
