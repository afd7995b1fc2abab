"""Physical plans: what is pushed to the scan, and what must never appear."""

import re

import pytest

import __spark_entry__ as entry
from conftest import AS_OF, NOW, SF
from tagledger.operators import apply as A, queue as Q, reports as R, rule_impact as RI, summary as S
from tagledger.sources import tables as T
from verification import fixtures as X


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module", autouse=True)
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("stored"))
    for name, build in (("usage", X.usage), ("list_prices", X.list_prices), ("write_queue", X.queue),
                        ("tag_state", X.tag_state), ("suggestions", X.suggestions)):
        T.replace_table(build(spark, SF), name, f"{base}/{name}")
    T.replace_table(S.daily_summary(
        T.read_table(spark, "usage", f"{base}/usage"), T.read_table(spark, "list_prices", f"{base}/list_prices"),
        AS_OF), "summary", f"{base}/summary")
    return lambda name: T.read_table(spark, name, f"{base}/{name}")


def test_no_nested_loops_and_only_bounded_hints(spark, stored):
    """With automatic broadcasts off, only the literal dimensions are broadcast
    and nothing falls back to comparing all pairs."""
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frames = {
            "summary": S.daily_summary(stored("usage"), stored("list_prices"), AS_OF),
            "live": R.kpi_live(stored("summary"), stored("write_queue"), "cost_center", AS_OF, 30),
            "auto_tag": Q.auto_tag(stored("summary"), stored("suggestions"), stored("write_queue"), "cost_center",
                                   AS_OF, 30, "b", "me", NOW, rules=X.RULES),
            "attempts": A.attempts(stored("write_queue").filter(Q.claimable(NOW)), stored("tag_state"), False),
            "risk": R.product_risk(R.by_product(stored("summary"), ["cost_center"], AS_OF, 30)),
        }
        for name, df in frames.items():
            text = plan(df)
            assert "NestedLoop" not in text and "Cartesian" not in text, name
        assert "BroadcastHashJoin" not in plan(frames["summary"])
        assert "SortMergeJoin" in plan(frames["attempts"])
        assert frames["summary"].count() == S.daily_summary(stored("usage"), stored("list_prices"), AS_OF).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)


def test_summary_scan_reads_little_and_filters_early(stored):
    text = plan(S.daily_summary(stored("usage"), stored("list_prices"), AS_OF))
    pushed = re.findall(r"PushedFilters: \[[^\]]*", text)[0]
    assert "EqualTo(usage_unit,DBU)" in pushed
    assert re.search(r"PartitionFilters: \[.*usage_date#\d+ >= 2024-01-30", text)
    aggregates = re.findall(r"(\w*Aggregate)\(keys?=\[([^\]]*)\]", text)
    inner = [kind for kind, keys in aggregates if "sku_name" in keys and "usage_date" in keys]
    assert inner == ["HashAggregate", "HashAggregate"]


def test_reports_use_hash_aggregates_and_read_few_columns(stored):
    text = plan(R.by_product(stored("summary"), ["cost_center"], AS_OF, 30))
    assert "SortAggregate" not in text and "ObjectHash" not in text
    schema = re.search(r"ReadSchema: struct<([^>]*>?[^>]*)>", text).group(1)
    assert "owner" not in schema and "workload_name" not in schema and "dbus" not in schema
    assert re.search(r"PartitionFilters: \[.*usage_date#\d+ >= 2024-03-30", text)


def test_product_filter_moves_below_the_rollup(stored):
    text = plan(RI.rule_impact(stored("summary"), stored("write_queue"), ["cost_center"], X.RULES, AS_OF, 30))
    assert "Not(In(product, [AI_GATEWAY,APPS" in text
    assert "EqualTo(tag_key,cost_center)" in text and "In(status" in text


def test_claim_is_pushed_and_needs_no_shuffle(stored):
    assert "Exchange" not in plan(Q.claim(stored("write_queue"), NOW, "run"))
    assert "EqualTo(batch_id,b)" in plan(stored("write_queue").filter(Q.claimable(NOW, batch_id="b")))


def test_rules_and_suggestions_share_their_shuffle(stored):
    df = Q.auto_tag(stored("summary"), stored("suggestions"), stored("write_queue"), "cost_center",
                    AS_OF, 30, "b", "me", NOW, rules=X.RULES)
    df.collect()
    assert "ReusedExchange" in plan(df)


def test_entry_points():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {name for name in entry.queries() if name not in entry.oracle_sql()} <= {*entry.LLM_QUERIES}
