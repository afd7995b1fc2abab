"""The gram index against the rules' own conditions."""

import random
import re
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF, NOW, rows
from tagledger.functions import rules as R
from tagledger.operators import queue as Q, rule_impact as RI, rule_index as RX

PARTS = ["etl", "ETL", "data", "Ann", "é", "É", "日本", "😀", "%", "_", "\\", "-", " ", "a", "ab", "O'Brien", "x", "1", "22", "."]
FIELDS = ("owner", "workspace", "product", "name")
WORKLOADS = "workload_id string, product string, workspace_id string, workload_name string, owner string"
TAGS = {"k": "v"}


def text(rng, most):
    return "".join(rng.choice(PARTS) for _ in range(rng.randrange(most)))


def made(seed, n_workloads, n_rules):
    rng = random.Random(seed)
    loads = [(str(i), *[None if rng.random() < 0.1 else text(rng, 6) for _ in range(4)]) for i in range(n_workloads)]
    rules = []
    for _ in range(n_rules):
        op = rng.choice(["equals", "contains", "matches", "matches", "resembles"])
        value = text(rng, 4)
        if op == "matches":
            value = "".join(x + rng.choice(["", "*", "?", "**"]) for x in [rng.choice(["", "*"]), *(text(rng, 3) for _ in range(2))])
        rules.append(R.Rule(rng.choice(FIELDS), op, value, {} if rng.random() < 0.1 else TAGS))
    return loads, rules


def both(spark, loads, rules):
    workloads = spark.createDataFrame(loads, WORKLOADS).repartition(4)
    plain = R.with_first_rule(workloads, R.complete_rules(rules))
    return rows(plain, "workload_id", "first_rule"), RX.with_first_rule(workloads, RX.rule_table(spark, rules))


@pytest.mark.parametrize("seed,n_rules", [(1, 4), (2, 12), (3, 40), (4, 40), (5, 120)])
def test_same_as_the_ladder(spark, seed, n_rules):
    expected, found = both(spark, *made(seed, 150, n_rules))
    assert rows(found, "workload_id", "first_rule") == expected
    assert len({r[1] for r in expected}) >= 2


@pytest.mark.parametrize("value", ["*", "?", "??", "???*", "*?*?", "é?", "*é", "\\*", "%*", "a_?", "a", "??a??"])
@pytest.mark.parametrize("field", ["name", "workspace"])
def test_short_and_wild_patterns(spark, value, field):
    loads = [(str(i), "P", t, t, None) for i, t in enumerate(["", "a", "é", "éa", "ab", "\\x", "%", "%z", "a_b", "a_", "xxaxx", "日本語", None])]
    expected, found = both(spark, loads, [R.Rule(field, "matches", value, TAGS)])
    assert rows(found, "workload_id", "first_rule") == expected


def test_no_rules_and_no_workloads(spark):
    loads, rules = made(6, 20, 10)
    expected, found = both(spark, loads, [])
    assert {r["first_rule"] for r in found.collect()} == {-1}
    empty = spark.createDataFrame([], WORKLOADS)
    assert RX.with_first_rule(empty, RX.rule_table(spark, rules)).count() == 0


def test_numbers_need_not_be_gapless_and_incomplete_rules_take_no_part(spark):
    workloads = spark.createDataFrame([("a", "P", "1", "alpha beta", "x"), ("b", "P", "1", "gamma", None)], WORKLOADS)
    table = spark.createDataFrame([
        (70, "name", "contains", "BETA", {"k": "1"}), (9, "name", "contains", "beta", {}), (8, "name", "contains", None, TAGS),
        (7, "name", "contains", "beta", None), (500, "workspace", "equals", "1", TAGS), (6, "nothing", "equals", "", TAGS)], RX.RULE_TABLE)
    assert rows(RX.with_first_rule(workloads, table), "workload_id", "first_rule") == [("a", 70), ("b", 500)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_thousands_of_rules_are_joined_by_equal_keys(spark):
    rng = random.Random(7)
    rules = [R.Rule("name", op, value, TAGS) for i in range(1700) for op, value in (
        ("contains", f"job-{i}-"), ("matches", f"*team?{rng.randrange(9999):04d}*"), ("equals", f"exact-{i}"))]
    loads = [(str(i), "P", "1", f"job-{i % 900}-team-{i:04d}", "hot@corp") for i in range(3000)]
    workloads = spark.createDataFrame(loads, WORKLOADS)
    found = RX.with_first_rule(workloads, RX.rule_table(spark, rules))
    got = {r["workload_id"]: r["first_rule"] for r in found.collect()}
    plan = plan_of(found)
    assert "NestedLoop" not in plan and "Cartesian" not in plan and len(plan) < 400_000
    team = {}
    for i, r in enumerate(rules):
        if r.op == "matches":
            team.setdefault(int(r.value[6:10]), i)
    for i in range(3000):
        assert got[str(i)] == min(3 * (i % 900), team.get(i, 10**9))


def test_a_gram_that_a_third_of_all_texts_hold_is_split(spark):
    """Both sides of the gram join arrive as plain shuffles, so a hot gram can be split."""
    loads = [(str(i), "P", "1", f"common-{i:06d}" if i % 3 == 0 else f"{i * 7919:09d}", None) for i in range(60_000)]
    rules = RX.rule_table(spark, [R.Rule("name", "contains", "ommo", TAGS), R.Rule("name", "contains", "xyz", TAGS)])
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = RX.with_first_rule(spark.createDataFrame(loads, WORKLOADS).repartition(6), rules)
        assert found.where("first_rule = 0").count() == 20_000
    finally:
        for k in settings:
            spark.conf.unset(k)


@pytest.fixture
def summary(make):
    return make("summary", *[{
        "usage_date": AS_OF, "workspace_id": "1", "product": "JOBS", "workload_id": str(i), "workload_name": f"etl-{i}-load",
        "owner": "ann@corp" if i % 2 else None, "is_serverless": 0, "tag_keys": [], "dbus": D(1), "list_cost": D(i + 1)} for i in range(40)])


def test_operators_take_a_list_or_a_table(spark, summary, make):
    rules = [{"field": "name", "op": "matches", "value": "etl-?-*", "tags": {"cost_center": "a", "team": "t"}},
             {"field": "owner", "op": "contains", "value": "ANN", "tags": {"team": "u"}}, {"field": "name", "op": "equals", "value": "", "tags": TAGS}]
    table, queue = RX.rule_table(spark, rules), make("write_queue")
    for one in (lambda r: RI.rule_candidates(summary, ["cost_center"], r, AS_OF, 30),
                lambda r: RI.rule_impact(summary, queue, ["cost_center"], r, AS_OF, 30),
                lambda r: RI.rule_sample(summary, queue, ["cost_center"], r, AS_OF, 30, limit=20),
                lambda r: Q.enqueue_rules(summary, queue, r, ["cost_center"], AS_OF, 30, "b", "me", NOW)):
        expected, found = one(rules), one(table)
        assert found.columns == expected.columns and rows(found) == rows(expected) and found.count() > 0


def rules_of_guessed_size(spark, n):
    """Rules whose size Spark guesses from a small source."""
    number = F.col("id").cast("string")
    tags = F.create_map(F.lit("cost_center"), F.concat(F.lit("cc-"), number), F.lit("team"), F.lit("t"))
    return spark.range(n).select(
        F.col("id").cast("int").alias("rule_idx"), F.lit("name").alias("field"), F.lit("contains").alias("op"),
        F.concat(F.lit("etl-"), number, F.lit("-load")).alias("value"), tags.alias("tags"))


def broadcast_unshuffled(df):
    """Operators below broadcasts that read no shuffle, by which adaptive execution could have learnt their size."""
    found, inside = [], None
    for line in plan_of(df).splitlines():
        lead, name = re.match(r"([\s:+-]*)(?:\*\(\d+\) )?(.*)", line).groups()
        if inside is not None and (len(lead) <= inside or name.startswith("Exchange")):
            inside = None
        if inside is not None:
            found.append(name)
        if name.startswith("BroadcastExchange"):
            inside = len(lead)
    return found


def test_the_index_broadcasts_no_exploded_rules(spark, summary):
    found = RI.rule_candidates(summary, ["cost_center"], rules_of_guessed_size(spark, 50), AS_OF, 30)
    assert not [x for x in broadcast_unshuffled(found) if "Generate" in x]
    assert rows(found, "workload_id", "first_rule") == sorted((str(i), i) for i in range(40))


def test_of_rules_that_ask_the_same_the_smallest_number_wins(spark):
    workloads = spark.createDataFrame([("a", "P", "1", "alpha", "x"), ("b", "P", "1", "beta", "x"), ("c", "P", "1", "abc", "x")], WORKLOADS)
    table = spark.createDataFrame([
        (9, "name", op, v, TAGS) for op, v in (("contains", "ALP"), ("matches", "b?ta"), ("equals", "abc"))] + [
        (n, "name", op, v, TAGS) for n in (5, 4) for op, v in (("contains", "alp"), ("matches", "B?TA"), ("equals", "ABC"))] + [
        (1, "name", "contains", "alp", {})], RX.RULE_TABLE)
    assert rows(RX.with_first_rule(workloads, table), "workload_id", "first_rule") == [("a", 4), ("b", 4), ("c", 4)]


def test_impact_broadcasts_no_exploded_rules(spark, summary, make):
    found = RI.rule_impact(summary, make("write_queue"), ["cost_center"], rules_of_guessed_size(spark, 50), AS_OF, 30)
    assert not [x for x in broadcast_unshuffled(found) if "Generate" in x]


def test_sample_does_not_broadcast_the_rules(spark, summary, make):
    found = RI.rule_sample(summary, make("write_queue"), ["cost_center"], rules_of_guessed_size(spark, 50), AS_OF, 30)
    assert not re.search(r"BroadcastHashJoin \[first_rule", plan_of(found)) and found.count() == 40


def test_enqueue_does_not_broadcast_the_tags(spark, summary, make):
    found = Q.enqueue_rules(summary, make("write_queue"), rules_of_guessed_size(spark, 50), ["cost_center"], AS_OF, 30, "b", "me", NOW)
    assert not [x for x in broadcast_unshuffled(found) if "Generate" in x] and found.count() == 80


def test_the_plan_does_not_repeat_how_the_workloads_are_made(spark, summary, make):
    """Adaptive execution keeps and rewrites the whole plan on the driver."""
    found = RI.rule_impact(summary, make("write_queue"), ["cost_center"], rules_of_guessed_size(spark, 50), AS_OF, 30)
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 20
    assert [tuple(r) for r in found.collect()] == [(40, 820.0, 40, 820.0)]


def test_rows_that_stand_twice_are_kept_and_a_text_that_many_hold_is_found_for_all(spark):
    workloads = spark.createDataFrame([("a", "P", "1", None, "x")] * 3 + [(None, None, None, None, None)] * 2, WORKLOADS).repartition(3)
    table = spark.createDataFrame([(4, "workspace", "equals", "1", TAGS), (5, "owner", "matches", "?", TAGS)], RX.RULE_TABLE)
    assert rows(RX.with_first_rule(workloads, table), "workload_id", "first_rule") == [("a", 4)] * 3 + [(None, -1)] * 2


def repeated(spark):
    """Rules that stand twice in their table, one of them with its value in other letters, and a rule for all the rest."""
    rules = [(n, "name", op, v, {"cost_center": f"cc-{n}"}) for n, op, v in (
        (3, "contains", "TL-7-"), (3, "contains", "tl-7-"), (4, "matches", "etl-1?-*"), (4, "matches", "etl-1?-*"), (5, "equals", "etl-30-load"),
        (5, "equals", "etl-30-load"), (9, "contains", "etl"))]
    return spark.createDataFrame(rules, RX.RULE_TABLE)


def test_enqueue_takes_rules_that_stand_twice(spark, summary, make):
    """A tag is queued for each row of the winning rule, whichever way the rule was found."""
    found = Q.enqueue_rules(summary, make("write_queue"), repeated(spark), ["cost_center"], AS_OF, 30, "b", "me", NOW)
    got = {(r["workload_id"], r["tag_value"]): r["count"] for r in found.groupBy("workload_id", "tag_value").count().collect()}
    first = {7: 3, 30: 5} | dict.fromkeys(range(10, 20), 4)
    assert got == {(str(i), f"cc-{first.get(i, 9)}"): 2 if i in first else 1 for i in range(40)}


def test_impact_counts_what_rules_that_stand_twice_match(spark, summary, make):
    table = spark.createDataFrame([(n, "name", op, v, TAGS) for n, op, v in ((1, "contains", "ETL-3"), (2, "matches", "*-1?-load"))], RX.RULE_TABLE)
    for rules in (table, table.union(table)):
        found = RI.rule_impact(summary, make("write_queue"), ["cost_center"], rules, AS_OF, 30)
        assert [tuple(r) for r in found.collect()] == [(40, 820.0, 21, 514.0)]


def test_a_table_with_all_rows_twice_matches_as_with_each_once(spark):
    loads, rules = made(12, 150, 60)
    expected, _ = both(spark, loads, rules)
    table = RX.rule_table(spark, rules)
    found = RX.with_first_rule(spark.createDataFrame(loads, WORKLOADS), table.union(table.withColumn("value", F.upper("value"))))
    assert rows(found, "workload_id", "first_rule") == expected


def test_sample_lists_what_rules_that_stand_twice_match(spark, summary, make):
    """A workload is listed for each row of the winning rule, whichever way the rule was found."""
    found = RI.rule_sample(summary, make("write_queue"), ["cost_center"], repeated(spark), AS_OF, 30)
    first = {7: 3, 30: 5} | dict.fromkeys(range(10, 20), 4)
    expected = [(str(i), f"cc-{first.get(i, 9)}") for i in range(40) for _ in range(2 if i in first else 1)]
    assert rows(found, "workload_id", "new_tag_value") == sorted(expected)
