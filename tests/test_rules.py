import random
import re

import pytest
from pyspark.sql import functions as F

from tagledger.functions import rules as R

HOSTILE = "Zoë's 5%_off\\--;"


@pytest.fixture(scope="module")
def workloads(spark):
    return spark.createDataFrame([
        ("a", "JOBS", "7", "data_eng-etl", "Ann@corp"),
        ("b", "SQL", "7", "dataXeng-etl", None),
        ("c", "SQL", "8", None, f"x {HOSTILE} y"),
        ("d", "APPS", "9", "50% off", "ZOË@corp"),
    ], "workload_id string, product string, workspace_id string, workload_name string, owner string")


def matches(workloads, field, op, value):
    rule = R.Rule(field, op, value, {"k": "v"})
    direct = workloads.filter(R.rule_match(rule))
    by_position = R.with_first_rule(workloads, [rule]).filter("first_rule = 0")
    found = sorted(r["workload_id"] for r in direct.collect())
    assert found == sorted(r["workload_id"] for r in by_position.collect())
    return "".join(found)


@pytest.mark.parametrize("field,op,value,expected", [
    ("owner", "equals", "ANN@CORP", "a"),
    ("owner", "equals", "zoË@corp", "d"),
    ("owner", "contains", HOSTILE.upper(), "c"),
    ("owner", "equals", HOSTILE, ""),
    ("owner", "matches", "*" + HOSTILE + "*", "c"),
    ("name", "contains", "data_eng", "a"),
    ("name", "contains", "50%", "d"),
    ("name", "contains", "0% OFF", "d"),
    ("name", "matches", "data_eng*", "a"),
    ("name", "matches", "data?eng*", "ab"),
    ("name", "matches", "*", "abcd"),
    ("name", "matches", "50%", ""),
    ("workspace", "equals", "7", "ab"),
    ("product", "equals", "sql", "bc"),
    ("product", "resembles", "sql", ""),
])
def test_match(workloads, field, op, value, expected):
    assert matches(workloads, field, op, value) == expected


def test_first_rule_wins_across_kinds(workloads):
    rules = R.complete_rules([
        {"field": "name", "op": "contains", "value": "etl", "tags": {"k": "0"}},
        {"field": "product", "op": "equals", "value": "sql", "tags": {"k": "1"}},
        {"field": "product", "op": "equals", "value": "SQL", "tags": {"k": "2"}},
        {"field": "owner", "op": "contains", "value": "zoë's", "tags": {"k": "3"}},
        {"field": "workspace", "op": "equals", "value": "7", "tags": {"k": "4"}},
    ])
    found = dict(R.with_first_rule(workloads, rules).select("workload_id", "first_rule").collect())
    assert found == {"a": 0, "b": 0, "c": 1, "d": -1}


def test_incomplete_rules_take_no_position():
    rules = R.complete_rules([
        {"field": "name", "op": "equals", "value": "", "tags": {"k": "v"}},
        {"field": "name", "op": "equals", "value": "x", "tags": {}},
        {"field": "name", "op": "equals", "value": None, "tags": {"k": "v"}},
        {"field": "name", "op": "equals", "value": "x", "tags": {"k": "v"}},
    ])
    assert [r.value for r in rules] == ["x"]


def test_unknown_field_is_an_error():
    with pytest.raises(KeyError):
        R.rule_match(R.Rule("colour", "equals", "x", {"k": "v"}))


def test_many_rules_agree_with_testing_each_in_turn(spark):
    words = [f"w{i}" for i in range(300)]
    rules = [R.Rule("name", ("equals", "contains", "matches")[i % 3],
                    w.upper() if i % 3 < 2 else f"{w}*", {"k": w}) for i, w in enumerate(words)]
    rules += [R.Rule("owner", "equals", w, {"k": w}) for w in words] + [R.Rule("name", "equals", "É", {"k": "1"})]
    names = [f"w{i}" for i in range(0, 300, 7)] + ["W12", "none", "xw45x", "w299z", "é", None]
    df = spark.createDataFrame([(n, "p", "1", o) for n in names for o in ("W3", None, "w299")],
                               "workload_name string, product string, workspace_id string, owner string")

    def expected(name, owner):
        name, owner = (name or "").lower(), (owner or "").lower()
        for i, w in enumerate(words):
            if (name == w, w in name, name.startswith(w))[i % 3]:
                return i
        return 300 + words.index(owner) if owner in words else (600 if name == "é" else -1)

    found = {(r[0], r[1]): r[2] for r in R.with_first_rule(df, rules).select(
        "workload_name", "owner", "first_rule").collect()}
    assert found == {(n, o): expected(n, o) for n in names for o in ("W3", None, "w299")}
    one_by_one = df.withColumn("first_rule", R.first_match(rules))
    assert found == {(r[0], r[3]): r[4] for r in one_by_one.collect()}


def test_values_of_the_winning_rule(spark):
    rules = [R.Rule("name", "equals", "x", {"k": HOSTILE}), R.Rule("name", "equals", "y", {"other": "1"})]
    df = spark.createDataFrame([(0,), (1,), (-1,)], "first_rule int")
    found = dict(df.select("first_rule", R.value_for_key(rules, "k")).collect())
    assert found == {0: HOSTILE, 1: "", -1: None}
    covered = dict(df.select("first_rule", R.covers_key(rules, "k")).collect())
    assert covered == {0: True, 1: False, -1: False}
    tags = R.rule_tags(spark, rules)
    assert sorted(map(tuple, tags.collect())) == [(0, "k", HOSTILE), (1, "other", "1")]
    assert R.rule_tags(spark, []).count() == 0
    assert df.filter(F.lit(True)).count() == 3


def test_globs_and_substrings_agree_with_plain_python(spark):
    rng = random.Random(11)

    def word(alphabet, least):
        return "".join(rng.choice(alphabet) for _ in range(rng.randrange(least, 7)))

    texts = sorted({word("aB_%\\.'*?", 0) for _ in range(300)})
    df = spark.createDataFrame([(t,) for t in texts], "workload_name string")
    patterns = sorted({word("ab_%\\.'*?", 1) for _ in range(40)})
    globs = df.select("workload_name", *[R.rule_match(R.Rule("name", "matches", p, {"k": "v"})) for p in patterns])
    parts = df.select("workload_name", *[R.rule_match(R.Rule("name", "contains", p, {"k": "v"})) for p in patterns])
    as_regex = [re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in p), re.S) for p in patterns]
    for row in globs.collect():
        assert list(row[1:]) == [bool(r.fullmatch(row[0].lower())) for r in as_regex], row[0]
    for row in parts.collect():
        assert list(row[1:]) == [p in row[0].lower() for p in patterns], row[0]


@pytest.mark.parametrize("count", [2, 22, 200])
def test_the_winner_does_not_depend_on_how_many_rules_there_are(spark, count):
    """The Kelvin sign lowers to k, whoever does the lowering; the first of two equal rules wins."""
    rng = random.Random(count)
    values = ["\u212a", "k"] + [rng.choice("kKxYz\u212aÉ") * rng.randrange(1, 4) for _ in range(count - 2)]
    rules = [R.Rule(rng.choice(("owner", "name")) if i > 1 else "owner", "equals", v, {"k": "v"}) for i, v in enumerate(values)]
    people = ["k", "K", "\u212a", "kk", "xX", "É", "é", "nobody", None]
    df = spark.createDataFrame([(o, n) for o in people for n in people], "owner string, workload_name string")
    in_turn = F.lit(-1)
    for i, rule in reversed(list(enumerate(rules))):
        in_turn = F.when(R.rule_match(rule), i).otherwise(in_turn)
    found = R.with_first_rule(df, rules).select("owner", "first_rule", in_turn.alias("expected")).collect()
    assert all(r["first_rule"] == r["expected"] for r in found)
    assert {r["first_rule"] for r in found if r["owner"] in ("k", "K", "\u212a")} == {0}
