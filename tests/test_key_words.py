"""Key sets as bits against the reports that read arrays."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest

from conftest import AS_OF, rows
from tagledger.operators import key_words as K, reports as R
from tagledger.plans import flows

KEYS = [f"key-{i:03d}" for i in range(150)]


@pytest.fixture(scope="module")
def summary(spark):
    from tagledger.schemas import TABLES

    rng = random.Random(5)
    data = []
    for i in range(600):
        held = rng.choice([None, [], rng.sample(KEYS, 4), rng.sample(KEYS, 2), [KEYS[rng.randrange(60, 70)]], [KEYS[149]], [KEYS[0]]])
        data.append((AS_OF - dt.timedelta(days=rng.randrange(50)), str(rng.randrange(4)), rng.choice(["JOBS", "SQL"]), str(rng.randrange(90)),
                     None, None, 0, held, D(1), D(rng.randrange(100)), D(0)))
    schema = TABLES["summary"]
    first = {}
    for r in data:
        first.setdefault(r[:4], r)
    return spark.createDataFrame(list(first.values()), schema).repartition(4)


def stored(summary, days=30, workspaces=None):
    numbers = flows._stored(K.key_numbers(summary), "numbers")
    daily = K.daily_words(summary, numbers, numbers.count())
    return flows._stored(K.rollup_words(daily, AS_OF, days, workspaces), "rollup"), numbers


@pytest.mark.parametrize("workspaces", [None, ["1", "3"]])
def test_any_choice_of_keys_from_one_rollup(summary, workspaces):
    rollup, numbers = stored(summary, workspaces=workspaces)
    assert [c for c in rollup.columns if c.startswith("keys_")] == ["keys_0", "keys_1", "keys_2"]
    for keys in ([], [KEYS[0]], [KEYS[149]], [KEYS[63], KEYS[64]], KEYS[:5] + ["never seen"], ["never seen"], KEYS):
        expected = rows(R.kpi_summary(summary, keys, AS_OF, 30, workspaces))
        assert rows(K.kpi_of_rollup(rollup, numbers, keys)) == expected, keys


def test_numbers_stay(spark, summary):
    few = K.key_numbers(summary.where("product = 'SQL'").limit(40))
    before = {r[0]: r[1] for r in flows._stored(few, "few").collect()}
    after = {r[0]: r[1] for r in K.key_numbers(summary, spark.createDataFrame(list(before.items()), "tag_key string, number int")).collect()}
    assert before.items() <= after.items() and sorted(after.values()) == list(range(len(after))) and len(after) > len(before) > 0


def test_no_rows(summary):
    rollup, numbers = stored(summary.limit(0))
    assert K.kpi_of_rollup(rollup, numbers, [KEYS[0]]).first()["untagged_workloads"] == 0


def test_the_rollup_is_a_hash_aggregate_of_numbers(summary):
    numbers = K.key_numbers(summary)
    plan = K.rollup_words(K.daily_words(summary, numbers, 150), AS_OF, 30)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan and "NestedLoop" not in plan
