"""The learned scorer against plain Python, and its edges."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from decimal import Decimal

import re

from conftest import NOW, SF, rows
from tagledger.operators import learned as L, suggestions as SG
from verification import fixtures as X

SHAPE = "product string, workload_id string, workspace_id string, workload_name string, owner string, team string"
TEAMS = ["a", "b", "c"]


def words(row):
    out = []
    for fact, value in (("name", row[3]), ("owner", row[4]), ("workspace", row[2])):
        out += [f"{fact}:{w}" for w in re.split(r"[\W_]+", (value or "").lower()) if w]
    return out


def out(row):
    return hashlib.md5(f"{row[0]}|{row[1]}".encode()).hexdigest()[0] in "048c"


def ln(x):
    return Decimal(str(round(math.log(x), 9)))


def model(tagged):
    counts, docs = defaultdict(Counter), Counter()
    for r in tagged:
        if r[5] in TEAMS:
            docs[r[5]] += 1
            counts[r[5]].update(words(r))
    vocabulary = {w for c in counts.values() for w in c}
    n = sum(docs.values())

    def score(row):
        mine = [w for w in words(row) if w in vocabulary]
        if not mine:
            return None
        losses = []
        for t in sorted(docs):
            used = sum(counts[t].values())
            total = ln(docs[t] / n) + len(mine) * ln(1.0 / (used + len(vocabulary)))
            losses.append((-(total + sum(ln(counts[t][w] + 1) for w in mine if counts[t][w])), t))
        best = min(losses)
        return best[1], round(1 / sum(math.exp(float(best[0] - x)) for x, _ in losses), 9)

    return score


def made(n=400):
    rng = random.Random(3)
    kinds = {"a": ["etl", "load"], "b": ["train", "Ünit"], "c": ["web", "etl"]}
    data = []
    for i in range(n):
        team = rng.choice(TEAMS)
        name = "-".join(rng.choice(kinds[team] + ["x", "job"]) for _ in range(3)) if rng.random() < 0.9 else None
        data.append((f"P{i % 2}", str(i), str(rng.randrange(3)), name, f"{rng.choice(kinds[team])}@corp" if rng.random() < 0.8 else None,
                     rng.choice(TEAMS) if rng.random() < 0.1 else team))
    return data + [("P0", "other", "1", "etl", None, "not asked for")]


def test_scores_are_those_of_the_formula(spark):
    data = made()
    frame = spark.createDataFrame(data, SHAPE).repartition(5)
    score = model([r for r in data if not out(r)])
    found = {(r.product, r.workload_id): (r.team, r.posterior) for r in L.Model(frame.where(~L.held_out()), TEAMS).scored(frame).collect()}
    assert len(found) == len(data)
    for r in data:
        team, posterior = score(r)
        assert found[r[0], r[1]][0] == team and abs(found[r[0], r[1]][1] - posterior) < 1e-8


def test_confidence_is_how_often_such_scores_were_right(spark):
    data = made()
    frame = spark.createDataFrame(data, SHAPE).repartition(5)
    score = model([r for r in data if not out(r)])
    bins = defaultdict(list)
    for r in filter(out, data):
        team, posterior = score(r)
        bins[min(int(posterior * 20), 19)].append(team == r[5])
    loads = frame.drop("team").selectExpr("*", "1.0 AS cost")
    for r in L.learned_suggestions(loads, frame, TEAMS, NOW).collect():
        row = next(d for d in data if d[:2] == (r.product, r.workload_id))
        team, posterior = score(row)
        b = min(int(posterior * 20), 19)
        expected = (sum(bins[b]) + 2 * (b + 0.5) / 20) / (len(bins[b]) + 2)
        assert r.suggested_cost_center == team and abs(r.confidence - expected) < 2e-6 and r.rationale.startswith("learned from ")


def test_nulls_and_unseen_words(spark):
    frame = spark.createDataFrame(made(), SHAPE)
    loads = spark.createDataFrame([("P", "1", None, None, None, 1.0), ("P", "2", None, "zzz qqq", "--", 1.0), ("P", "3", None, "zzz train", None, 1.0)],
                                  "product string, workload_id string, workspace_id string, workload_name string, owner string, cost double")
    found = {r.workload_id: r for r in L.learned_suggestions(loads, frame, TEAMS, NOW).collect()}
    assert [found[i].suggested_cost_center for i in "123"] == ["unknown", "unknown", "b"]
    assert found["1"].confidence == found["2"].confidence == 0 < found["3"].confidence
    assert found["3"].rationale == "learned from name:train"
    nothing = {r.suggested_cost_center for r in L.learned_suggestions(loads, frame.limit(0), TEAMS, NOW).collect()}
    assert nothing == {"unknown"} and L.learned_suggestions(loads.limit(0), frame, TEAMS, NOW).count() == 0


def test_better_than_the_word_list(spark):
    found = {r.method: r for r in L.accuracy(X.tagged_workloads(spark, SF), list(X.TEAM_WORDS), SG.keyword_scorer(X.TEAM_WORDS)).collect()}
    assert found["learned"].n == found["words"].n > 20
    assert found["learned"].n_right > 1.3 * found["words"].n_right


def test_plan_has_no_nested_loops(spark):
    frame = spark.createDataFrame(made(), SHAPE)
    found = L.learned_suggestions(frame.drop("team").selectExpr("*", "1.0 AS cost"), frame, TEAMS, NOW)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_tagged_workloads_come_from_the_latest_scan(spark, make):
    import datetime as dt

    def row(scan, day, name, **more):
        return {"scan_id": scan, "scanned_at": dt.datetime(2024, 4, day), "workspace_id": "1", "product": "JOBS", "workload_id": name,
                "workload_name": name, "tag_read_ok": True} | more

    inventory = make("inventory", row("z", 1, "old", tags={"team": "a"}), row("b", 2, "new", tags={"team": "b"}), row("b", 2, "bare", tags={}),
                     row("b", 2, "unread", tag_read_ok=False), row("b", 2, "gone", tags={"team": "c"}, listing_failed=True))
    assert rows(L.tagged_workloads(inventory, "team"), "workload_id", "team") == [("new", "b")]
