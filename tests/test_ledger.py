"""Whole life of the tables on the given data, stored between steps."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF, NOW, SF, rows
from tagledger.operators import queue as Q, reports as R, suggestions as SG
from tagledger.plans.ledger import Ledger
from verification import fixtures as X

KEY = "cost_center"


def tag_rows(state):
    return rows(state.select("workspace_id", "product", "workload_id", F.explode("tags").alias("k", "v")))


@pytest.fixture(scope="module")
def ledger(spark, tmp_path_factory):
    made = Ledger(spark, str(tmp_path_factory.mktemp("ledger")))
    made.create()
    made.refresh_summary(X.usage(spark, SF), X.list_prices(spark, SF), AS_OF)
    made.refresh_suggestions(AS_OF, NOW, list(X.TEAM_WORDS), SG.keyword_scorer(X.TEAM_WORDS))
    made.record_scan(X.listings(spark, SF), *X.NEW_SCAN, errors=X.listing_errors(spark, SF))
    return made


def test_enqueue_drain_and_roll_back(spark, ledger):
    before = tag_rows(ledger.read("tag_state"))
    summary = ledger.read("summary")
    batch = Q.auto_tag(summary, ledger.read("suggestions"), ledger.read("write_queue"), KEY, AS_OF, 30,
                       "b1", "me", NOW, rules=X.RULES)
    size = batch.count()
    ledger.enqueue(batch)
    assert ledger.read("write_queue").count() == size > 20

    trial = ledger.drain(NOW, "run-0", "me")
    assert ledger.read("audit").filter("status = 'SUCCEEDED'").count() == 0
    assert tag_rows(ledger.read("tag_state")) == before
    assert trial.tried.count() == size

    again = ledger.read("write_queue").withColumns({"status": F.lit("PENDING"), "batch_id": F.lit("b2")})
    ledger.enqueue(again)
    done = ledger.drain(NOW, "run-1", "me", dry_run=False, batch_id="b2")
    counts = dict(rows(ledger.read("write_queue").filter("batch_id = 'b2'").groupBy("status").count()))
    assert sum(counts.values()) == size and counts["SUCCEEDED"] > 0 and counts["FAILED"] > 0
    assert set(counts) <= {"SUCCEEDED", "FAILED", "UNSUPPORTED"}
    assert tag_rows(ledger.read("tag_state")) != before
    changed = done.tried.filter("status = 'SUCCEEDED' AND NOT noop").count()
    assert ledger.read("audit").filter("status = 'SUCCEEDED'").count() == changed > 0

    live = R.kpi_live(summary, ledger.read("write_queue"), KEY, AS_OF, 30).first()
    plain = R.kpi_summary(summary, [KEY], AS_OF, 30).first()
    assert live["untagged_workloads"] < plain["untagged_workloads"]

    left = Q.auto_tag(summary, ledger.read("suggestions"), ledger.read("write_queue"), KEY, AS_OF, 30,
                      "b3", "me", NOW)
    assert left.count() == 0, "suggestions already handled are not proposed again"

    later = NOW + dt.timedelta(hours=1)
    ledger.rollback("b2", later, "run-2", "me", dry_run=False)
    assert tag_rows(ledger.read("tag_state")) == before
    after = dict(rows(ledger.read("write_queue").filter("batch_id = 'b2'").groupBy("status").count()))
    assert after["ROLLED_BACK"] == changed and sum(after.values()) == size
    assert ledger.read("audit").filter("action = 'ROLLBACK'").count() == changed


def test_one_scan_is_read_from_its_own_directory(ledger):
    from tagledger.operators import inventory as I

    found = I.latest_scan(ledger.read("inventory"))
    assert found.count() > 0
    assert "PartitionFilters: [isnotnull(scan_id" in found._jdf.queryExecution().executedPlan().toString()


def test_claim_is_visible_before_the_run_ends(ledger):
    ledger.enqueue(ledger.read("write_queue").filter("batch_id = 'b2'").withColumns(
        {"batch_id": F.lit("b9"), "status": F.lit("PENDING")}))
    ledger.claim(NOW, "dead", batch_id="b9")
    assert ledger.drain(NOW + dt.timedelta(minutes=30), "next", "me", False, batch_id="b9").tried.count() == 0
    assert ledger.drain(NOW + dt.timedelta(minutes=31), "next", "me", False, batch_id="b9").tried.count() > 0


# Runs that overlap, on small tables of their own.

def intent(make, batch, *ids, product="JOBS", workspace="1", key=KEY, value="v"):
    return make("write_queue", *[
        dict(batch_id=batch, enqueued_at=NOW, workspace_id=workspace, product=product, workload_id=i, is_serverless=0,
             tag_key=key, tag_value=value, status="PENDING", attempts=0) for i in ids])


@pytest.fixture
def small(spark, make, folder):
    made = Ledger(spark, folder)
    made.create()
    made.store_state(make("tag_state", *[
        dict(workspace_id=w, product="JOBS", workload_id=str(i), tags={}) for w in "12" for i in range(1, 5)]))
    return made


def statuses(ledger):
    return rows(ledger.read("write_queue"), "batch_id", "workload_id", "status")


def test_intent_stored_during_a_run_stays(make, small):
    small.enqueue(intent(make, "b1", "1"))
    small.claim(NOW, "run-1")
    small.enqueue(intent(make, "b2", "2"))
    small.apply_claimed(NOW, "run-1", "me", dry_run=False)
    assert statuses(small) == [("b1", "1", "SUCCEEDED"), ("b2", "2", "PENDING")]


def test_runs_inside_each_other_lose_nothing(make, small):
    small.enqueue(intent(make, "b1", "1"))
    small.enqueue(intent(make, "b2", "2"))
    small.claim(NOW, "run-1", batch_id="b1")
    small.drain(NOW, "run-2", "me", dry_run=False, batch_id="b2")
    small.apply_claimed(NOW, "run-1", "me", dry_run=False)
    assert statuses(small) == [("b1", "1", "SUCCEEDED"), ("b2", "2", "SUCCEEDED")]
    tagged = {r[2] for r in tag_rows(small.read("tag_state"))}
    assert tagged == {"1", "2"}
    assert rows(small.read("audit"), "batch_id", "status") == [("b1", "SUCCEEDED"), ("b2", "SUCCEEDED")]


def current(ledger):
    return {name: rows(tag_rows_frame(ledger.read(name)) if name == "tag_state" else ledger.read(name))
            for name in ("write_queue", "tag_state", "audit")}


def tag_rows_frame(state):
    return state.select("workspace_id", "product", "workload_id", "problem", F.explode_outer("tags").alias("k", "v"))


def test_a_repeated_run_changes_nothing(make, small):
    """Whatever of a run is written a second time, under its token, counts once."""
    batch = intent(make, "b1", "1", "2", "9")
    small.enqueue(batch)
    small.drain(NOW, "run", "me", dry_run=False)
    expected = current(small)
    small.append("write_queue", batch)
    for name in ("queue_events", "tag_changes", "audit"):
        small.append(name, small._stored(small.rows(name), "again"))
    assert current(small) == expected
    assert rows(small.read("write_queue"), "workload_id", "status", "attempts") == [
        ("1", "SUCCEEDED", 1), ("2", "SUCCEEDED", 1), ("9", "FAILED", 1)]


@pytest.mark.parametrize("written", [0, 1, 2])
def test_a_run_that_dies_between_its_writes_is_made_up_for(make, small, monkeypatch, written):
    """After the claim, the audit or the changes: the rows stay RUNNING and are free after half an hour."""
    small.enqueue(intent(make, "b1", "1"))
    done, append = [], Ledger.append

    def dying(self, name, found):
        if len(done) > written:
            raise RuntimeError("gone")
        done.append(name)
        append(self, name, found)

    monkeypatch.setattr(Ledger, "append", dying)
    with pytest.raises(RuntimeError):
        small.drain(NOW, "dead", "me", dry_run=False)
    monkeypatch.setattr(Ledger, "append", append)
    assert statuses(small) == [("b1", "1", "RUNNING")]
    assert small.drain(NOW + dt.timedelta(minutes=30), "early", "me", False).tried.count() == 0
    small.drain(NOW + dt.timedelta(minutes=31), "next", "me", dry_run=False)
    assert statuses(small) == [("b1", "1", "SUCCEEDED")]
    assert tag_rows(small.read("tag_state")) == [("1", "JOBS", "1", KEY, "v")]
    assert small.read("audit").filter("status = 'SUCCEEDED'").count() >= 1


def test_compaction_changes_no_reading(make, small):
    for i, run in enumerate(("r1", "r2", "r3")):
        small.enqueue(intent(make, f"b{i}", "1", "2", value=run))
        small.drain(NOW + dt.timedelta(minutes=i), run, "me", dry_run=i == 0)
    small.rollback("b2", NOW + dt.timedelta(minutes=9), "back", "me", dry_run=False)
    expected, events = current(small), small.rows("queue_events").count()
    for _ in range(2):
        small.compact()
        assert current(small) == expected
    assert small.rows("queue_events").count() == 6 < events
    assert small.rows("tag_changes").count() == 2
    small.enqueue(intent(make, "b9", "3"))
    small.drain(NOW + dt.timedelta(minutes=10), "r9", "me", dry_run=False)
    assert len(statuses(small)) == 7 and ("b9", "3", "SUCCEEDED") in statuses(small)


def test_the_later_of_two_claims_counts(make, small):
    """Both runs saw the row free; one of them carries it out."""
    small.enqueue(intent(make, "b1", "1"))
    free = small.read("write_queue")
    small.claim(NOW, "run-1")
    small.append("queue_events", small._event(Q.claim(free, NOW + dt.timedelta(seconds=1), "run-2"), 1, NOW + dt.timedelta(seconds=1)))
    assert small.apply_claimed(NOW, "run-1", "me", dry_run=False).tried.count() == 0
    assert small.apply_claimed(NOW + dt.timedelta(seconds=2), "run-2", "me", dry_run=False).tried.count() == 1


def test_events_of_unknown_rows_count_for_nothing(make, small):
    small.enqueue(intent(make, "b1", "1"))
    small.append("queue_events", small._event(intent(make, "b7", "1").withColumn("status", F.lit("FAILED")), 2, NOW))
    assert statuses(small) == [("b1", "1", "PENDING")]


def test_no_table_is_handled_file_by_file():
    from pathlib import Path

    import tagledger

    for name in ("sources/changelog.py", "sources/tables.py", "plans/ledger.py"):
        assert "_jvm" not in (Path(tagledger.__file__).parent / name).read_text()


def test_a_failed_refresh_leaves_the_table_as_it_was(spark, make, small):
    kept = make("suggestions", dict(product="JOBS", workload_id="1"))
    small.store_suggestions(kept)
    small.append("summary", make("summary", dict(
        usage_date=AS_OF, workspace_id="1", product="JOBS", workload_id="1", tag_keys=[], list_cost=D(1))))
    with pytest.raises(Exception, match="no scorer"):
        small.refresh_suggestions(AS_OF, NOW, ["x"], lambda prompt: F.raise_error(F.lit("no scorer")).cast("string"))
    assert small.read("suggestions").count() == 1


def test_changed_days_only(make, small):
    day = AS_OF - dt.timedelta(days=1)
    price = make("list_prices", dict(sku_name="A", pricing={"default": D(1)}))

    def usage(*days):
        return make("usage", *[dict(usage_date=d, workspace_id="1", billing_origin_product="JOBS", usage_metadata={"job_id": "1"},
                                    sku_name="A", usage_quantity=D(q), usage_unit="DBU") for d, q in days])

    small.refresh_summary(usage((AS_OF, 1), (day, 1)), price, AS_OF)
    files = set(small.rows("summary").filter(F.col("usage_date") == AS_OF).inputFiles())
    small.refresh_summary(usage((AS_OF, 5), (day, 7)), price, AS_OF, changed=[day])
    assert rows(small.read("summary"), "usage_date", "list_cost") == [(day, D(7)), (AS_OF, D(1))]
    assert files & set(small.rows("summary").inputFiles()) == {f for f in files if str(AS_OF) in f} != set()
    small.refresh_summary(usage((AS_OF, 5)), price, AS_OF, changed=[day])
    assert rows(small.read("summary"), "usage_date", "list_cost") == [(AS_OF, D(1))]
    small.refresh_summary(usage((day, 2)), price, AS_OF)
    assert rows(small.read("summary"), "usage_date", "list_cost") == [(day, D(2))]


def test_a_drain_writes_only_its_directories(make, small):
    for i in range(1, 4):
        small.enqueue(intent(make, f"b{i}", str(i)))
    before = set(small.rows("write_queue").inputFiles())
    small.drain(NOW, "run", "me", dry_run=False, batch_id="b2")
    assert set(small.rows("write_queue").inputFiles()) == before and len(before) == 3
    assert small.rows("queue_events").select("batch_bucket").distinct().count() == 1


def test_one_batch_is_read_from_its_own_directory(make, small):
    from tagledger.operators import batches as B, rollback as RB

    for found in (B.count_queue_rows(small.read("write_queue"), "b"), RB.rollback_plan(small.read("audit"), "b")):
        assert found.count() >= 0
    small.append("audit", small.spark.createDataFrame(
        [("a", "b", NOW, "1", "JOBS", "1", "k", "SET", "SUCCEEDED")], "audit_id string, batch_id string, executed_at timestamp, "
        "workspace_id string, product string, workload_id string, tag_key string, action string, status string"))
    plan = RB.rollback_plan(small.read("audit"), "b")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch_bucket" in plan
    small.enqueue(intent(make, "b", "1"))
    small.claim(NOW, "run", batch_id="b")
    queue = small._of("b")._jdf.queryExecution().executedPlan().toString()
    assert queue.count("PartitionFilters: [isnotnull(batch_bucket") == 2


def listed(spark, *cells):
    return spark.createDataFrame([(w, i, None, None, t, None) for w, i, t in cells],
                                 "workspace_id string, workload_id string, workload_name string, owner string, "
                                 "tags map<string,string>, read_error string")


def test_scans_of_some_workspaces_keep_the_rest(spark, make, small):
    scan = dt.datetime(2024, 4, 29)
    for _ in range(2):  # a repeated scan changes nothing
        small.record_scan({"JOBS": listed(spark, ("2", "9", {"a": "1"}))}, "s1", scan, workspaces=["2"])
        found = rows(small.read("tag_state"), "workspace_id", "workload_id")
        assert found == [("1", "1"), ("1", "2"), ("1", "3"), ("1", "4"), ("2", "9")]
        assert small.read("inventory").count() == 1
    errors = spark.createDataFrame([("1", None, "no route")], "workspace_id string, product string, error string")
    small.record_scan({"JOBS": listed(spark)}, "s2", scan, errors=errors, workspaces=["1"])
    small.enqueue(intent(make, "b1", "1"))
    small.enqueue(intent(make, "b2", "9", workspace="2"))
    small.enqueue(intent(make, "b3", "8", workspace="2"))
    small.drain(NOW, "run", "me", dry_run=False)
    assert rows(small.read("write_queue"), "batch_id", "status", "last_error") == [
        ("b1", "FAILED", "Unknown: workspace unreachable: no route"), ("b2", "SUCCEEDED", None),
        ("b3", "FAILED", "ResourceDoesNotExist: JOBS 8")]


def test_every_direct_tag_product_can_be_applied(spark, make, small):
    from tagledger import capability
    from tagledger.operators.inventory import LISTING_SHAPES

    shapes = {"map": "map<string,string>", "pairs": "array<struct<key:string,value:string>>", "none": "string"}
    products = capability.direct_tag_products()
    listings = {p: spark.createDataFrame([("1", "7", None, None, None, None)], "workspace_id string, workload_id string, "
                                         "workload_name string, owner string, tags " + shapes[LISTING_SHAPES[p]] +
                                         ", read_error string") for p in products}
    small.record_scan(listings, "s", dt.datetime(2024, 4, 29))
    for p in products:
        small.enqueue(intent(make, f"b-{p}", "7", product=p))
    small.drain(NOW, "run", "me", dry_run=False)
    assert rows(small.read("write_queue").groupBy("status").count()) == [("SUCCEEDED", len(products))]
    small.rollback("b-VECTOR_SEARCH", NOW + dt.timedelta(minutes=1), "back", "me", dry_run=False)
    assert rows(small.read("audit").filter("action = 'ROLLBACK'"), "status", "error") == [
        ("FAILED", "PreviousValueUnknown: VECTOR_SEARCH 7")]


def test_no_resource_gets_too_many_tags(make, small):
    for i in range(20):
        small.enqueue(intent(make, f"b{i % 2}", "1", key=f"k{i}")) if i % 10 == 9 else None
    small.enqueue(intent(make, "c", "1", key="k0"))
    many = [intent(make, "d", "1", key=f"x{i}") for i in range(17)]
    rows_ = many[0]
    for part in many[1:]:
        rows_ = rows_.unionByName(part)
    small.enqueue(rows_)
    small.enqueue(intent(make, "e", "1", key="x3"))
    with pytest.raises(ValueError, match="too many tags"):
        small.enqueue(intent(make, "f", "1", key="one-more"))
    small.enqueue(intent(make, "f", "2", key="one-more"))
