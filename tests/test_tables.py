import datetime as dt
from decimal import Decimal as D

import pytest

from conftest import AS_OF, NOW, rows
from tagledger import constants as C
from tagledger.operators import summary as S
from tagledger.plans.ledger import Ledger
from tagledger.plans.session import work_folder
from tagledger.schemas import REQUIRED, TABLES
from tagledger.sources import tables as T
from tagledger.streaming import status as ST


def intent(wid, **more):
    return dict(dict(batch_id="b", enqueued_at=NOW, workspace_id="1", product="JOBS", workload_id=wid,
                     tag_key="k", tag_value="v", status=C.PENDING), **more)


def test_append_fills_orders_and_checks_columns(spark, make, folder):
    path = f"{folder}/queue"
    T.append_table(make("write_queue", intent("1")), "write_queue", path)
    few = make("write_queue", intent("2")).select("status", "tag_value", *[
        c for c in REQUIRED["write_queue"] if c not in ("status", "tag_value")])
    T.append_table(few, "write_queue", path)
    stored = T.read_table(spark, "write_queue", path)
    assert stored.drop("batch_bucket").schema.simpleString() == TABLES["write_queue"].simpleString()
    assert rows(stored, "workload_id", "last_error", "list_cost") == [("1", None, None), ("2", None, None)]
    with pytest.raises(Exception, match="write_queue.tag_value must not be null"):
        T.append_table(make("write_queue", intent("3", tag_value=None)), "write_queue", path)
    assert T.read_table(spark, "write_queue", path).count() == 2


def test_summary_is_partitioned_and_pruned(spark, make, folder):
    days = [AS_OF - dt.timedelta(days=i) for i in range(5)]
    T.replace_table(make("summary", *[
        dict(usage_date=d, workspace_id="1", product="JOBS", workload_id="1", tag_keys=["a"], list_cost=D(1)) for d in days]), "summary", folder)
    stored = T.read_table(spark, "summary", folder)
    window = S.summary_window(stored, AS_OF, 2)
    assert window.count() == 3
    assert len(window.inputFiles()) <= 5
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(usage_date" in plan


def outcome(make, wid, status, minutes):
    return make("outcomes", dict(batch_id="b", workload_id=wid, product="JOBS", tag_key="k", status=status,
                                 executed_at=NOW + dt.timedelta(minutes=minutes)))


def test_status_stream(spark, make, folder):
    T.append_table(make("write_queue", intent("1"), intent("2"), intent("3")), "write_queue", f"{folder}/queue")
    queue = T.read_table(spark, "write_queue", f"{folder}/queue")
    arriving, rounds, mark = (f"{folder}/{n}" for n in ("arriving", "rounds", "checkpoint"))

    def follow(**options):
        ST.start_status_stream(spark, arriving, rounds, mark, every=None, **options).awaitTermination()

    T.append_table(outcome(make, "1", C.FAILED, 1).unionByName(outcome(make, "1", C.SUCCEEDED, 2)), "outcomes", arriving)
    T.append_table(outcome(make, "2", C.FAILED, 1), "outcomes", arriving)
    follow()
    now = ST.current_queue(queue, rounds)
    assert rows(now, "workload_id", "status", "attempts") == [
        ("1", C.SUCCEEDED, 1), ("2", C.FAILED, 1), ("3", C.PENDING, None)]
    follow()
    assert rows(ST.current_queue(queue, rounds), "attempts") == rows(now, "attempts")
    T.append_table(outcome(make, "2", C.SUCCEEDED, 9), "outcomes", arriving)
    T.append_table(outcome(make, "2", C.RUNNING, 3), "outcomes", arriving)
    follow(files_per_round=1)
    after = ST.current_queue(queue, rounds)
    assert rows(after, "workload_id", "status", "attempts") == [
        ("1", C.SUCCEEDED, 1), ("2", C.SUCCEEDED, 3), ("3", C.PENDING, None)]


@pytest.fixture
def followed(spark, make, folder):
    made = Ledger(spark, f"{folder}/ledger")
    made.create()
    made.append("write_queue", make("write_queue", intent("1"), intent("2"), intent("3")))
    return made


def test_outcomes_are_followed_into_the_ledger(spark, make, folder, followed):
    arriving, mark = f"{folder}/arriving", f"{folder}/checkpoint"

    def follow(*found, **options):
        for rows_ in found:
            T.append_table(rows_, "outcomes", arriving)
        ST.start_ledger_stream(followed, arriving, mark, every=None, **options).awaitTermination()
        return rows(followed.read("write_queue"), "workload_id", "status", "attempts")

    first = follow(outcome(make, "1", C.FAILED, 1).unionByName(outcome(make, "1", C.SUCCEEDED, 2)), outcome(make, "2", C.FAILED, 1))
    assert first == [("1", C.SUCCEEDED, 1), ("2", C.FAILED, 1), ("3", C.PENDING, None)]
    assert follow() == first
    # files that arrive again change nothing, nor does compaction in between
    followed.compact()
    assert follow(outcome(make, "1", C.SUCCEEDED, 2), outcome(make, "2", C.FAILED, 1)) == first
    assert follow(outcome(make, "2", C.SUCCEEDED, 9)) == [("1", C.SUCCEEDED, 1), ("2", C.SUCCEEDED, 2), ("3", C.PENDING, None)]
    # behind the newest by more than an hour: not taken
    follow(outcome(make, "3", C.RUNNING, 300))
    late = follow(outcome(make, "1", C.FAILED, 3))
    assert late == [("1", C.SUCCEEDED, 1), ("2", C.SUCCEEDED, 2), ("3", C.RUNNING, 1)]


def test_a_replayed_round_of_the_stream_counts_once(make, folder, followed, monkeypatch):
    """The same micro-batch is handed over twice, as after a crash before it was noted."""
    from pyspark.sql.streaming.readwriter import DataStreamWriter

    T.append_table(outcome(make, "1", C.FAILED, 1), "outcomes", f"{folder}/arriving")
    plain = DataStreamWriter.foreachBatch
    monkeypatch.setattr(DataStreamWriter, "foreachBatch", lambda self, f: plain(self, lambda b, n: (f(b, n), f(b, n))[0]))
    ST.start_ledger_stream(followed, f"{folder}/arriving", f"{folder}/checkpoint", every=None).awaitTermination()
    assert followed.rows("queue_events").count() == 2
    assert rows(followed.read("write_queue"), "workload_id", "attempts") == [("1", 1), ("2", None), ("3", None)]


def test_the_streams_state_stays_bounded(spark, make, folder, followed):
    arriving = f"{folder}/arriving"
    sizes = []
    for step in range(4):
        found = outcome(make, "1", C.FAILED, 200 * step)
        for i in range(20):
            found = found.unionByName(outcome(make, f"x{i}", C.FAILED, 200 * step + i))
        T.append_table(found, "outcomes", arriving)
        query = ST.start_ledger_stream(followed, arriving, f"{folder}/checkpoint", every=None)
        query.awaitTermination()
        sizes.append(query.lastProgress.stateOperators[0].numRowsTotal)
    assert max(sizes) <= 42


def test_replayed_round_overwrites_itself(spark, make, folder):
    keep = ST._keep_round(folder)
    for _ in range(2):
        keep(outcome(make, "1", C.SUCCEEDED, 1), 4)
    queue = make("write_queue", intent("1"))
    assert rows(ST.current_queue(queue, folder), "status", "attempts") == [(C.SUCCEEDED, 1)]


def test_stream_on_a_timer(spark, make, folder):
    arriving = f"{folder}/arriving"
    T.append_table(outcome(make, "1", C.SUCCEEDED, 1), "outcomes", arriving)
    query = ST.start_status_stream(spark, arriving, f"{folder}/rounds", f"{folder}/checkpoint", every="1 seconds")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert rows(ST.current_queue(make("write_queue", intent("1")), f"{folder}/rounds"), "status") == [(C.SUCCEEDED,)]


def test_work_folder(spark, folder):
    first, second = (work_folder(spark, "x") for _ in range(2))
    assert first != second and "/x-" in first
    assert first.startswith(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir"))
