import datetime as dt
from decimal import Decimal as D

from conftest import NOW, rows
from tagledger import constants as C
from tagledger.operators import batches as B


def row(batch, wid, status, error=None, product="JOBS", minutes=0, cost="1.4"):
    return dict(batch_id=batch, workload_id=wid, status=status, last_error=error, product=product,
                enqueued_at=NOW + dt.timedelta(minutes=minutes), requested_by="me", list_cost=D(cost), tag_key="k")


def test_rollup_progress_and_count(make):
    queue = make(
        "write_queue", *[row("b1", str(i), s) for i, s in enumerate(C.QUEUE_STATUSES)],
        row("b1", "0", C.SUCCEEDED, product="SQL"), row("b2", "1", C.SUCCEEDED, minutes=5),
        row("b2", "2", C.FAILED, minutes=4), row("b3", "1", C.ROLLED_BACK, minutes=3),
        row("b3", "2", C.SUCCEEDED, minutes=3), row("b3", "3", C.SUCCEEDED, minutes=3))
    found = B.recent_batches(queue)
    assert [r["batch_id"] for r in found.collect()] == ["b2", "b3", "b1"]
    assert tuple(found.collect()[2])[3:] == (8, 7, D("11"), 1, 1, 2, 1, 1, 1, 1)
    assert B.recent_batches(queue, 1).count() == 1
    assert rows(B.batch_progress(found), "batch_id", "pct", "reverting", "in_flight", "residual", "not_tagged") == [
        ("b1", 33, True, True, False, 2), ("b2", 50, False, False, False, 1), ("b3", 33, True, False, True, 0)]
    assert rows(B.count_queue_rows(queue, "b1")) == [(8,)]
    assert rows(B.count_queue_rows(queue, "b1'; --")) == [(0,)]


def test_reasons_are_grouped_by_their_class(make):
    queue = make(
        "write_queue", row("b", "1", C.FAILED, "PermissionDenied: job 1"), row("b", "2", C.FAILED, "PermissionDenied : job 2"),
        row("b", "3", C.FAILED, None), row("b", "4", C.FAILED, " : x"), row("b", "5", C.UNSUPPORTED, "no way"),
        row("b", "6", C.SUCCEEDED, "old"), row("c", "7", C.FAILED, "x"))
    assert rows(B.batch_failure_breakdown(queue, "b"), "status", "reason", "rows", "cost", "sample_reason") == [
        (C.FAILED, "PermissionDenied", 2, D("3"), "PermissionDenied : job 2"),
        (C.FAILED, "unknown", 2, D("3"), " : x"), (C.UNSUPPORTED, "no way", 1, D("1"), "no way")]
