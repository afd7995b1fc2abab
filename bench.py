"""Time the headline queries and print one JSON line.

The engine's input tables are derived from $BENCH_SF_DIR and stored first, as
the reports are meant to run on stored tables; that set-up is not timed. The
summary build is timed from stored usage to stored summary, the rest from
stored tables to the last row. Each query runs once to warm up and then
$BENCH_RUNS times (default 3); the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tagledger.operators import (  # noqa: E402
    apply as A, batches as B, inventory as I, queue as Q, reports as R, rollback as RB,
    rule_impact as RI, suggestions as SG, summary as S, validate as V,
)
from tagledger import constants as C  # noqa: E402
from tagledger.plans.ledger import Ledger  # noqa: E402
from tagledger.plans.session import local_session, work_folder  # noqa: E402
from tagledger.sources import tables  # noqa: E402
from verification import fixtures as X  # noqa: E402
from verification.fixtures import AS_OF, NOW, RULES  # noqa: E402

KEY, DAYS, RUN, BATCH = "cost_center", 30, "run-1", "batch-0"
INPUTS = {
    "usage": X.usage, "list_prices": X.list_prices, "suggestions": X.suggestions,
    "write_queue": X.queue, "tag_state": X.tag_state, "audit": X.audit, "inventory": X.inventory,
}


def drain(df) -> None:
    """Compute every row and column without keeping them."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    base = work_folder(spark, "bench")
    opened = {}

    def t(name: str):
        """A stored table, opened once as a service would."""
        if name not in opened:
            opened[name] = tables.read_table(spark, name, f"{base}/{name}")
        return opened[name]

    def build_summary() -> None:
        tables.replace_table(
            S.daily_summary(t("usage"), t("list_prices"), AS_OF), "summary", f"{base}/summary")
        opened.pop("summary", None)

    for name, build in INPUTS.items():
        tables.replace_table(build(spark, sf).repartition(int(cpus)), name, f"{base}/{name}")

    def claimed():
        return t("write_queue").filter(Q.claimable(NOW))

    def candidates():
        return SG.suggestion_candidates(
            t("summary"), t("suggestions"), t("write_queue"), KEY, 0.8, AS_OF, DAYS)

    frames = {
        "kpi_live": lambda: R.kpi_live(t("summary"), t("write_queue"), KEY, AS_OF, DAYS),
        "by_product": lambda: R.by_product(t("summary"), [KEY], AS_OF, DAYS),
        "not_taggable": lambda: R.not_taggable_breakdown(t("summary"), KEY, AS_OF, DAYS),
        "field_values": lambda: R.distinct_field_values(
            t("summary"), "name", AS_OF, DAYS, limit=C.FIELD_VALUE_LIMIT),
        "rule_impact": lambda: RI.rule_impact(
            t("summary"), t("write_queue"), [KEY], RULES, AS_OF, DAYS),
        "rule_sample": lambda: RI.rule_sample(
            t("summary"), t("write_queue"), [KEY], RULES, AS_OF, DAYS, limit=C.RULE_SAMPLE_LIMIT),
        "score_workloads": lambda: SG.score_workloads(
            SG.scoring_workloads(t("summary"), AS_OF), NOW, list(X.TEAM_WORDS), SG.keyword_scorer(X.TEAM_WORDS)),
        "suggestion_impact": lambda: SG.suggestion_impact(candidates()),
        "suggestion_list": lambda: SG.suggestion_list(candidates(), C.SUGGESTION_LIMIT),
        "enqueue_rules": lambda: Q.enqueue_rules(
            t("summary"), t("write_queue"), RULES, [KEY], AS_OF, DAYS, "batch-new", "me", NOW),
        "auto_tag": lambda: Q.auto_tag(
            t("summary"), t("suggestions"), t("write_queue"), KEY, AS_OF, DAYS, "batch-new", "me",
            NOW, rules=RULES),
        "claim": lambda: Q.claim(t("write_queue"), NOW, RUN),
        "apply_attempts": lambda: A.attempts(claimed(), t("tag_state"), dry_run=False),
        "rollback_plan": lambda: RB.rollback_plan(t("audit"), BATCH),
        "recent_batches": lambda: B.recent_batches(t("write_queue"), C.BATCH_LIMIT),
        "failure_breakdown": lambda: B.batch_failure_breakdown(t("write_queue"), BATCH, C.FAILURE_REASON_LIMIT),
        "inventory_report": lambda: I.inventory_report(t("inventory")),
        "tag_violations": lambda: V.tag_violations(X.tag_payloads(spark, sf), ["doc_id"]),
    }
    held = []

    def fill_ledger() -> None:
        """Set-up of each drain: a ledger with the queue and the state as they were."""
        held.append(Ledger(spark, f"{base}/ledger-{len(held)}"))
        held[-1].create()
        held[-1].append("write_queue", t("write_queue"))
        held[-1].store_state(t("tag_state"))

    set_up = {"drain_batch": fill_ledger}
    jobs = {
        "summary_build": build_summary,
        "drain_batch": lambda: held[-1].drain(NOW, RUN, "me", dry_run=False, batch_id=BATCH),
        "rollback_batch": lambda: held[-1].rollback(BATCH, NOW, RUN, "me", dry_run=False),
    }
    jobs.update({name: (lambda make=make: drain(make())) for name, make in frames.items()})
    seconds = {}
    for name, job in jobs.items():
        prepare = set_up.get(name, lambda: None)
        prepare()
        job()
        taken = []
        for _ in range(runs):
            prepare()
            start = time.perf_counter()
            job()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
    print(json.dumps({
        "metric": "sum of median seconds over the headline queries",
        "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": sf.rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
