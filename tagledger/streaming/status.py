"""Outcomes arrive as files while a run goes on; the queue follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tagledger.constants import PENDING, RUNNING
from tagledger.operators.apply import apply_outcomes, newest_outcomes
from tagledger.plans.ledger import Ledger
from tagledger.schemas import OUTCOMES, QUEUE_KEY
from tagledger.sources.changelog import TRIED

ROUND = "round"


def _keep_round(folder: str):
    def keep(batch: DataFrame, batch_id: int) -> None:
        """Keep the newest outcome per queue row of one micro-batch. A batch
        that is replayed overwrites its own directory and nothing else."""
        newest_outcomes(batch).write.mode("overwrite").parquet(f"{folder}/{ROUND}={batch_id}")

    return keep


def start_status_stream(spark: SparkSession, arriving: str, folder: str, checkpoint: str,
                        every: str | None = "2 seconds",
                        files_per_round: int | None = None) -> StreamingQuery:
    """Follow outcome files in ``arriving``. ``every=None`` takes what is there
    and stops. Each micro-batch writes only its own outcomes, so its cost does
    not grow with the queue."""
    reader = spark.readStream.schema(OUTCOMES)
    if files_per_round:
        reader = reader.option("maxFilesPerTrigger", files_per_round)
    writer = (
        reader.parquet(arriving).writeStream
        .foreachBatch(_keep_round(folder))
        .option("checkpointLocation", checkpoint)
    )
    timed = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return timed.start()


def _rounds(spark: SparkSession, folder: str, after: int) -> DataFrame:
    rounds = spark.read.schema(f"{_ddl()}, {ROUND} LONG").parquet(folder)
    return rounds.filter(F.col(ROUND) > after)


def _open() -> Column:
    return F.col("status").isin(PENDING, RUNNING)


def current_queue(queue: DataFrame, folder: str, after: int = -1) -> DataFrame:
    """The queue snapshot with the outcomes of all rounds after ``after``. Only rows that are still open can
    have one, so settled rows are not shuffled."""
    return apply_outcomes(queue, _rounds(queue.sparkSession, folder, after), round_column=ROUND, among=_open())


def start_ledger_stream(ledger: Ledger, arriving: str, checkpoint: str, every: str | None = "2 seconds",
                        files_per_round: int | None = None, late: str = "1 hour") -> StreamingQuery:
    """Follow outcome files into a ledger's queue. An outcome that is reported again within ``late`` of its time is
    dropped by the stream's state, which holds no more than that span of keys. One that arrives later than that behind
    the newest is not taken: its row is open to be claimed again after half an hour, so ``late`` should
    not be shorter. Each round appends one event per row to the ledger, under the stream's name and the round's number; a
    round that is replayed appends the same events, which count once, whatever has been compacted meanwhile."""
    reader = ledger.spark.readStream.schema(OUTCOMES)
    if files_per_round:
        reader = reader.option("maxFilesPerTrigger", files_per_round)
    fresh = reader.parquet(arriving).withWatermark("executed_at", late).dropDuplicatesWithinWatermark(
        [*QUEUE_KEY, "status", "executed_at"])

    def take(batch: DataFrame, number: int) -> None:
        told = newest_outcomes(batch)
        ledger.append("queue_events", told.select(
            *QUEUE_KEY, F.col("executed_at").alias("at"), F.lit(TRIED).alias("rank"), "status", "last_error", "executed_at",
            F.array(F.lit(f"{checkpoint}#{number}")).alias("tries")))

    writer = fresh.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _ddl() -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in OUTCOMES.fields)
