"""Live progress of jobs from a stream of attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bookflow.operators.work import STATUSES, job_outcome, percent
from bookflow.session import materialize
from bookflow.streaming.state import bucket_of, last_batch, read_batches, write_batch, write_keyed

KEYS = ["job_id", "segment_id"]
# The newest attempt of a segment: microseconds and number decide.
SEGMENT = "job_id string, segment_id string, at long, attempt long, status string"
CHANGE = "job_id string, status string, n long"
# Batches of changes after which their sums are written anew.
FOLD = 32


def stream_progress(attempts: DataFrame, state: str, checkpoint: str, fold: int = FOLD) -> StreamingQuery:
    """Keep the counts of each job's segments by their newest status in ``state``.

    Newest is decided by time and attempt number: late rows never undo a later status. A batch is reduced to
    the newest row of each of its segments, and reads the buckets of those segments from what came before:
    all segments as of the last fold, and the batches since. It writes its segments and by how much counts
    change; after ``fold`` batches both are written anew, so a batch reads at most ``fold`` batches and a reader
    of the counts meets one row per job and status and at most ``fold`` batches of changes.
    """
    lowest = F.lit(-(1 << 62))
    rows = attempts.select(
        *KEYS,
        F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), lowest).alias("at"),
        F.coalesce(F.col("attempt").cast("long"), lowest).alias("attempt"),
        "status",
    )

    def keep(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        fresh = materialize(_newest(batch), "fresh")
        moved = materialize(_moved(fresh, _before(session, state, fresh, batch_id)), "moved")
        write_keyed(moved.select(*KEYS, "new.*"), f"{state}/newest", batch_id, KEYS)
        steps = F.array(
            F.struct(F.col("old.status").alias("status"), F.when(F.col("old").isNotNull(), -1).alias("n")),
            F.struct(F.col("new.status").alias("status"), F.lit(1).alias("n")),
        )
        changes = moved.select("job_id", F.explode(steps).alias("s")).select("job_id", "s.status", F.col("s.n").cast("long").alias("n"))
        write_batch(_summed(changes.filter("n is not null")), f"{state}/changes", batch_id)
        folded = last_batch(session, f"{state}/sums", batch_id)
        if batch_id - (-1 if folded is None else folded) >= fold:
            # the segments first: what was folded is found by the sums
            every = _newest(_segments(session, state, batch_id + 1))
            write_keyed(every, f"{state}/segments", batch_id, KEYS)
            write_batch(_summed(_counts(session, state, batch_id)), f"{state}/sums", batch_id)

    return (
        rows.writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _newest(rows: DataFrame) -> DataFrame:
    """The newest row of each segment."""
    newest = F.max(F.struct("at", "attempt", "status")).alias("r")
    return rows.groupBy(*KEYS).agg(newest).select(*KEYS, "r.*")


def _moved(fresh: DataFrame, before: DataFrame) -> DataFrame:
    """``KEYS, old, new`` of the segments that have a newer row in ``fresh``; ``old`` is null for a first one."""
    value = F.struct("at", "attempt", "status")
    both = fresh.select(*KEYS, F.lit(True).alias("is_new"), value.alias("r")).unionByName(
        before.select(*KEYS, F.lit(False).alias("is_new"), value.alias("r"))
    )
    pair = both.groupBy(*KEYS).agg(
        F.max(F.when(~F.col("is_new"), F.col("r"))).alias("old"), F.max(F.when(F.col("is_new"), F.col("r"))).alias("new")
    )

    def order(c: str):
        return F.struct(f"{c}.at", f"{c}.attempt")

    return pair.filter(F.col("new").isNotNull() & (F.col("old").isNull() | (order("new") > order("old"))))


def _segments(spark: SparkSession, state: str, before: int) -> DataFrame:
    """Newest rows of segments and of their buckets, of which the newest is the state before a batch."""
    kept = f"{SEGMENT}, bucket int"
    folded = last_batch(spark, f"{state}/segments", before)
    last = last_batch(spark, f"{state}/newest", before)
    since = -1 if folded is None else folded
    new = read_batches(spark, f"{state}/newest", kept, range(since + 1, -1 if last is None else last + 1))
    if folded is None:
        return new.drop("batch")
    return read_batches(spark, f"{state}/segments", kept, [folded]).unionByName(new).drop("batch")


def _before(spark: SparkSession, state: str, fresh: DataFrame, batch_id: int) -> DataFrame:
    """The rows of ``_segments`` in the buckets of the fresh ones."""
    found = [r["b"] for r in fresh.select(bucket_of(KEYS).alias("b")).distinct().collect()]
    return _segments(spark, state, batch_id).filter(F.col("bucket").isin(found))


def _summed(changes: DataFrame) -> DataFrame:
    return changes.groupBy("job_id", "status").agg(F.sum("n").alias("n"))


def _counts(spark: SparkSession, state: str, upto: int | None = None) -> DataFrame:
    """CHANGE rows whose sums are the counts after a batch (default: the last): sums before it, and later changes."""
    before = None if upto is None else upto
    folded = last_batch(spark, f"{state}/sums", before)
    last = last_batch(spark, f"{state}/changes", None if upto is None else upto + 1)
    if last is None:
        return spark.createDataFrame([], CHANGE)
    since = -1 if folded is None else folded
    new = read_batches(spark, f"{state}/changes", CHANGE, range(since + 1, last + 1))
    if folded is None:
        return new.drop("batch")
    return read_batches(spark, f"{state}/sums", CHANGE, [folded]).unionByName(new).drop("batch")


def read_progress(spark: SparkSession, state: str) -> DataFrame:
    """Progress and outcome of each job as of the last finished batch."""
    counts = _summed(_counts(spark, state))

    def of(status: str):
        return F.coalesce(F.sum(F.when(F.col("status") == status, F.col("n"))), F.lit(0)).alias(status)

    total = F.sum("n").alias("total")
    done = F.col("completed") + F.col("cached")
    counted = counts.groupBy("job_id").agg(total, *[of(s) for s in STATUSES]).withColumn("done", done)
    prog = counted.withColumn("percent", percent(F.col("done"), F.col("total")))
    outcome = job_outcome(prog).withColumnRenamed("status", "outcome")
    return prog.join(outcome, "job_id")
