"""Incremental translation that survives a stop or a crash at any point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from bookflow.config import JobConfig
from bookflow.operators.matching import bounded_broadcast
from bookflow.operators.translate import Translator, translate_batch
from bookflow.schemas import ATTEMPTS, CACHE, names
from bookflow.session import PACKED, materialize
from bookflow.streaming.state import earlier, last_batch, read_batches, read_keyed, write_batch, write_keyed

KEYS = ["job_id", "segment_id"]
PLACE = ["chapter_index", "segment_index", "fingerprint"]
FINISHED = ("completed", "cached")
# A job's segments share a bucket: a batch of few jobs reads little.
JOB = ["job_id"]
FINISHED_KEYS = "job_id string, segment_id string"
# Batches are stored under multiples of this; a start's own steps take the numbers between them.
STARTS = 1_000_000

RESULTS = (
    "job_id string, segment_id string, fingerprint string, status string, "
    "translated_text string, attempts int, error string, usage string, completed_at timestamp"
)


def stream_translate(
    source: DataFrame,
    state: str,
    checkpoint: str,
    cfg: JobConfig,
    fn: Translator | None = None,
    now: Column | None = None,
    retry_failed: bool = False,
    **options,
) -> StreamingQuery:
    """Translate the segments of a stream (which carry their ``fingerprint``) into ``state``.

    A batch skips segments that an earlier one finished and reuses its texts by fingerprint. Segments
    that it leaves undone stay in a queue: every batch, and every start before its first batch, takes
    the pending ones again, and with ``retry_failed`` the failed ones too. Output goes to folders named
    after the batch, and committed calls are read back instead of repeated, so a replay has the effect
    of one run. What earlier steps finished and cached is kept in buckets of jobs and of fingerprints;
    a step reads the buckets of its own rows.
    """
    spark, schema = source.sparkSession, source.schema
    stamp = F.current_timestamp() if now is None else now

    def step(new: DataFrame | None, number: int) -> None:
        session = spark if new is None else new.sparkSession
        waiting = _queue(session, state, schema, number)
        again = waiting.filter(F.col("status").isin(*retried)).drop("status")
        taken = again if new is None else _with_fresh(again, materialize(new, "arrived", **PACKED))
        # only the buckets of this step's jobs and fingerprints are read
        every = taken.select("job_id").unionByName(waiting.select("job_id"))
        done = earlier(read_keyed(session, f"{state}/finished", FINISHED_KEYS, every, JOB), number)
        # joins are made on keys; the texts follow where a row of theirs is written
        todo = materialize(taken.select(*KEYS, *PLACE).join(done, KEYS, "left_anti"), "todo")
        cache = _entries(todo, state, number)
        work = f"{state}/work/batch={number}"
        out = translate_batch(todo, cache, cfg, stamp, fn, path=work, texts=taken, **options)
        write_batch(out.attempts, f"{state}/attempts", number)
        write_keyed(out.entries, f"{state}/cache", number, ["key"])
        write_batch(out.results, f"{state}/results", number)
        made = read_batches(session, f"{state}/results", RESULTS, [number])
        ended = made.filter(F.col("status").isin(*FINISHED)).select(*KEYS)
        write_keyed(ended, f"{state}/finished", number, JOB)
        undone = made.filter(~F.col("status").isin(*FINISHED)).select(*KEYS, "status")
        queue = session.createDataFrame([], _queued(schema))
        if not undone.isEmpty():
            queue = queue.unionByName(taken.join(bounded_broadcast(undone), KEYS).select(*queue.columns))
        kept = waiting.join(made, KEYS, "left_anti").join(done, KEYS, "left_anti")
        if not kept.select(*KEYS).isEmpty():
            queue = queue.unionByName(kept.select(*queue.columns))
        write_batch(queue, f"{state}/queue", number)

    retried = ["pending", *(["failed"] if retry_failed else [])]
    last = last_batch(spark, f"{state}/queue")
    if last is not None and not _queue(spark, state, schema).filter(F.col("status").isin(*retried)).isEmpty():
        step(None, last + 1)

    def run(batch: DataFrame, batch_id: int) -> None:
        step(batch, (batch_id + 1) * STARTS)

    return (
        source.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _with_fresh(again: DataFrame, arrived: DataFrame) -> DataFrame:
    """The segments that arrived, each key once, and those of ``again`` that did not."""
    fresh = arrived
    if not arrived.groupBy(*KEYS).count().filter("count > 1").isEmpty():
        fresh = materialize(arrived.dropDuplicates(KEYS), "fresh", **PACKED)
    if again.isEmpty():
        return fresh
    return materialize(fresh.unionByName(again.join(fresh, KEYS, "left_anti")), "taken", **PACKED)


def _entries(todo: DataFrame, state: str, number: int) -> DataFrame:
    """The cache entries of ``todo``'s fingerprints; keys decide which texts are read."""
    session = todo.sparkSession
    wanted = todo.select(F.col("fingerprint").alias("key"))
    stored = earlier(read_keyed(session, f"{state}/cache", CACHE, wanted, ["key"]), number)
    hits = materialize(stored.select("key").join(wanted, "key", "left_semi").distinct(), "hits")
    if hits.isEmpty():
        return session.createDataFrame([], CACHE)
    return stored.join(hits, "key", "left_semi")


def _queued(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("status", StringType())])


def _queue(spark: SparkSession, state: str, schema: StructType, before: int | None = None) -> DataFrame:
    """The segments that the last step (before one of that number) left undone, with their status."""
    last = last_batch(spark, f"{state}/queue", before)
    if last is None:
        return spark.createDataFrame([], _queued(schema))
    return spark.read.parquet(f"{state}/queue/batch={last}").select(*schema.names, "status")


def read_results(spark: SparkSession, state: str) -> DataFrame:
    """The latest result of each segment: a later batch wins."""
    rows = read_batches(spark, f"{state}/results", RESULTS)
    ended = F.col("status").isin(*FINISHED)
    # a finished segment is not taken again: its one finished row is its latest and needs no grouping
    finished, last = F.max(F.when(ended, F.col("batch"))), F.max("batch")
    late = rows.groupBy(*KEYS).agg(F.count_if(ended).alias("n"), (last > finished).alias("later"))
    if not late.filter("n > 1 or later").isEmpty():
        return _latest(rows)
    open_ = _latest(rows.filter(~ended)).alias("o")
    keys = rows.filter(ended).select(*KEYS).alias("f")
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"f.{k}")) for k in KEYS]
    return rows.filter(ended).drop("batch").unionByName(open_.join(keys, same, "left_anti"))


def _latest(rows: DataFrame) -> DataFrame:
    fields = [c for c in names(RESULTS) if c not in KEYS]
    newest = rows.groupBy(*KEYS).agg(F.max_by(F.struct(*fields), "batch").alias("r"))
    return newest.select(*KEYS, "r.*")


def read_attempts(spark: SparkSession, state: str) -> DataFrame:
    return read_batches(spark, f"{state}/attempts", ATTEMPTS).drop("batch")
