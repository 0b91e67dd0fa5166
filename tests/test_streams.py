"""What a batch of a long stream reads."""

import random
import re

from pyspark.sql import functions as F

from bookflow.operators.work import latest_status, progress
from bookflow.streaming import progress as P
from bookflow.streaming.state import read_batches, read_keyed, write_keyed

ATTEMPTS = "job_id string, segment_id string, attempt int, status string, ts timestamp"


def test_progress_after_many_batches(spark, tmp_path):
    """A reader meets the sums and a bounded number of batches, however many there were."""
    rng = random.Random(7)
    rows = [
        (f"j{rng.randrange(3)}", f"s{rng.randrange(12)}", n, rng.choice(["running", "completed", "failed", "odd"]))
        for n in range(120)
    ]
    source, state, mark = (str(tmp_path / n) for n in ("in", "state", "mark"))
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        frame = spark.createDataFrame(rows, "job_id string, segment_id string, attempt int, status string")
        timed = frame.withColumn("ts", F.timestamp_seconds(F.col("attempt") % 40))
        timed.withColumn("part", F.monotonically_increasing_id() % 40).repartition(1).write.partitionBy("part").parquet(source)
        read = []
        for _ in range(2):  # the second start finds nothing new
            stream = spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", "1").parquet(source)
            P.stream_progress(stream, state, mark, fold=4).awaitTermination()
            read.append(len(P._counts(spark, state).inputFiles()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    batches = len(list((tmp_path / "state" / "changes").iterdir()))
    assert batches >= 20 and max(read) <= 6
    fields = ["job_id", "total", "running", "completed", "failed", "done", "percent"]
    want = progress(latest_status(timed)).select(fields)
    assert sorted(P.read_progress(spark, state).select(fields).collect()) == sorted(want.collect())


def test_keyed_batches_are_read_by_bucket(spark, tmp_path):
    path = str(tmp_path / "state")
    for n in range(3):
        rows = spark.range(300).select((F.col("id") + 300 * n).cast("string").alias("key"), F.lit(n).alias("n"))
        write_keyed(rows, path, n, ["key"])
    wanted = spark.createDataFrame([("5",), ("700",), ("nowhere",)], "key string")
    got = read_keyed(spark, path, "key string, n int", wanted, ["key"])
    assert {(r.key, r.n) for r in got.join(wanted, "key").collect()} == {("5", 0), ("700", 2)}
    assert got.count() < 30
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=|INSET)", plan)


def test_named_batches(spark, tmp_path):
    path = str(tmp_path / "state")
    assert read_batches(spark, path, "key string").count() == 0
    assert read_batches(spark, path, "key string", [1, 2]).count() == 0
    write_keyed(spark.createDataFrame([("a",)], "key string"), path, 2, ["key"])
    assert [(r.key, r.batch) for r in read_batches(spark, path, "key string", [1, 2]).collect()] == [("a", 2)]


def test_progress_reads_the_segments_of_few_batches(spark, tmp_path):
    """A batch meets the last fold and the batches since, in its own buckets; late and repeated rows change nothing."""
    source, state, mark = (str(tmp_path / n) for n in ("in", "state", "mark"))
    rows = [("j", "a", 1, "running"), ("j", "a", 3, "failed"), ("j", "a", 2, "completed"), (None, None, 1, None), ("j", "b", 1, "running")]
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        for row in rows:
            frame = spark.createDataFrame([row], "job_id string, segment_id string, attempt int, status string")
            timed = frame.withColumn("ts", F.timestamp_seconds(F.lit(5))).coalesce(1)
            timed.write.mode("append").parquet(source)
            stream = spark.readStream.schema(ATTEMPTS).parquet(source)
            P.stream_progress(stream, state, mark, fold=2).awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    batches = {re.search(r"/(\w+/batch=\d+)/", f)[1] for f in P._segments(spark, state, 4).inputFiles()}
    assert batches == {"segments/batch=3"}
    wanted = spark.createDataFrame([("j", "b")], "job_id string, segment_id string")
    assert {r.segment_id for r in P._before(spark, state, wanted, 5).collect()} == {"b"}
    got = {r.job_id: (r.total, r.running, r.failed, r.completed) for r in P.read_progress(spark, state).collect()}
    assert got == {"j": (2, 1, 1, 0), None: (1, 0, 0, 0)} or got == {"j": (2, 1, 1, 0)}
