"""Batch folders: state as one folder per micro-batch, so a replayed batch replaces itself."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.session import PACKED, is_committed

# Folders that a keyed batch is dealt over, by a hash of its keys.
BUCKETS = 256


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").options(**PACKED).parquet(f"{path}/batch={batch_id}")


def write_keyed(df: DataFrame, path: str, batch_id: int, keys: list[str]) -> None:
    """A batch with a folder for each bucket of keys, for readers that look up some keys."""
    bucketed = df.withColumn("bucket", bucket_of(keys))
    writer = bucketed.repartition("bucket").write.mode("overwrite").options(**PACKED)
    writer.partitionBy("bucket").parquet(f"{path}/batch={batch_id}")


def bucket_of(keys: list[str]):
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def read_batches(spark: SparkSession, path: str, schema: str, batches: Iterable[int] | None = None) -> DataFrame:
    """All batches below ``path``, or those of some numbers that are there, with their number as
    ``batch``; empty before the first. Named batches are found without listing the others."""
    full = f"{schema}, batch long"
    try:
        if batches is None:
            return spark.read.schema(full).parquet(path)
        there = [p for p in (f"{path}/batch={b}" for b in batches) if is_committed(spark, p)]
        if there:
            return spark.read.schema(full).option("basePath", path).parquet(*there)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.createDataFrame([], full)


def read_keyed(spark: SparkSession, path: str, schema: str, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of all batches that share a bucket with a row of ``wanted``; other buckets are not read."""
    rows = read_batches(spark, path, f"{schema}, bucket int")
    found = [r["b"] for r in wanted.select(bucket_of(keys).alias("b")).distinct().collect()]
    return rows.filter(F.col("bucket").isin(found)).drop("bucket")


def last_batch(spark: SparkSession, path: str, before: int | None = None) -> int | None:
    """The number of the newest batch folder (below ``before``); only folder names are read."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return None
    folders = [f.getPath().getName() for f in files.listStatus(root)]
    numbers = sorted((int(n.removeprefix("batch=")) for n in folders if n.startswith("batch=")), reverse=True)
    # an unfinished write has no marker and does not count
    wanted = (n for n in numbers if before is None or n < before)
    return next((n for n in wanted if is_committed(spark, f"{path}/batch={n}")), None)


def earlier(df: DataFrame, batch_id: int) -> DataFrame:
    return df.filter(F.col("batch") < batch_id).drop("batch")
