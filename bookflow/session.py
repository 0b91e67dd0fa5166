"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "bookflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators were tuned for; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # row work on texts is heavy for its bytes: small shuffles keep a partition for every core
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # books are wide rows: smaller Arrow batches keep Python workers within memory
        "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    Only a session with a local master, whose tasks run on this machine, may name no such folder and
    gets one of its own; elsewhere other machines would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not is_local(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="bookflow-")
        spark.sparkContext.setCheckpointDir(root)
    folder = f"{root.rstrip('/')}/bookflow/{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


_MADE: dict[str, list[str]] = {}


def is_local(master: str) -> bool:
    return re.fullmatch(r"local(\[.*\])?", master) is not None


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders that this application has made; tables read from them end with it."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for folder in made:
        _delete(spark, folder)
    return len(made)


def drop_scratch(spark: SparkSession, folder: str) -> None:
    """Delete one folder of ``scratch_dir`` that nothing reads any more."""
    _MADE[spark.sparkContext.applicationId].remove(folder)
    _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def wide_rows(spark: SparkSession) -> Iterator[None]:
    """For jobs that pass wide rows on through files: what runs inside deletes its shuffle files as each job
    ends, not when the driver's memory is cleaned, and hands Python small batches."""
    held = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "256"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# Texts that are kept in several folders are packed more tightly than by default.
PACKED = {"compression": "zstd"}


def materialize(df: DataFrame, name: str, path: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back, so that no later branch, retry or
    re-plan evaluates it again.

    With a ``path`` of the caller's own, a committed earlier write is read instead of repeated.
    ``options`` are the writer's.
    """
    spark = df.sparkSession
    target = f"{path or scratch_dir(spark)}/{name}"
    if path is None or not is_committed(spark, target):
        df.write.mode("overwrite").options(**options).parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def is_committed(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has finished."""
    # the readers skip files with a leading underscore, so the file system is asked
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)
