"""Small helpers that several operators of this package share."""

from __future__ import annotations

import gc
import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Batches = Iterator[pa.RecordBatch]
#: Texts that a function gets at once.
ROWS = 1024


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n`` (null id: null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def memos() -> dict[str, dict]:
    """The memos that this worker process keeps between tasks, by operator.

    Functions travel by value and get new globals in every task; only what ``sys.modules`` holds stays.
    """
    return sys.modules.setdefault(name := "bookflow memos", ModuleType(name)).__dict__.setdefault("held", {})


def only_memo(owner: str, memo: dict) -> None:
    """Keep this memo and empty all others: a worker process outlives its tasks and would keep them all."""
    held = memos()
    if len(held) != 1 or held.get(owner) is not memo:
        for other in held.values():
            if other is not memo:
                other.clear()
        held.clear()
        held[owner] = memo


def map_rows(df: DataFrame, schema: str | StructType, fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """``mapInArrow`` for functions that turn some rows into one batch; few rows at once bound the memory."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield fn(batch.slice(at, ROWS))

    return df.mapInArrow(run, schema)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of results that have been written and are read back instead.

    It does so once their plans are garbage, which a driver with much free memory may not notice for
    long; an operator that writes several large steps asks for it between them.
    """
    gc.collect()
    spark._jvm.System.gc()


def runs(batches: Batches, key: str) -> Iterator[pa.Table]:
    """Cut a partition that is sorted by ``key`` into tables that hold whole groups.

    A group may span batches; the last group of each batch waits for the next one.
    """
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if kept and kept[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(kept)
            kept = []
        change = np.flatnonzero(keys[1:] != keys[:-1])
        if len(change):
            cut = int(change[-1]) + 1
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)])
            kept = [batch.slice(cut)]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept)


def borders(keys: np.ndarray) -> np.ndarray:
    """Positions where a new group starts in sorted ``keys``, with the length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
