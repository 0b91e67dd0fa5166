"""Running a translator over segments: cache first, one call per distinct request, retries."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow import constants as C
from bookflow.config import JobConfig
from bookflow.functions.text import clip_error, demo_translate, js_trim
from bookflow.operators.cache import cache_lookup, new_entries
from bookflow.operators.matching import fits
from bookflow.operators.work import dedupe_work
from bookflow.schemas import SEG_KEYS
from bookflow.session import PACKED, materialize

# request fields -> (text, usage); raises on failure
Translator = Callable[[dict], "tuple[str, str | None]"]

# Hashes of shared calls, 8 bytes each, that may be sent to every task.
MARKS = 1_000_000

_LOG = "array<struct<attempt:int,status:string,error:string,ts:timestamp>>"
_CALL_NAMES = ["fingerprint", "translated_text", "usage", "error", "log"]
_CALL_SCHEMA = f"fingerprint string, translated_text string, usage string, error string, log {_LOG}"


class TranslateError(Exception):
    """A failed call; ``retryable`` wins over ``status`` when it is set."""

    def __init__(self, message: str, status: int | None = None, retryable: bool | None = None):
        super().__init__(message)
        self.status = status
        self.retryable = retryable


def _may_retry(error: Exception) -> bool:
    flag = getattr(error, "retryable", None)
    if flag is not None:
        return bool(flag)
    status = getattr(error, "status", None)
    return not status or status == 429 or status >= 500


def _backoff_seconds(attempt: int) -> float:
    return (min(30000, 1000 * 2 ** (attempt - 1)) + random.randrange(400)) / 1000


def with_retries(
    fn: Translator, max_retries: int = 2, sleep: Callable[[float], None] = time.sleep
) -> Callable[[dict], dict]:
    """A call that never raises: the outcome and every attempt become data."""

    def call(request: dict) -> dict:
        log: list[dict] = []
        while True:
            attempt = len(log) + 1
            entry = {"attempt": attempt, "status": "completed", "error": None}
            entry["ts"] = datetime.now(timezone.utc)
            log.append(entry)
            try:
                text, usage = fn(request)
                return {"translated_text": text or "", "usage": usage, "error": None, "log": log}
            except Exception as error:  # noqa: BLE001 - a failing segment must not fail its task
                entry["status"], entry["error"] = "failed", str(error)[: C.ERROR_CHARS]
                if attempt > max_retries or not _may_retry(error):
                    return {
                        "translated_text": None,
                        "usage": None,
                        "error": entry["error"],
                        "log": log,
                    }
            sleep(_backoff_seconds(attempt))

    return call


def translate(
    requests: DataFrame,
    fn: Translator,
    max_retries: int = 2,
    partitions: int | None = None,
    concurrency: int = 1,
    sleep: Callable[[float], None] = time.sleep,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Call ``fn`` once per row of ``requests`` (which has a ``fingerprint``).

    The number of partitions times ``concurrency`` bounds the calls in flight. A call's row starts
    with the columns that ``keep`` names.
    """
    n = partitions or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    call = with_retries(fn, max_retries, sleep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                rows = batch.to_dict("records")
                done = [
                    {**{c: row[c] for c in keep}, "fingerprint": row["fingerprint"], **result}
                    for row, result in zip(rows, pool.map(call, rows))
                ]
                yield pd.DataFrame(done, columns=[*keep, *_CALL_NAMES], dtype=object)

    kinds = dict(requests.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), _CALL_SCHEMA])
    return requests.repartition(n, "fingerprint").mapInPandas(run, schema)


def demo_calls(requests: DataFrame, cfg: JobConfig, keep: Sequence[str] = ()) -> DataFrame:
    """The offline translator, as an expression."""
    text = demo_translate(
        F.col("text"), cfg.target_language, cfg.preset.name if cfg.preset else ""
    )
    entry = F.struct(
        F.lit(1).alias("attempt"),
        F.lit("completed").alias("status"),
        F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("timestamp").alias("ts"),
    )
    return requests.select(
        *keep,
        "fingerprint",
        text.alias("translated_text"),
        F.lit('{"mode":"demo"}').alias("usage"),
        F.lit(None).cast("string").alias("error"),
        F.array(entry).alias("log"),
    )


@dataclass(frozen=True)
class Batch:
    results: DataFrame
    attempts: DataFrame
    entries: DataFrame


def _requests(texts: DataFrame, representatives: DataFrame, path: str | None) -> DataFrame:
    """The rows of ``texts`` that are representatives, found by them or by the others' keys.

    The fewer of the two are looked up: they are often few enough to be sent to the texts, which then
    need no shuffle.
    """
    keys, keyed = representatives.select(*SEG_KEYS), texts.dropna(subset=SEG_KEYS)
    others = materialize(keyed.select(*SEG_KEYS).join(keys, SEG_KEYS, "left_anti"), "others", path)
    if others.count() < keys.count():
        return keyed.join(others, SEG_KEYS, "left_anti")
    return texts.join(keys, SEG_KEYS, "left_semi")


def _shared(outcome: DataFrame, followers: DataFrame, path: str | None) -> DataFrame:
    """The outcomes that followers may share: the hashes of few followers' calls are sent to them."""
    mark = F.xxhash64("__call").alias("__mark")
    marks = materialize(followers.select(mark).distinct(), "shared", path)
    if not fits(marks, [], MARKS):
        return outcome
    return outcome.withColumn("__mark", mark).join(F.broadcast(marks), "__mark", "left_semi").drop("__mark")


def translate_batch(
    segs: DataFrame,
    cache: DataFrame,
    cfg: JobConfig,
    now: Column,
    fn: Translator | None = None,
    path: str | None = None,
    partitions: int | None = None,
    concurrency: int = 1,
    sleep: Callable[[float], None] = time.sleep,
    texts: DataFrame | None = None,
) -> Batch:
    """Translate the given unfinished segments, which carry their ``fingerprint``.

    Cache hits are taken as they are. With the cache on, equal requests are sent once and the
    result is shared; if that call fails, its followers stay pending for the next run. The calls'
    results are written before anything reads them, so no re-plan or retry repeats a call.
    Joins carry keys and fingerprints; the request columns follow only into the calls. If ``segs`` has
    keys and fingerprints only, ``texts`` has the rows with the request columns, among others.
    """
    texts = segs if texts is None else texts
    order = ["job_id", "segment_id", "chapter_index", "segment_index", "fingerprint"]
    looked = materialize(cache_lookup(segs.select(*order), cache, cfg.use_cache), "looked", path)
    misses = looked.filter(~F.col("hit")).select(*order)
    # then a call belongs to one segment, whose result is the call's row as it is
    single = cfg.use_cache and looked.groupBy(*SEG_KEYS).count().filter("count > 1").isEmpty()
    if cfg.use_cache:
        representatives, followers = dedupe_work(misses)
        representatives = materialize(representatives, "representatives", path)
        followers = materialize(followers, "followers", path)
    else:
        representatives, followers = misses, misses.limit(0)
    requests = _requests(texts, representatives, path)
    if not cfg.use_cache:
        # without sharing, every segment is its own call
        requests = requests.withColumn("fingerprint", F.concat_ws("\x1f", *SEG_KEYS))
    if fn is None:
        calls = demo_calls(requests, cfg, SEG_KEYS)
    else:
        calls = translate(requests, fn, cfg.retries, partitions, concurrency, sleep, SEG_KEYS)
    calls = materialize(calls, "answers", path, **PACKED)

    call_key = F.col("fingerprint") if cfg.use_cache else F.concat_ws("\x1f", *SEG_KEYS)
    own = calls.select(
        *SEG_KEYS,
        F.col("fingerprint").alias("__call"),
        F.when(F.col("error").isNull(), js_trim(F.col("translated_text"))).alias("translated_text"),
        "usage",
        clip_error(F.col("error")).alias("error"),
        F.size("log").alias("attempts"),
        "log",
    )
    outcome = own.drop(*SEG_KEYS, "log")
    failed = F.col("error").isNotNull()
    text = F.coalesce("translated_text", F.lit(""))
    fields = ["translated_text", "attempts", "error", "usage"]

    def shaped(df: DataFrame, status: Column) -> DataFrame:
        finished = F.when(status.isin("completed", "cached"), now)
        return df.select(
            *SEG_KEYS,
            "fingerprint",
            status.alias("status"),
            *fields,
            finished.alias("completed_at"),
        )

    hits = looked.filter("hit").withColumns(
        {"attempts": F.lit(0), "error": F.lit(None).cast("string"), "usage": F.lit(None).cast("string")}
    )
    if single:
        called = own.filter(F.col("__call").isNotNull()).withColumn("fingerprint", F.col("__call"))
    else:
        logs = calls.select(F.col("fingerprint").alias("__call"), "log")
        called = representatives.withColumn("__call", call_key).join(logs, "__call")
    first = called if single else representatives.withColumn("__call", call_key).join(outcome, "__call")
    followers = followers.withColumn("__call", call_key)
    shared = followers.join(_shared(outcome, followers, path), "__call").withColumns({"attempts": F.lit(0)})
    made = shaped(first, F.when(failed, "failed").otherwise("completed"))
    results = (
        shaped(hits, F.lit("cached"))
        .unionByName(made)
        .unionByName(
            shaped(
                shared,
                F.when(failed, "pending").when(text != "", "cached").otherwise("completed"),
            ).withColumn("error", F.lit(None).cast("string"))
        )
    )
    attempts = called.select(*SEG_KEYS, F.explode("log").alias("a")).select(
        *SEG_KEYS, "a.attempt", "a.status", "a.error", F.coalesce("a.ts", now).alias("ts")
    )
    entries = new_entries(made, cfg, now, distinct=True) if single else new_entries(results, cfg, now)
    return Batch(results, attempts, entries)
