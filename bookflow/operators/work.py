"""The work queue: what is pending, what is done, how far a job is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow import constants as C
from bookflow.schemas import SEG_KEYS

DONE = ("completed", "cached")
STATUSES = ("pending", "running", "completed", "cached", "failed", "interrupted")


def is_done(status: Column) -> Column:
    return status.isin(*DONE)


def pending(df: DataFrame, retry_failed: bool = False) -> DataFrame:
    skip = DONE if retry_failed else (*DONE, "failed")
    return df.filter(~F.col("status").isin(*skip))


def qa_eligible(df: DataFrame) -> DataFrame:
    return df.filter(is_done(F.col("status")))


def resume_filter(segs: DataFrame, done: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Segments without a finished result."""
    keys = keys or SEG_KEYS
    finished = done.filter(is_done(F.col("status"))).select(*keys)
    return segs.join(finished, keys, "left_anti")


def reset_for_resume(df: DataFrame) -> DataFrame:
    stopped = F.col("status").isin("running", "interrupted")
    return df.withColumn("status", F.when(stopped, "pending").otherwise(F.col("status")))


def reset_failed(df: DataFrame, include_empty: bool = False) -> DataFrame:
    """Failed and stopped segments become pending; ``include_empty`` also redoes blank results."""
    failed = F.col("status") == "failed"
    if include_empty:
        failed = failed | (
            is_done(F.col("status")) & (F.coalesce("translated_text", F.lit("")) == "")
        )
    stopped = F.col("status").isin("running", "interrupted")
    return df.withColumns(
        {
            "error": F.when(failed, F.lit(None)).otherwise(F.col("error")),
            "status": F.when(failed | stopped, "pending").otherwise(F.col("status")),
        }
    )


def mark_interrupted(jobs: DataFrame, segs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After a crash: open jobs become interrupted, their running segments pending."""
    open_job = F.col("status").isin("running", "queued")
    new_jobs = jobs.withColumns(
        {
            "status": F.when(open_job, "interrupted").otherwise(F.col("status")),
            "error": F.when(open_job, C.INTERRUPTED_MESSAGE).otherwise(F.col("error")),
        }
    )
    opened = jobs.filter(open_job).select("job_id", F.lit(True).alias("__open"))
    reset = F.col("__open") & (F.col("status") == "running")
    new_segs = segs.join(opened, "job_id", "left").select(
        *[
            F.when(reset, "pending").otherwise(F.col("status")).alias("status")
            if c == "status"
            else F.col(c)
            for c in segs.columns
        ]
    )
    return new_jobs, new_segs


def percent(done: Column, total: Column) -> Column:
    share = F.floor(F.lit(100.0) * done / total + F.lit(0.5))
    return F.when(total > 0, share.cast("int")).otherwise(F.lit(0))


def progress(results: DataFrame, by: str = "job_id") -> DataFrame:
    """Counts per status, ``done`` and ``percent`` of every job."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    counted = results.groupBy(by).agg(F.count("*").alias("total"), *counts)
    done = F.col("completed") + F.col("cached")
    return counted.withColumn("done", done).withColumn(
        "percent", percent(F.col("done"), F.col("total"))
    )


def status_counts(results: DataFrame, by: str = "job_id") -> DataFrame:
    """One row per job and status, for statuses outside the known set too."""
    return results.groupBy(by, "status").count()


def job_outcome(prog: DataFrame, by: str = "job_id") -> DataFrame:
    status = (
        F.when((F.col("failed") > 0) & (F.col("done") > 0), "completed_with_errors")
        .when(F.col("failed") > 0, "failed")
        .otherwise("completed")
    )
    return prog.select(by, status.alias("status"))


def attempt_stats(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy(*SEG_KEYS).agg(
        F.count("*").alias("attempts"), F.max("ts").alias("last_attempt_at")
    )


def latest_status(attempts: DataFrame) -> DataFrame:
    """The newest status of each segment, whatever order the attempts arrive in."""
    return attempts.groupBy(*SEG_KEYS).agg(
        F.max_by(F.struct("status", "ts", "attempt"), F.struct("ts", "attempt")).alias("l")
    ).select(*SEG_KEYS, "l.status", "l.ts", "l.attempt")


def dedupe_work(misses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split misses into one representative per fingerprint and its followers.

    The representative is the first in job, chapter and segment order. It comes from a partial
    aggregation, so many copies of one text never meet in one task, and a follower learns its
    representative only through the fingerprint.
    """
    order = ["job_id", "chapter_index", "segment_index", "segment_id"]
    firsts = misses.groupBy("fingerprint").agg(F.min(F.struct(*order)).alias("__first"))
    reps = firsts.select("__first.job_id", "__first.segment_id")
    representatives = misses.join(reps, SEG_KEYS, "left_semi")
    followers = misses.join(reps, SEG_KEYS, "left_anti")
    return representatives, followers
