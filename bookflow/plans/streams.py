"""Queries that run a stream over the tables to its end and return the resulting state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.operators.translate import TranslateError
from bookflow.plans import sql as S
from bookflow.plans.adapters import CONFIG, attempts_of, table
from bookflow.plans.files import END, source_of, write_text_files
from bookflow.plans.jobs import LATEST_SQL
from bookflow.plans.registry import query
from bookflow.session import scratch_dir
from bookflow.streaming.books import read_library, stream_books
from bookflow.streaming.progress import read_progress, stream_progress
from bookflow.streaming.translate import read_results, stream_translate


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream; as a glob, the path may name one file as well as a folder."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


_DENSE_END = END.replace(" ", "")
_DENSE = "regexp_replace(text, '\\s', '', 'g')"


@query("stream_books", f"SELECT source, {_DENSE} AS dense FROM documents")
def ingest(spark, sf):
    """Two arrivals, two starts: every file is parsed once."""
    root = scratch_dir(spark)
    docs = table(spark, sf, "documents")
    for half in (0, 1):
        write_text_files(docs.filter(F.col("doc_id") % 2 == half), f"{root}/in/half={half}")
        stream_books(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint").awaitTermination()
    # chapters are cut at sizes, across documents: the texts are compared without white space
    parsed = read_library(spark, f"{root}/out").chapters
    whole = parsed.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("chapter_index", "text"))).alias("c"))
    dense = F.regexp_replace(F.array_join(F.transform("c", lambda x: x["text"]), ""), "\\s", "")
    parts = F.split(dense, _DENSE_END)
    return whole.select(
        source_of(F.col("book_id")).alias("source"), F.explode(F.slice(parts, 1, F.size(parts) - 1)).alias("dense")
    )


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    return _stream(spark, sf, "documents").select(
        F.col("source").alias("job_id"),
        F.col("doc_id").cast("string").alias("segment_id"),
        F.col("doc_id").cast("int").alias("chapter_index"),
        F.lit(1).alias("segment_index"),
        F.sha2("text", 256).alias("fingerprint"),
        "text",
    )


@query(
    "stream_translate",
    f"""SELECT source AS job_id, CAST(doc_id AS VARCHAR) AS segment_id,
      CASE WHEN row_number() OVER (PARTITION BY text ORDER BY source, doc_id) = 1 THEN 'completed'
        ELSE 'cached' END AS status,
      {S.trim(S.demo('text', 'Chinese', CONFIG.preset.name))} AS translated_text FROM documents""",
)
def translate_twice(spark, sf):
    """The second start finds nothing left to do."""
    root = scratch_dir(spark)
    segs = _segments(spark, sf)
    now = F.to_timestamp(F.lit("2024-06-01 00:00:00"))
    for _ in range(2):
        stream_translate(
            segs, f"{root}/state", f"{root}/checkpoint", CONFIG, now=now
        ).awaitTermination()
    return read_results(spark, f"{root}/state").select(
        "job_id", "segment_id", "status", "translated_text"
    )


@query(
    "stream_translate_failures",
    f"""SELECT source AS job_id, CAST(doc_id AS VARCHAR) AS segment_id,
      CASE WHEN row_number() OVER (PARTITION BY text ORDER BY source, doc_id) = 1 THEN 'completed'
        ELSE 'cached' END AS status,
      CASE WHEN length(text) % 2 = 0 THEN {S.trim("'T ' || text")}
        ELSE {S.trim(S.demo('text', 'Chinese', CONFIG.preset.name))} END AS translated_text FROM documents""",
)
def translate_after_failures(spark, sf):
    """Half of the calls fail at first; a second start, without new input, completes all segments."""

    def failing(request):
        if len(request["text"]) % 2:
            raise TranslateError("refused", status=401)
        return f"T {request['text']}", None

    root = scratch_dir(spark)
    now = F.to_timestamp(F.lit("2024-06-01 00:00:00"))
    for fn, again in ((failing, False), (None, True)):
        stream_translate(
            _segments(spark, sf), f"{root}/state", f"{root}/checkpoint", CONFIG, fn=fn, now=now, retry_failed=again
        ).awaitTermination()
    return read_results(spark, f"{root}/state").select(
        "job_id", "segment_id", "status", "translated_text"
    )


@query(
    "stream_progress",
    S.with_(S.ATTEMPTS, LATEST_SQL, f"prog AS ({S.progress('job_id', 'latest')})")
    + f"SELECT *, {S.OUTCOME} AS outcome FROM prog",
)
def live_progress(spark, sf):
    root = scratch_dir(spark)
    rows = attempts_of(_stream(spark, sf, "events"))
    stream_progress(rows, f"{root}/state", f"{root}/checkpoint").awaitTermination()
    return read_progress(spark, f"{root}/state")
