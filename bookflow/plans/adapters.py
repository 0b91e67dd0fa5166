"""The test tables seen as books, pairs, glossary, context bank and attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.config import BUILTIN_PRESETS, JobConfig
from bookflow.operators.ordering import ordinal
from bookflow.operators.segments import build_segments

PROJECT = "corpus"
LATIN = "abcdefghijklmnopqrstuvwxyz"
KANA = "アイウエオカキクケコサシスセソタチツテトナニヌネノハ"
MIXED = "アイウエオカキクケコサシス王国勇者森海山川空月花雪風"

CONFIG = JobConfig(
    target_language="Chinese", preset=BUILTIN_PRESETS["faithful"], context="Shared context."
)


# Wide text tables below the size of one input split: one task would read and work them all.
WIDE = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}
SPLIT_BYTES = 128 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; a wide one of less than a split is dealt over the cores, larger ones never are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in WIDE and df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < SPLIT_BYTES:
        return df.repartition(spark.sparkContext.defaultParallelism, WIDE[name])
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("project_id", F.lit(PROJECT))


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BOOKS: a source is a book and a job, its documents are the chapters."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    numbered = ordinal(docs, ["source"], "doc_id", "n")
    return numbered.select(
        F.col("source").alias("job_id"),
        F.col("source").alias("book_id"),
        F.lit(PROJECT).alias("project_id"),
        F.col("n").cast("int").alias("chapter_index"),
        F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"),
        "text",
        "doc_id",
    )


def segments(spark: SparkSession, sf_dir: str, cfg: JobConfig = CONFIG) -> DataFrame:
    """Segments of BOOKS: one project, whose glossary and bank serve all its books."""
    return segments_of(chapters(spark, sf_dir), cfg)


def segments_of(chaps: DataFrame, cfg: JobConfig = CONFIG) -> DataFrame:
    return build_segments(chaps, cfg).withColumn("project_id", F.lit(PROJECT))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TERMS: pieces of the words of each benchmark text."""
    words = table(spark, sf_dir, "benchmark").select(
        "item_id", F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0)).alias("w")
    )
    n = F.col("item_id")

    def piece(i: int, size: int) -> Column:
        return F.lower(F.substring(F.get("w", F.lit(i)), 1, size))

    return words.filter(F.size("w") >= 3).select(
        F.lit(PROJECT).alias("project_id"),
        n.cast("int").alias("term_idx"),
        F.concat(F.lit("term-"), n.cast("string")).alias("id"),
        piece(0, 4).alias("source"),
        F.when(n % 7 == 3, "").otherwise(piece(1, 3)).alias("target"),
        F.when(n % 3 == 0, F.array(piece(2, 5)))
        .otherwise(F.array().cast("array<string>"))
        .alias("aliases"),
        F.when(n % 5 == 0, F.concat(F.lit("note "), n.cast("string"))).otherwise("").alias("note"),
        F.lit("term").alias("category"),
        F.lit("contains").alias("match_type"),
    )


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BANK: benchmark texts, every other one with a title."""
    n = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        F.lit(PROJECT).alias("project_id"),
        n.cast("int").alias("item_idx"),
        F.concat(F.lit("ctx-"), n.cast("string")).alias("id"),
        F.when(n % 2 == 0, F.concat(F.lit("Item "), n.cast("string"))).otherwise("").alias("title"),
        "text",
    )


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prior run's summaries: the first sentences of two chapters in three."""
    chaps = chapters(spark, sf_dir).filter(F.col("chapter_index") % 3 != 1)
    return chaps.select(
        "job_id",
        "chapter_index",
        F.when(F.col("chapter_index") % 5 == 0, "").otherwise(F.col("title")).alias("title"),
        F.concat(F.lit("S "), F.substring("text", 1, 60)).alias("summary"),
    )


def translate_letters(c: Column, to: str) -> Column:
    return F.translate(F.lower(c), LATIN, to)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAIRS: a user turn and the assistant turn after it, as source and translation."""
    turns = table(spark, sf_dir, "conversations")
    user = turns.filter(F.col("role") == "user").select("conv_id", "turn", "text")
    reply = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("translated_text")
    )
    conv, index = F.col("conv_id"), F.floor(F.col("turn") / 2) + 1
    rest = conv % 10
    return user.join(reply, ["conv_id", "turn"]).select(
        F.concat(F.lit("job-"), (conv % 8).cast("string")).alias("job_id"),
        F.concat(
            F.lit("c"), (conv + 1).cast("string"), F.lit("-s"), index.cast("string")
        ).alias("segment_id"),
        F.lit(PROJECT).alias("project_id"),
        conv.cast("int").alias("chapter_index"),
        F.concat(F.lit("Conv "), conv.cast("string")).alias("chapter_title"),
        index.cast("int").alias("segment_index"),
        "text",
        "translated_text",
        F.when(rest == 0, "failed")
        .when(rest == 1, "cached")
        .when(rest == 2, "pending")
        .otherwise("completed")
        .alias("status"),
    )


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAIRS bent in turn so that every rule meets rows it flags and rows it passes."""
    kind = (F.col("chapter_index") * 3 + F.col("segment_index")) % 9
    kana = translate_letters(F.col("text"), KANA)
    line = F.concat(F.substring("translated_text", 1, 40), F.lit("\n"))
    bent = (
        F.when(kind == 0, " \n ")
        .when(kind == 1, F.concat(F.lit("Sure: "), F.col("translated_text")))
        .when(kind == 2, kana)
        .when(kind == 3, F.concat(F.repeat(line, 4), F.col("translated_text")))
        .when(kind == 4, F.substring("translated_text", 1, 5))
        .when(kind == 5, F.repeat(F.col("translated_text"), 6))
        .otherwise(F.col("translated_text"))
    )
    base = pairs(spark, sf_dir)
    return base.select(
        *[c for c in base.columns if c not in ("text", "translated_text")],
        F.when(kind == 2, kana).otherwise(F.col("text")).alias("text"),
        bent.alias("translated_text"),
    )


def _status() -> Column:
    return (
        F.when(F.col("event_type") == "purchase", "completed")
        .when(F.col("event_type") == "signup", "cached")
        .when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "click", "running")
        .otherwise("pending")
    )


def event_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ATTEMPTS as results: every event is a segment of the user's job."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("job_id"),
        F.col("event_id").cast("string").alias("segment_id"),
        _status().alias("status"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
    )


def attempts_of(events: DataFrame) -> DataFrame:
    """ATTEMPTS as attempts: a user's events of about one value are attempts at one segment."""
    return events.select(
        F.col("user_id").cast("string").alias("job_id"),
        F.concat(F.lit("s"), (F.floor("value") % 20).cast("string")).alias("segment_id"),
        F.col("event_id").cast("int").alias("attempt"),
        _status().alias("status"),
        F.lit(None).cast("string").alias("error"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts_of(table(spark, sf_dir, "events"))
