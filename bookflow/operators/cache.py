"""The content-addressed translation cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow import constants as C
from bookflow.config import JobConfig
from bookflow.functions.text import js_trim
from bookflow.operators.matching import bounded_broadcast
from bookflow.operators.ordering import tree_hash


def _joined(*fields: Column) -> Column:
    """Fields with their lengths, so that no two different rows give the same string."""
    parts = []
    for f in fields:
        t = F.coalesce(f.cast("string"), F.lit(""))
        parts += [F.length(t).cast("string"), t]
    return F.concat_ws("\x1f", *parts)


def glossary_digest(terms: DataFrame) -> DataFrame:
    row = F.sha2(
        _joined(
            F.col("source"), F.col("target"), F.array_join("aliases", "\x1e"), F.col("note")
        ),
        256,
    )
    return tree_hash(terms, ["project_id"], "term_idx", row, "glossary_sha")


def bank_digest(bank: DataFrame) -> DataFrame:
    row = F.sha2(_joined(F.col("title"), F.col("text")), 256)
    return tree_hash(bank, ["project_id"], "item_idx", row, "bank_sha")


def summaries_digest(summaries: DataFrame, book: str = "project_id") -> DataFrame:
    """Over title and summary only: the update time must not change a key."""
    row = F.sha2(_joined(F.col("title"), F.col("summary")), 256)
    return tree_hash(summaries, [book], "chapter_index", row, "summaries_sha")


def fingerprint(
    segs: DataFrame,
    cfg: JobConfig,
    terms: DataFrame,
    bank: DataFrame,
    summaries: DataFrame,
    book: str = "project_id",
) -> DataFrame:
    """Add ``fingerprint``: SHA-256 over settings, glossary, bank, summaries and text.

    Settings are hashed once on the driver and tables once per project, so a segment only hashes
    its own text.
    """
    out = (
        segs.join(bounded_broadcast(glossary_digest(terms)), "project_id", "left")
        .join(bounded_broadcast(bank_digest(bank)), "project_id", "left")
        .join(bounded_broadcast(summaries_digest(summaries, book)), book, "left")
    )
    parts = [F.coalesce(c, F.lit("")) for c in ("glossary_sha", "bank_sha", "summaries_sha")]
    key = F.sha2(
        F.concat_ws("\x1f", F.lit(cfg.digest()), *parts, F.sha2(F.col("text"), 256)), 256
    )
    return out.select(*segs.columns, key.alias("fingerprint"))


def live_entries(cache: DataFrame) -> DataFrame:
    return cache.filter((F.col("version") == C.CACHE_VERSION) & F.col("text").isNotNull())


def cache_lookup(segs: DataFrame, cache: DataFrame, use_cache: bool = True) -> DataFrame:
    """Add ``hit`` and ``translated_text`` (trimmed text of the hit, else null)."""
    if not use_cache:
        return segs.withColumns(
            {"hit": F.lit(False), "translated_text": F.lit(None).cast("string")}
        )
    # batches may have stored a key twice: the newest entry counts
    newest = live_entries(cache).groupBy("key").agg(F.max(F.struct("created_at", "text")).alias("e"))
    entries = newest.select(
        F.col("key").alias("fingerprint"), js_trim(F.col("e.text")).alias("translated_text")
    )
    joined = segs.join(entries, "fingerprint", "left")
    return joined.withColumn("hit", F.col("translated_text").isNotNull()).select(
        *segs.columns, "hit", "translated_text"
    )


def new_entries(results: DataFrame, cfg: JobConfig, now: Column, distinct: bool = False) -> DataFrame:
    """Cache rows for fresh results with text; one per fingerprint.

    Results that are known to be ``distinct`` by fingerprint are not grouped, texts and all.
    """
    fresh = results.filter(
        (F.col("status") == "completed") & (F.coalesce("translated_text", F.lit("")) != "")
    )
    if not cfg.use_cache:
        fresh = fresh.limit(0)
    row = F.struct("translated_text", "usage")
    if distinct:
        kept = fresh.select("fingerprint", row.alias("r"))
    else:
        kept = fresh.groupBy("fingerprint").agg(F.max(row).alias("r"))
    return kept.select(
        F.lit(C.CACHE_VERSION).alias("version"),
        F.col("fingerprint").alias("key"),
        now.alias("created_at"),
        F.lit(cfg.provider).alias("provider"),
        F.lit(cfg.model).alias("model"),
        F.lit(cfg.source_language).alias("source_language"),
        F.lit(cfg.target_language).alias("target_language"),
        F.col("r.translated_text").alias("text"),
        F.col("r.usage").alias("usage"),
    )


def cache_put(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The cache with ``entries`` added; an entry replaces the one with its key."""
    kept = cache.join(entries.select("version", "key"), ["version", "key"], "left_anti")
    return kept.unionByName(entries, allowMissingColumns=True)


def cache_evict(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(keys.select("key"), "key", "left_anti")


def cache_stats(cache: DataFrame) -> DataFrame:
    size = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in cache.columns])))
    return cache.agg(
        F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")
    )
