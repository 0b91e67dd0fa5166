"""Chapter summaries and the summaries that precede a chapter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookflow import constants as C
from bookflow.functions.arrays import value_counts
from bookflow.functions.text import first_sentences, non_empty
from bookflow.operators.chapters import numbered_title
from bookflow.operators.glossary import attach_terms
from bookflow.operators.ordering import BITS
from bookflow.session import materialize


def names(c: Column) -> Column:
    """Katakana and Han runs that look like names, in text order."""
    return F.regexp_extract_all(c, F.lit(C.NAME_PATTERN), F.lit(0))


def _name_text(text: Column, translated: Column) -> Column:
    return F.concat(
        F.coalesce(text, F.lit("")), F.lit("\n"), F.coalesce(translated, F.lit(""))
    )


def name_counts(chapters: DataFrame) -> DataFrame:
    """``chapters(book_id, chapter_index, text, translated_text)`` -> one row per name."""
    counted = value_counts(names(_name_text(F.col("text"), F.col("translated_text"))))
    return chapters.select("book_id", "chapter_index", F.explode(counted).alias("c")).select(
        "book_id", "chapter_index", F.col("c.value").alias("name"), "c.n", "c.first_pos"
    )


def top_names(counts: Column, k: int = C.SUMMARY_NAME_LIMIT) -> Column:
    """The ``k`` leading names of a ``value_counts`` array: count, then length, then position."""
    ranked = F.sort_array(
        F.transform(
            counts,
            lambda c: F.struct(
                (-c["n"]).alias("by_count"),
                (-F.length(c["value"])).alias("by_length"),
                c["first_pos"].alias("first_pos"),
                c["value"].alias("name"),
            ),
        )
    )
    return F.transform(F.slice(ranked, 1, k), lambda c: c["name"])


def summarize_chapters(
    chapters: DataFrame, reassembled: DataFrame, terms: DataFrame, now: Column, small: bool | None = None
) -> DataFrame:
    """A summary row for each chapter with a translation.

    ``chapters(job_id, project_id, chapter_index, title, text)``,
    ``reassembled(job_id, chapter_index, translated_text)``.
    """
    keys = ["job_id", "chapter_index"]
    translated = chapters.join(reassembled, keys).filter(F.col("translated_text") != "")
    with_terms = attach_terms(translated, terms, keys, C.SUMMARY_TERM_LIMIT, small=small)
    return with_terms.select(
        *keys,
        "project_id",
        F.coalesce(non_empty(F.col("title")), F.lit(C.UNTITLED_CHAPTER)).alias("title"),
        summary_text(F.col("translated_text"), F.col("text")).alias("summary"),
        top_names(
            value_counts(names(_name_text(F.col("text"), F.col("translated_text"))))
        ).alias("characters"),
        F.transform(
            "matched", lambda t: F.struct(t["source"], t["target"], t["note"])
        ).alias("terms"),
        now.alias("updated_at"),
    )


def summary_text(translated: Column, source: Column) -> Column:
    text = F.coalesce(non_empty(translated), source, F.lit(""))
    return F.coalesce(non_empty(first_sentences(text, C.SUMMARY_CHARS)), F.lit(C.NO_SUMMARY))


def current_summary(segs: DataFrame, summaries: DataFrame, book: str = "project_id") -> DataFrame:
    """Left join each segment's own chapter summary as ``summary``; ``book`` names the book key."""
    own = summaries.select(book, "chapter_index", "summary")
    return segs.join(own, [book, "chapter_index"], "left")


def summary_line(title: Column, chapter_index: Column, summary: Column) -> Column:
    return F.concat(numbered_title(title, chapter_index), F.lit("："), summary)


def previous_summaries(
    chapters: DataFrame,
    summaries: DataFrame,
    n: int = C.PREVIOUS_SUMMARIES,
    book: str = "project_id",
    bits: int = BITS,
) -> DataFrame:
    """``book, chapter_index, previous``: the last ``n`` summaries before each chapter.

    Chapters without a summary are passed over. A book is cut into buckets of 2^``bits`` chapters. In
    a bucket each chapter learns how many summaries precede it there; the bucket's summary with rank r
    serves the chapters that see r .. r+n-1 of them, and the last ``n`` summaries of the buckets before
    are carried over its border with the ranks 0, -1, ... So no key has more than a bucket's chapters,
    not even behind a book's last summary.
    """
    keys, part = [book, "chapter_index"], [book, "bucket"]
    lines = summaries.select(
        *keys, summary_line(F.col("title"), F.col("chapter_index"), F.col("summary")).alias("line")
    )
    marks = chapters.select(*keys).distinct().join(lines, keys, "full")
    marks = marks.withColumn("bucket", F.shiftright("chapter_index", bits))
    inside = W.partitionBy(*part)
    before = inside.orderBy("chapter_index").rowsBetween(W.unboundedPreceding, -1)
    ranked = marks.select(
        *keys, "bucket", "line", F.count("line").over(before).alias("seen"), F.count("line").over(inside).alias("total")
    )
    ranked = materialize(ranked, "ranked")
    own = ranked.filter(F.col("line").isNotNull()).select(*part, (F.col("seen") + 1).alias("rank"), "line", "total")

    # the tail of each bucket with summaries, and the last n summaries up to its end
    tails = own.filter(F.col("rank") > F.col("total") - n).groupBy(*part).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("tail")
    )
    order = W.partitionBy(book).orderBy("bucket")
    whole = F.flatten(F.collect_list("tail").over(order.rowsBetween(1 - n, 0)))
    last = F.slice(whole, F.greatest(F.size(whole) - n + 1, F.lit(1)), n)
    ends = materialize(tails.select(*part, F.row_number().over(order).alias("number"), last.alias("carry")), "ends")
    # a bucket takes what the last bucket with summaries before it ends with
    full = F.coalesce(F.sum(F.col("number").isNotNull().cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    buckets = ranked.select(*part).distinct().join(ends.select(*part, "number"), part, "left").select(*part, full.alias("number"))
    carried = buckets.join(ends.select(book, "number", "carry"), [book, "number"]).select(
        *part, F.size("carry").alias("m"), F.posexplode("carry").alias("pos", "line")
    )
    served = (
        own.select(*part, F.col("rank").cast("long").alias("rank"), "line")
        .unionByName(carried.select(*part, (F.col("pos") - F.col("m") + 1).cast("long").alias("rank"), "line"))
        .withColumn("seen", F.explode(F.sequence(F.col("rank"), F.col("rank") + n - 1)))
        .groupBy(*part, "seen")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("ls"))
        .select(*part, "seen", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("previous"))
    )
    return ranked.join(served, [*part, "seen"]).select(*keys, "previous")
