"""Plain-text export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.functions.text import js_trim
from bookflow.operators.ordering import joined_parts

BETWEEN = "\n\n\n"


def chapter_block(title: Column, text: Column) -> Column:
    return js_trim(
        F.concat(F.lit("# "), F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(text, F.lit("")))
    )


def _blocks(results: DataFrame) -> DataFrame:
    return results.select(
        "book_id", "chapter_index", chapter_block(F.col("title"), F.col("translated_text")).alias("part")
    )


def book_text(results: DataFrame) -> DataFrame:
    """``book_id, chapter_index, part``: the parts of a book, in order, are its text.

    A book is never gathered into one row: the first part is bare and each later one starts with
    the separator.
    """
    return joined_parts(_blocks(results), ["book_id"], "chapter_index", "part", BETWEEN)


def write_book_text(results: DataFrame, path: str, partitions: int | None = None) -> None:
    """One folder per book; its files, in name order, concatenate to the book's text.

    The writer ends every part with a line feed, so the parts carry the other two.
    """
    parts = joined_parts(_blocks(results), ["book_id"], "chapter_index", "part", BETWEEN[1:])
    n = [partitions] if partitions else []
    (
        parts.repartitionByRange(*n, "book_id", "chapter_index")
        .sortWithinPartitions("book_id", "chapter_index")
        .select("book_id", "part")
        .write.partitionBy("book_id")
        .text(path)
    )
