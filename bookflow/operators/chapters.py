"""Chapters: splitting a text, choosing a range, cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow import constants as C
from bookflow.functions.arrays import indexes
from bookflow.functions.text import fixed_slices, js_trim, lines, non_empty, normalize_text

CHAPTER_TYPE = "array<struct<title:string,text:string>>"


def _by_headings(text_lines: Column, heads: Column, keep_preamble: bool) -> Column:
    """One chapter per heading position: the lines from it up to the next heading."""
    ends = F.concat(F.slice(heads, 2, F.size(heads)), F.array(F.size(text_lines)))

    def chapter(start: Column, end: Column) -> Column:
        body = F.array_join(F.slice(text_lines, start + 1, end - start), "\n")
        return F.struct(
            js_trim(F.get(text_lines, start)).alias("title"), js_trim(body).alias("text")
        )

    chapters = F.zip_with(heads, ends, chapter)
    if keep_preamble:
        head = js_trim(F.array_join(F.slice(text_lines, 1, F.get(heads, F.lit(0))), "\n"))
        preamble = F.array(F.struct(F.lit("").alias("title"), head.alias("text")))
        chapters = F.when(head != "", F.concat(preamble, chapters)).otherwise(chapters)
    return chapters


def _by_size(text: Column) -> Column:
    parts = F.transform(
        fixed_slices(text, C.PART_CHARS),
        lambda piece, i: F.struct(
            F.concat(F.lit("Part "), (i + 1).cast("string")).alias("title"),
            js_trim(piece).alias("text"),
        ),
    )
    whole = F.array(F.struct(F.lit("Full Text").alias("title"), text.alias("text")))
    return F.when(F.length(text) > 0, parts).otherwise(whole)


def split_chapters(books: DataFrame, keep_preamble: bool = False) -> DataFrame:
    """``books(book_id, text)`` -> ``(book_id, chapter_index, title, text)``.

    A book with two or more heading lines is cut at them, any other in parts of fixed size.
    Headings are found and cut inside the row, so the split adds no shuffle.
    """
    normal = books.select("book_id", normalize_text(F.col("text")).alias("text"))
    lined = normal.withColumn("lines", lines(F.col("text")))
    marked = lined.withColumn(
        "heads",
        F.filter(
            indexes(F.col("lines")),
            lambda i: F.rlike(js_trim(F.get(F.col("lines"), i)), F.lit(C.HEADING_PATTERN)),
        ),
    )
    chapters = F.when(
        F.size("heads") >= C.MIN_HEADINGS,
        _by_headings(F.col("lines"), F.col("heads"), keep_preamble),
    ).otherwise(_by_size(F.col("text")))
    return (
        marked.select("book_id", F.posexplode(chapters).alias("chapter_index", "c"))
        .select("book_id", "chapter_index", "c.title", "c.text")
    )


def select_chapters(df: DataFrame, start: int, end: int) -> DataFrame:
    """Chapters ``start`` to ``end`` (1-based, either order); indexes stay as they were."""
    low, high = min(start, end) - 1, max(start, end) - 1
    return df.filter(F.col("chapter_index").between(low, high))


def numbered_title(title: Column, chapter_index: Column) -> Column:
    default = F.concat(F.lit("第 "), (chapter_index + 1).cast("string"), F.lit(" 章"))
    return F.coalesce(non_empty(title), default)


def clean_chapters(df: DataFrame) -> DataFrame:
    """Drop blank chapters and give untitled ones a numbered title."""
    return df.filter(js_trim(F.coalesce("text", F.lit(""))) != "").withColumn(
        "title", numbered_title(F.col("title"), F.col("chapter_index"))
    )
