"""Books of any supported format."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.functions.html import base_name
from bookflow.operators.chapters import split_chapters
from bookflow.schemas import BOOKS, CHAPTERS, REJECTS, names as columns
from bookflow.session import materialize, scratch_dir
from bookflow.sources.epub import (
    NO_CHAPTERS,
    epub_chapters,
    epub_spine,
    open_archives,
    package_files,
    package_title,
)
from bookflow.sources.text_files import decode_books, scan_files

UNSUPPORTED = "Only .txt and .epub files are supported"


@dataclass(frozen=True)
class Library:
    books: DataFrame
    chapters: DataFrame
    rejects: DataFrame


def parse_files(files: DataFrame, path: str | None = None) -> Library:
    """``files(book_id, name, ext, content)`` -> books, chapters and rejected files.

    With a column ``path``, archives are read from there, member by member, and their ``content`` is
    not. Decoded texts and parsed pages are written once, since several tables derive from them;
    ``path`` names a folder for that, else the shared scratch folder is used.
    """
    ext = F.col("ext")
    root = path or scratch_dir(files.sparkSession)
    text = materialize(decode_books(files.filter(ext.isin(".txt", ""))), "text", root)
    text_books = text.select(
        "book_id",
        "name",
        base_name(F.col("name"), ".txt").alias("title"),
        F.lit("txt").alias("format"),
        "encoding",
        F.lit(None).cast("int").alias("files"),
    )
    text_chapters = split_chapters(text).withColumn("source_path", F.lit(None).cast("string"))

    if "path" not in files.columns:
        files = files.withColumn("path", F.lit(None).cast("string"))
    archives = open_archives(files.filter(ext == ".epub"), root)
    packages = package_files(archives, root)
    valid = packages.filter(F.col("reason").isNull())
    pages = materialize(epub_chapters(archives, epub_spine(valid)), "pages", root)
    names = archives.listing.select("book_id", "name").distinct()
    # a page that cannot be read spoils its book
    broken = pages.groupBy("book_id").agg(F.max("problem").alias("reason")).withColumn("readable", F.lit(True))
    judged = (
        packages.join(broken.withColumnRenamed("reason", "problem"), "book_id", "left")
        .join(names, "book_id")
        .withColumn("reason", F.coalesce("reason", "problem", F.when(F.col("readable").isNull(), NO_CHAPTERS)))
    )
    judged = materialize(judged.select("book_id", "name", "opf", "files", "reason"), "judged", root)
    epub_books = judged.filter(F.col("reason").isNull()).select(
        "book_id",
        "name",
        package_title(F.col("opf")).alias("title"),
        F.lit("epub").alias("format"),
        F.lit(None).cast("string").alias("encoding"),
        "files",
    )
    pages = pages.drop("problem").join(epub_books.select("book_id"), "book_id", "left_semi")
    rejects = judged.filter(F.col("reason").isNotNull()).select(*columns(REJECTS)).unionByName(
        files.filter(~ext.isin(".txt", "", ".epub")).select("book_id", "name", F.lit(UNSUPPORTED).alias("reason"))
    )
    return Library(
        text_books.unionByName(epub_books).select(*columns(BOOKS)),
        text_chapters.unionByName(pages).select(*columns(CHAPTERS)),
        rejects,
    )


def read_books(spark: SparkSession, path: str) -> Library:
    return parse_files(scan_files(spark, path))
