"""Project documents: JSON files of a project, read into tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bookflow.functions.json_slices import sliced
from bookflow.functions.text import non_empty, sanitize_id
from bookflow.operators.tables import OPEN, upsert
from bookflow.schemas import PROJECT_DOCUMENT
from bookflow.sources.stores import is_opened, open_file

# Bytes of a slice of a document: readers of tables hold some 4000 rows at once. Bytes of a batch of slices.
SLICE_BYTES, BATCH_BYTES = 32 * 1024, 8 * 1024 * 1024

SECRETS = ("apiKey", "api_key")
# The parts of a document that are tables of their own: where they are, and what numbers their rows.
SECTIONS = {
    "chapters": ("book.chapters", "chapter_index"),
    "results": ("results", "result_index"),
    "contextBank": ("contextBank", "item_idx"),
    "chapterSummaries": ("chapterSummaries", "summary_index"),
    "qaIssues": ("qaIssues", "issue_index"),
    "consistencyIssues": ("consistencyIssues", "issue_index"),
}


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """Documents of files, plain or packed with gzip, which hold them over any number of lines, one after the other.

    A task reads a file in blocks. A document beyond SLICE_BYTES is cut into slices, see ``sliced``, so no
    row holds a project.
    """
    files = spark.read.format("binaryFile").load(path).select("path")
    if not files.filter(~is_opened(F.col("path"))).isEmpty():
        return parse_projects(spark.read.text(path, wholetext=True), "value")

    places = [at for at, _ in SECTIONS.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[bytes, int | None]]:
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    with open_file(name) as file:
                        yield from sliced(file, places, SLICE_BYTES)

        held, size = [], 0
        for row in rows():
            held.append(row)
            size += len(row[0] or b"")
            if size > BATCH_BYTES:
                yield _batch(held)
                held, size = [], 0
        yield _batch(held)

    texts = files.mapInArrow(run, "json binary, offset int")
    return parse_projects(texts.withColumn("json", F.col("json").cast("string")))


def _batch(rows: list[tuple[bytes, int | None]]) -> pa.RecordBatch:
    texts, offsets = ([r[i] for r in rows] for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(offsets, pa.int32())], ["json", "offset"])


def parse_projects(lines: DataFrame, column: str = "json") -> DataFrame:
    """The same from a column of JSON documents, or of slices with their ``offset``.

    Fields that the schema does not name are kept in ``extra``, by name. A row without an ``offset`` is a
    document or the first slice of one, which holds all but the sections' rows; the others hold rows of one
    section after the first ``offset``.
    """
    offset = F.col("offset") if "offset" in lines.columns else F.lit(None).cast("int")
    known = F.array(*[F.lit(n) for n in (*_document().names, *SECRETS)])
    fields = F.when(offset.isNull(), F.from_json(column, OPEN))
    return lines.select(
        F.from_json(column, PROJECT_DOCUMENT).alias("d"),
        F.map_filter(fields, lambda k, _: ~F.array_contains(known, k)).alias("extra"),
        offset.alias("offset"),
    ).select("d.*", "extra", "offset")


def _document() -> StructType:
    return PROJECT_DOCUMENT if isinstance(PROJECT_DOCUMENT, StructType) else StructType.fromDDL(PROJECT_DOCUMENT)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``project_id, section, pos, json`` of an export as lines, each value still in one JSON text."""
    rows = spark.read.schema("pos long, json string, project_id string, section string").json(path)
    return rows.select("project_id", "section", "pos", "json")


def line_headers(lines: DataFrame) -> DataFrame:
    """Documents that hold a header only, from the header lines."""
    return parse_projects(lines.filter(F.col("section") == "project"))


def line_rows(lines: DataFrame, section: str, index: str) -> DataFrame:
    """A section's rows from lines: ``project_id, index`` and the fields that a document gives them."""
    kinds = _document()
    holder = kinds["book"].dataType if section == "chapters" else kinds
    row = holder[section].dataType.elementType
    parsed = lines.filter(F.col("section") == section).select(
        sanitize_id(F.col("project_id"), "project").alias("project_id"),
        F.col("pos").alias(index),
        F.from_json("json", row).alias("c"),
    )
    return parsed.select("project_id", index, "c.*")


def project_headers(docs: DataFrame) -> DataFrame:
    heads = docs.filter(F.col("offset").isNull())
    safe = heads.withColumn("project_id", sanitize_id(F.col("id"), "project"))
    settings = F.map_filter("settings", lambda k, _: ~k.isin(*SECRETS))
    extra = ["extra"] if "extra" in docs.columns else []
    return safe.select(
        "project_id",
        F.col("title"),
        F.col("book.title").alias("book_title"),
        settings.alias("settings"),
        "glossary",
        F.col("lastJobId").alias("last_job_id"),
        F.to_timestamp("createdAt").alias("created_at"),
        F.to_timestamp("updatedAt").alias("updated_at"),
        *extra,
    )


def _children(docs: DataFrame, column: str, index: str) -> DataFrame:
    rows = docs.select(
        sanitize_id(F.col("id"), "project").alias("project_id"), "offset", F.posexplode(column).alias(index, "c")
    )
    return rows.select("project_id", (F.col(index) + F.coalesce("offset", F.lit(0))).alias(index), "c.*")


def project_chapters(docs: DataFrame) -> DataFrame:
    return _children(docs, "book.chapters", "chapter_index")


def project_results(docs: DataFrame) -> DataFrame:
    return _children(docs, "results", "result_index")


def project_bank(docs: DataFrame) -> DataFrame:
    rows = _children(docs, "contextBank", "item_idx")
    return rows.withColumn("text", F.coalesce(non_empty(F.col("text")), F.col("content"))).drop(
        "content"
    )


def import_projects(docs: DataFrame, existing: DataFrame, now: Column) -> DataFrame:
    """The project table after upserting the documents' headers, fields without a schema included."""
    return upsert(existing, project_headers(docs), ["project_id"], now)


def import_documents(
    docs: DataFrame, projects: DataFrame, children: dict[str, DataFrame], now: Column
) -> dict[str, DataFrame]:
    """All tables after an import: ``projects``, and the sections that ``children`` names (see SECTIONS).

    A section that a document holds replaces the project's rows; one that it leaves out keeps them.
    """
    out = {"projects": import_projects(docs, projects, now)}
    for section, existing in children.items():
        place, index = SECTIONS[section]
        with_it = docs.filter(F.col(place).isNotNull() & F.col("offset").isNull())
        rows = project_bank(docs) if section == "contextBank" else _children(docs, place, index)
        out[section] = replace_children(existing, with_it, rows)
    return out


def replace_children(existing: DataFrame, docs: DataFrame, incoming: DataFrame) -> DataFrame:
    """A child table after an import: rows of imported projects give way to the new ones."""
    ids = docs.select(sanitize_id(F.col("id"), "project").alias("project_id"))
    return existing.join(ids, "project_id", "left_anti").unionByName(
        incoming, allowMissingColumns=True
    )
