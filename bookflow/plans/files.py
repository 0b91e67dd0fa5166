"""Queries of the readers and writers, over files that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.operators.tables import OPEN, order_listing
from bookflow.plans import sql as S
from bookflow.plans.adapters import bank, chapters, documents, table
from bookflow.plans.registry import query
from bookflow.session import PACKED, materialize, scratch_dir, wide_rows
from bookflow.sinks.epub import (
    PAGE_HEAD,
    PAGE_STYLE,
    write_epubs,
)
from bookflow.sinks.projects import export_projects, project_lines, write_documents, write_lines
from bookflow.sinks.text import book_text, write_book_text
from bookflow.sources import epub as E
from bookflow.sources import projects as PJ
from bookflow.sources.books import parse_files
from bookflow.sources.text_files import decode_books, read_text_books


# Ends a document in a file of many.
END = "<end of document>"


def write_text_files(docs: DataFrame, path: str) -> None:
    """Documents as .txt files in a folder per source, many documents to a file, with a mark after each."""
    rows = docs.select("source", F.concat("text", F.lit(END)).alias("value"))
    rows.write.option("maxRecordsPerFile", 10000).partitionBy("source").text(path)


def texts_of(text: Column) -> Column:
    """The documents of a file that ``write_text_files`` wrote."""
    parts = F.split(text, f"{END}\\n")
    return F.slice(parts, 1, F.size(parts) - 1)


def source_of(book_id: Column) -> Column:
    return F.regexp_extract(book_id, "source=([^/]*)/", 1)


# --- text books -------------------------------------------------------------------------------------


@query(
    "decode_books",
    """SELECT CAST(doc_id AS VARCHAR) AS book_id, CAST(0 AS DOUBLE) AS score,
      CASE WHEN doc_id % 2 = 0 THEN 'utf-8' ELSE 'utf-16le' END AS encoding, text FROM documents""",
)
def decode(spark, sf):
    text = F.col("text")
    content = F.when(F.col("doc_id") % 2 == 0, F.encode(text, "UTF-8")).otherwise(
        F.encode(text, "UTF-16LE")
    )
    files = documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("book_id"), F.lit("").alias("name"), content.alias("content")
    )
    return decode_books(files).drop("name")


@query(
    "read_text_books",
    """SELECT source, 'utf-8' AS encoding, text FROM documents""",
)
def text_books(spark, sf):
    path = f"{scratch_dir(spark)}/texts"
    write_text_files(table(spark, sf, "documents"), path)
    books = read_text_books(spark, path)
    return books.select(
        source_of(F.col("book_id")).alias("source"), "encoding", F.explode(texts_of(F.col("text"))).alias("text")
    )


# --- EPUB ------------------------------------------------------------------------------------------------


def _archives(spark: SparkSession, sf: str) -> DataFrame:
    """Every source as an EPUB file in the scratch folder."""
    chaps = chapters(spark, sf).select(
        "book_id",
        F.concat(F.lit("B & "), "book_id").alias("book_title"),
        "chapter_index",
        "title",
        "text",
    )
    return write_epubs(chaps, f"{scratch_dir(spark)}/epubs").select(
        "book_id",
        F.concat("book_id", F.lit(".epub")).alias("name"),
        F.lit(".epub").alias("ext"),
        F.lit(None).cast("binary").alias("content"),
        "path",
    )


_PAGE = f"""'{PAGE_HEAD}' || {S.escape('title')} || '{PAGE_STYLE}' || {S.escape('title')} || '</h1>'
  || array_to_string(list_transform({S.paras('text')}, lambda v: '<p>' || {S.escape('v')} || '</p>'), {S.LF})
  || '</body></html>'"""


@query(
    "book_epub",
    S.with_(S.BOOKS)
    + f"""SELECT book_id, 'OEBPS/chapters/chapter-' || (chapter_index + 1) || '.xhtml' AS member_path,
      {_PAGE} AS page FROM books""",
)
def epub_pages(spark, sf):
    members = E.read_epub_members(_archives(spark, sf))
    pages = members.filter(F.contains("member_path", F.lit("/chapters/")))
    return pages.select("book_id", "member_path", F.col("bytes").cast("string").alias("page"))


@query(
    "read_epub_members",
    S.with_(S.BOOKS)
    + """SELECT book_id, 'OEBPS/chapters/chapter-' || (chapter_index + 1) || '.xhtml' AS member_path FROM books
    UNION ALL SELECT DISTINCT source, m FROM documents, (VALUES ('mimetype'), ('META-INF/container.xml'),
      ('OEBPS/style.css'), ('OEBPS/nav.xhtml'), ('OEBPS/content.opf')) AS v(m)""",
)
def epub_member_rows(spark, sf):
    return E.read_epub_members(_archives(spark, sf)).select("book_id", "member_path")


@query(
    "epub_spine",
    S.with_(S.BOOKS)
    + """SELECT book_id, chapter_index AS pos,
      'OEBPS/chapters/chapter-' || (chapter_index + 1) || '.xhtml' AS href FROM books""",
)
def spine(spark, sf):
    return E.epub_spine(E.package_files(E.open_archives(_archives(spark, sf))))


@query(
    "read_books_chapters",
    S.with_(S.BOOKS)
    + f"""SELECT book_id, chapter_index, title,
      'OEBPS/chapters/chapter-' || (chapter_index + 1) || '.xhtml' AS source_path,
      {S.normal(f"title || {S.LF} || title || {S.LF} || array_to_string({S.paras('text')}, {S.LF})")} AS text
    FROM books""",
)
def epub_round_trip(spark, sf):
    return parse_files(_archives(spark, sf)).chapters


@query(
    "read_books",
    """SELECT source AS book_id, source || '.epub' AS name, 'B & ' || source AS title, 'epub' AS format,
      NULL AS encoding, count(*) + 5 AS files, NULL AS reason FROM documents GROUP BY source
    UNION ALL SELECT 't' || doc_id, 't' || doc_id || '.TXT', 't' || doc_id, 'txt', 'utf-8', NULL, NULL
      FROM documents WHERE doc_id % 3 = 0
    UNION ALL SELECT 't' || doc_id, 't' || doc_id || '.pdf', NULL, NULL, NULL, NULL,
      'Only .txt and .epub files are supported' FROM documents WHERE doc_id % 3 = 1
    UNION ALL SELECT 't' || doc_id, 't' || doc_id || '.epub', NULL, NULL, NULL, NULL,
      'Invalid EPUB: not a readable archive' FROM documents WHERE doc_id % 3 = 2""",
)
def books_of_all_formats(spark, sf):
    kind = F.col("doc_id") % 3
    ext = F.when(kind == 0, ".txt").when(kind == 1, ".pdf").otherwise(".epub")
    name = F.concat(F.lit("t"), F.col("doc_id").cast("string"))
    loose = documents(spark, sf).select(
        name.alias("book_id"),
        F.concat(name, F.when(kind == 0, ".TXT").otherwise(ext)).alias("name"),
        ext.alias("ext"),
        F.encode("text", "UTF-8").alias("content"),
    )
    library = parse_files(_archives(spark, sf).unionByName(loose, allowMissingColumns=True))
    reason = F.regexp_replace("reason", "(readable archive).*", "$1")
    return library.books.unionByName(
        library.rejects.withColumn("reason", reason), allowMissingColumns=True
    )


# --- text export ---------------------------------------------------------------------------------------------


def _results(spark, sf):
    return chapters(spark, sf).select(
        "book_id", "chapter_index", "title", F.col("text").alias("translated_text")
    )


_BLOCK = S.trim(f"'# ' || title || {S.LF} || {S.LF} || text")


@query(
    "book_text",
    S.with_(S.BOOKS)
    + f"""SELECT book_id, chapter_index, CASE WHEN chapter_index = 0 THEN '' ELSE repeat({S.LF}, 3) END
      || {_BLOCK} AS part FROM books""",
)
def book_text_parts(spark, sf):
    return book_text(_results(spark, sf))


@query(
    "write_book_text",
    S.with_(S.BOOKS)
    + f"""SELECT book_id, CAST(sum(length({_BLOCK}) + 3) - 2 AS BIGINT) AS chars FROM books GROUP BY book_id""",
)
def written_text(spark, sf):
    path = f"{scratch_dir(spark)}/export"
    write_book_text(_results(spark, sf), path)
    files = spark.read.text(path, wholetext=True)
    return files.groupBy("book_id").agg(F.sum(F.length("value")).alias("chars"))


# --- project documents ------------------------------------------------------------------------------------------


def _exported(spark, sf, chaps=None):
    chaps = chapters(spark, sf) if chaps is None else chaps
    chaps = chaps.withColumn("project_id", F.col("book_id"))
    header = chaps.select("project_id").distinct().select(
        "project_id",
        F.col("project_id").alias("id"),
        F.concat(F.lit("P "), "project_id").alias("title"),
        F.create_map(F.lit("provider"), F.lit("demo")).alias("settings"),
        F.lit("2024-01-01T00:00:00.000Z").alias("createdAt"),
    )
    items = bank(spark, sf).select(
        F.concat(F.lit("src"), (F.col("item_idx") % 20).cast("string")).alias("project_id"),
        "item_idx",
        "id",
        "title",
        "text",
    )
    sections = {
        "chapters": (chaps.select("project_id", "chapter_index", "title", "text"), "chapter_index"),
        "results": (
            chaps.select(
                "project_id",
                "chapter_index",
                "title",
                F.col("text").alias("sourceText"),
                F.concat(F.lit("T "), "text").alias("translatedText"),
            ),
            "chapter_index",
        ),
        "contextBank": (items, "item_idx"),
    }
    return header, sections


_EXPORTED = """SELECT book_id AS project_id, 'chapters' AS section, chapter_index AS pos, title, text FROM books
    UNION ALL SELECT book_id, 'results', chapter_index, title, 'T ' || text FROM books
    UNION ALL SELECT 'src' || (item_id % 20), 'contextBank',
      row_number() OVER (PARTITION BY item_id % 20 ORDER BY item_id) - 1,
      CASE WHEN item_id % 2 = 0 THEN 'Item ' || item_id ELSE '' END, text FROM benchmark"""


def _stamp() -> Column:
    return F.to_timestamp(F.lit("2024-06-01 00:00:00"))


def _section(df: DataFrame, section: str, pos: str, text: str) -> DataFrame:
    return df.select(
        "project_id", F.lit(section).alias("section"), F.col(pos).cast("long").alias("pos"), "title",
        F.col(text).alias("text"),
    )


@query("export_projects", S.with_(S.BOOKS) + _EXPORTED)
def exported_rows(spark, sf):
    """Documents written as files, one per project, and read back whole."""
    path, kept = f"{scratch_dir(spark)}/documents", scratch_dir(spark)
    with wide_rows(spark):
        chaps = materialize(chapters(spark, sf), "chapters", kept, **PACKED)
        header, sections = _exported(spark, sf, chaps)
        write_documents(export_projects(header, sections, _stamp()), path, len(sections), spent=kept)
        docs = materialize(PJ.read_projects(spark, path), "read", **PACKED)
    return (
        _section(PJ.project_chapters(docs), "chapters", "chapter_index", "text")
        .unionByName(_section(PJ.project_results(docs), "results", "result_index", "translatedText"))
        .unionByName(_section(PJ.project_bank(docs), "contextBank", "item_idx", "text"))
    )


@query(
    "export_project_lines",
    S.with_(S.BOOKS)
    + _EXPORTED.replace(
        """row_number() OVER (PARTITION BY item_id % 20 ORDER BY item_id) - 1""", "item_id"
    ),
)
def exported_lines(spark, sf):
    """The other form: lines written as files and read back."""
    path = f"{scratch_dir(spark)}/lines"
    write_lines(project_lines(*_exported(spark, sf)), path)
    lines = PJ.read_lines(spark, path)
    return (
        _section(PJ.line_rows(lines, "chapters", "chapter_index"), "chapters", "chapter_index", "text")
        .unionByName(_section(PJ.line_rows(lines, "results", "result_index"), "results", "result_index", "translatedText"))
        .unionByName(_section(PJ.line_rows(lines, "contextBank", "item_idx"), "contextBank", "item_idx", "text"))
    )


@query(
    "import_projects",
    """SELECT source AS project_id, 'P ' || source AS title, '2024-01-01' AS created_at,
      '2024-06-02' AS updated_at, 'kept' AS glossary, 'demo' AS provider
    FROM documents GROUP BY source""",
)
def imported(spark, sf):
    header, sections = _exported(spark, sf)
    half = F.col("number") % 2
    numbered = header.withColumn("number", F.substring("project_id", 4, 9).cast("int"))
    whole = export_projects(numbered.filter(half == 0).drop("number"), sections, _stamp())
    lines = project_lines(numbered.filter(half == 1).drop("number"), {})
    path = f"{scratch_dir(spark)}/documents"
    write_documents(whole, path)
    docs = PJ.read_projects(spark, path).unionByName(PJ.line_headers(lines))
    existing = chapters(spark, sf).select(F.col("book_id").alias("project_id")).distinct().select(
        "project_id",
        F.lit("old").alias("title"),
        F.lit("kept").alias("glossary"),
        F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("created_at"),
        F.to_timestamp(F.lit("2024-01-02 00:00:00")).alias("updated_at"),
    )
    out = PJ.import_projects(docs, existing, F.to_timestamp(F.lit("2024-06-02 00:00:00")))
    return order_listing(out).select(
        "project_id",
        "title",
        "glossary",
        F.col("settings")["provider"].alias("provider"),
        *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("created_at", "updated_at")],
    )


@query(
    "import_open_fields",
    """SELECT source AS project_id, CAST(count(*) AS VARCHAR) AS mood_n, 'new ' || source AS mood_name,
      'kept ' || source AS shelf, CAST(sum(length(text)) AS VARCHAR) AS rank, max(lang) AS genre,
      CAST(NULL AS VARCHAR) AS api_key, 'P ' || source AS title
    FROM documents GROUP BY source""",
)
def open_fields(spark, sf):
    """Fields that no schema names live through import, upsert and export."""
    docs = table(spark, sf, "documents").groupBy("source").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("rank"), F.max("lang").alias("genre")
    )
    mood = F.struct("n", F.concat(F.lit("new "), "source").alias("name"))
    title = F.concat(F.lit("P "), "source").alias("title")
    text = F.to_json(F.struct(F.col("source").alias("id"), title, mood.alias("mood"), "rank", F.lit("k").alias("apiKey")))
    older = F.to_json(F.struct(F.lit("old").alias("mood"), F.concat(F.lit("kept "), "source").alias("shelf"), "genre"))
    existing = docs.select(
        F.col("source").alias("project_id"),
        F.lit("old").alias("title"),
        F.from_json(older, OPEN).alias("extra"),
        _stamp().alias("created_at"),
        _stamp().alias("updated_at"),
    )
    path = f"{scratch_dir(spark)}/open"
    write_documents(docs.select(F.col("source").alias("project_id"), text.alias("json")), path)
    merged = PJ.import_projects(PJ.read_projects(spark, path), existing, _stamp())
    out = export_projects(merged.drop("settings"), {}, _stamp())

    def field(at: str, name: str) -> Column:
        return F.get_json_object("json", f"$.{at}").alias(name)

    places = {"mood.n": "mood_n", "mood.name": "mood_name", "shelf": "shelf", "rank": "rank", "genre": "genre", "apiKey": "api_key", "title": "title"}
    return out.select("project_id", *[field(at, name) for at, name in places.items()])
