"""Queries of chapters, segments, glossary and context-bank parsing, and keyed tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bookflow import constants as C
from bookflow.functions.arrays import explode_rows
from bookflow.operators import chapters as CH
from bookflow.operators import glossary as G
from bookflow.operators import retrieval as R
from bookflow.operators import segments as SG
from bookflow.operators import tables as TB
from bookflow.plans import sql as S
from bookflow.plans.adapters import bank, chapters, documents, segments, table, terms
from bookflow.plans.registry import query


def _text() -> Column:
    return F.col("text")


def _with_headings(text: Column) -> Column:
    """A heading line before every third line."""
    headed = F.transform(
        F.split(text, "\n"),
        lambda line, i: F.when(
            i % 3 == 0,
            F.concat(F.lit("Chapter "), (F.floor(i / 3) + 1).cast("string"), F.lit("\n"), line),
        ).otherwise(line),
    )
    return F.array_join(headed, "\n")


# every document is a book of its own; odd ones keep their text without headings
_HEADED = f"""src AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS book_id, CASE WHEN doc_id % 2 = 0 THEN
    array_to_string(list_transform({S.lines('text')}, lambda v, i:
      CASE WHEN (i - 1) % 3 = 0 THEN 'Chapter ' || ((i - 1) // 3 + 1) || {S.LF} || v ELSE v END), {S.LF})
    ELSE text END AS text FROM documents),
norm AS (SELECT book_id, {S.normal('text')} AS text FROM src),
ls AS (SELECT book_id, unnest({S.lines('text')}) AS line,
         generate_subscripts({S.lines('text')}, 1) AS i FROM norm),
flagged AS (SELECT *, CAST(regexp_matches({S.trim('line')}, '{C.HEADING_PATTERN}') AS INTEGER) AS h FROM ls),
counted AS (SELECT *, sum(h) OVER (PARTITION BY book_id ORDER BY i) AS k,
              sum(h) OVER (PARTITION BY book_id) AS n FROM flagged)"""


def _headed_books(spark, sf):
    headed = F.when(F.col("doc_id") % 2 == 0, _with_headings(_text())).otherwise(_text())
    return documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("book_id"), headed.alias("text")
    )


@query(
    "split_chapters_by_heading",
    S.with_(_HEADED)
    + f"""SELECT book_id, CAST(k - 1 AS BIGINT) AS chapter_index,
      {S.trim('max(CASE WHEN h = 1 THEN line END)')} AS title,
      {S.trim(f"string_agg(line, {S.LF} ORDER BY i)")} AS text
    FROM counted WHERE n >= 2 AND k > 0 GROUP BY book_id, k""",
)
def split_by_heading(spark, sf):
    split = CH.split_chapters(_headed_books(spark, sf))
    return split.filter(~F.startswith(F.col("title"), F.lit("Part ")))


@query(
    "split_chapters_fixed_parts",
    S.with_(_HEADED, "few AS (SELECT DISTINCT book_id FROM counted WHERE n < 2)")
    + f"""SELECT book_id, i AS chapter_index, 'Part ' || (i + 1) AS title,
      {S.trim('substring(text, i * 9000 + 1, 9000)')} AS text
    FROM (SELECT book_id, text, unnest(range(0, CAST(ceil(length(text) / 9000.0) AS BIGINT))) AS i
          FROM norm JOIN few USING (book_id))""",
)
def split_fixed(spark, sf):
    split = CH.split_chapters(_headed_books(spark, sf))
    return split.filter(F.startswith(F.col("title"), F.lit("Part ")))


@query(
    "select_chapters",
    S.with_(S.BOOKS)
    + "SELECT book_id, chapter_index, title FROM books WHERE chapter_index BETWEEN 2 AND 6",
)
def select_chapters(spark, sf):
    return CH.select_chapters(chapters(spark, sf), 7, 3).select("book_id", "chapter_index", "title")


@query(
    "clean_chapters",
    S.with_(S.BOOKS)
    + """SELECT book_id, chapter_index, text,
      CASE WHEN chapter_index % 4 = 0 THEN '第 ' || (chapter_index + 1) || ' 章' ELSE title END AS title
    FROM books WHERE chapter_index % 5 <> 2""",
)
def clean_chapters(spark, sf):
    n = F.col("chapter_index")
    holed = chapters(spark, sf).withColumns(
        {
            "title": F.when(n % 4 == 0, "").otherwise(F.col("title")),
            "text": F.when(n % 5 == 2, " \n\t　").otherwise(_text()),
        }
    )
    return CH.clean_chapters(holed).select("book_id", "chapter_index", "title", "text")


@query(
    "pack_segments",
    f"""SELECT doc_id, generate_subscripts(ps, 1) - 1 AS pos, unnest(ps) AS text
    FROM (SELECT doc_id, {S.pieces('text', 600)} AS ps FROM documents)""",
)
def pack_segments(spark, sf):
    packed = SG.pack_segments(documents(spark, sf).select("doc_id", "text"), 600)
    return explode_rows(packed, "pieces", pos="pos", item="text")


@query(
    "slice_segments",
    f"""SELECT doc_id, i AS pos, substring(t, i * 1800 + 1, 1800) AS text
    FROM (SELECT doc_id, t, unnest(range(0, CAST(ceil(length(t) / 1800.0) AS BIGINT))) AS i
          FROM (SELECT doc_id, {S.trim('text')} AS t FROM documents))""",
)
def slice_segments(spark, sf):
    cut = SG.slice_segments(documents(spark, sf).select("doc_id", "text"), 1800)
    return explode_rows(cut, "pieces", pos="pos", item="text")


@query(
    "build_segments",
    S.with_(S.SEGMENTS)
    + """SELECT job_id, segment_id, chapter_index, chapter_title, segment_index, segments_total, text,
      'pending' AS status, CAST(0 AS BIGINT) AS attempts FROM segments""",
)
def build_segments(spark, sf):
    return segments(spark, sf).drop("project_id")


# --- parsers ---------------------------------------------------------------------------------------


def _glossary_text(words: Column) -> Column:
    def line(w: Column, i: Column) -> Column:
        n = i.cast("string")
        return (
            F.when(i % 6 == 0, F.concat(F.lit("# "), w))
            .when(i % 6 == 1, F.concat(w, F.lit(" => "), F.upper(w), F.lit(" # n"), n))
            .when(i % 6 == 2, F.concat(w, F.lit("：x"), w))
            .when(i % 6 == 3, F.concat(w, F.lit("=")))
            .when(i % 6 == 4, w)
            .otherwise(F.concat(F.lit("  "), w, F.lit(" -> "), w, F.lit("2 // note "), n, F.lit(" // x")))
        )

    return F.array_join(F.transform(words, line), "\r\n")


@query(
    "parse_glossary",
    f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]{{3,}}') AS w FROM documents),
    l AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM w),
    raw AS (SELECT doc_id, i, {S.trim('''CASE i % 6 WHEN 0 THEN '# ' || w
        WHEN 1 THEN w || ' => ' || upper(w) || ' # n' || i
        WHEN 2 THEN w || '：x' || w WHEN 3 THEN w || '=' WHEN 4 THEN w
        ELSE '  ' || w || ' -> ' || w || '2 // note ' || i || ' // x' END''')} AS line FROM l),
    m AS (SELECT *, regexp_extract(line, '{G.LINE_PATTERN}', 1) AS src,
        string_split_regex(regexp_extract(line, '{G.LINE_PATTERN}', 2), '{G.NOTE_SPLIT}') AS parts
      FROM raw WHERE line <> '' AND line NOT LIKE '#%')
    SELECT CAST(doc_id AS VARCHAR) AS project_id, i AS term_idx, 'term-' || (i + 1) AS id,
      CASE WHEN src <> '' THEN {S.trim('src')} ELSE line END AS source,
      CASE WHEN src <> '' THEN {S.trim('parts[1]')} ELSE '' END AS target,
      CASE WHEN src <> '' THEN coalesce({S.trim('parts[2]')}, '') ELSE '' END AS note
    FROM m""",
)
def parse_glossary(spark, sf):
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))
    raw = documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("project_id"), _glossary_text(words).alias("glossary")
    )
    return G.parse_glossary(raw).select("project_id", "term_idx", "id", "source", "target", "note")


@query(
    "normalize_terms",
    """WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]{3,}') AS w FROM documents)
    SELECT doc_id AS term_idx, CASE WHEN doc_id % 2 = 0 THEN 'id' || doc_id ELSE coalesce(w[1], w[2]) END AS id,
      w[1] AS source, coalesce(w[2], '') AS target,
      array_to_string(list_filter([w[3], w[4], w[5]], lambda v: v IS NOT NULL), ' ') AS aliases,
      CASE WHEN doc_id % 3 = 0 THEN 'a note' ELSE '' END AS note,
      CASE WHEN doc_id % 5 = 0 THEN 'place' ELSE 'term' END AS category, 'contains' AS match_type
    FROM w WHERE w[1] IS NOT NULL""",
)
def normalize_terms(spark, sf):
    n, w = F.col("doc_id"), F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))

    def word(i: int) -> Column:
        return F.get(F.col("w"), F.lit(i))

    record = F.to_json(
        F.struct(
            F.when(n % 2 == 0, F.concat(F.lit("id"), n.cast("string"))).alias("id"),
            F.when(n % 3 == 0, word(0)).alias("source"),
            F.when(n % 3 == 1, F.concat(F.lit(" "), word(0))).alias("original"),
            F.when(n % 3 == 2, word(0)).alias("term"),
            F.when(n % 2 == 0, word(1)).alias("translation"),
            F.when(n % 2 == 1, word(1)).alias("output"),
            F.concat_ws("，", word(2), F.concat_ws(" | ", word(3), word(4))).alias("aliases"),
            F.when(n % 3 == 0, " a note ").alias("description"),
            F.when(n % 5 == 0, "place").alias("type"),
        )
    )
    schema = (
        "id string, source string, original string, term string, translation string, "
        "output string, aliases string, description string, type string"
    )
    docs = documents(spark, sf).withColumn("w", w)
    rows = docs.select("project_id", n.alias("term_idx"), F.from_json(record, schema).alias("r"))
    out = G.normalize_terms(rows.select("project_id", "term_idx", "r.*"))
    return out.withColumn("aliases", F.array_join("aliases", " ")).drop("project_id")


_BLOCKS = f"""raw AS (
  SELECT doc_id, array_to_string(list_transform({S.lines('text')}, lambda v, i:
    CASE WHEN (i - 1) % 4 = 3 THEN v || {S.LF} ELSE v END), {S.LF}) AS raw FROM documents),
blocks AS (
  SELECT doc_id, unnest(bs) AS block, generate_subscripts(bs, 1) - 1 AS item_idx FROM (
    SELECT doc_id, list_filter(list_transform(string_split_regex(raw, '\\n{{2,}}'),
      lambda v: {S.trim('v')}), lambda v: v <> '') AS bs FROM raw)),
split AS (SELECT doc_id, item_idx, {S.paras('block')} AS ls FROM blocks)"""


@query(
    "parse_context_bank",
    S.with_(_BLOCKS)
    + f"""SELECT CAST(doc_id AS VARCHAR) AS project_id, item_idx, 'ctx-' || (item_idx + 1) AS id,
      CASE WHEN len(ls) > 1 AND length(ls[1]) <= 80 THEN ls[1] ELSE '资料 ' || (item_idx + 1) END AS title,
      array_to_string(CASE WHEN len(ls) > 1 AND length(ls[1]) <= 80 THEN ls[2:] ELSE ls END, {S.LF}) AS text
    FROM split""",
)
def parse_context_bank(spark, sf):
    spaced = F.array_join(
        F.transform(
            F.split("text", "\n"),
            lambda line, i: F.when(i % 4 == 3, F.concat(line, F.lit("\n"))).otherwise(line),
        ),
        "\n",
    )
    raw = documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("project_id"), spaced.alias("context_bank")
    )
    return R.parse_context_bank(raw)


@query(
    "serialize_context_bank",
    S.with_(S.BANK)
    + f"""SELECT project_id, item_idx, CASE WHEN item_idx = (SELECT min(item_idx) FROM bank) THEN ''
      ELSE {S.LF} || {S.LF} END || CASE WHEN title <> '' THEN title || {S.LF} ELSE '' END || text AS part
    FROM bank""",
)
def serialize_context_bank(spark, sf):
    return R.serialize_context_bank(bank(spark, sf))


@query(
    "format_terms",
    S.with_(S.TERMS)
    + f"""SELECT term_idx // 10 AS block, string_agg({S.TERM_LINE}, {S.LF} ORDER BY term_idx) AS prompt_text
    FROM terms GROUP BY 1""",
)
def format_terms(spark, sf):
    grouped = (
        terms(spark, sf)
        .groupBy(F.floor(F.col("term_idx") / 10).cast("long").alias("block"))
        .agg(F.sort_array(F.collect_list(G._term())).alias("ts"))
    )
    return grouped.select("block", G.format_terms(F.col("ts")).alias("prompt_text"))


# --- keyed tables --------------------------------------------------------------------------------------


def _now() -> Column:
    return F.to_timestamp(F.lit("2024-06-01 00:00:00"))


_STAMP = "yyyy-MM-dd HH:mm:ss"


@query(
    "upsert",
    """SELECT doc_id, CASE WHEN doc_id % 3 <> 0 AND doc_id % 4 <> 0 THEN 'new ' || lang
        WHEN doc_id % 2 = 0 THEN lang ELSE NULL END AS title,
      CASE WHEN doc_id % 2 = 0 THEN source END AS source,
      CASE WHEN doc_id % 2 = 0 THEN '2023-01-01 00:00:00' ELSE '2024-06-01 00:00:00' END AS created_at,
      CASE WHEN doc_id % 3 <> 0 THEN '2024-06-01 00:00:00' ELSE '2023-02-01 00:00:00' END AS updated_at
    FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 <> 0""",
)
def upsert(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    n = F.col("doc_id")
    old = docs.filter(n % 2 == 0).select(
        "doc_id",
        F.col("lang").alias("title"),
        "source",
        F.to_timestamp(F.lit("2023-01-01 00:00:00")).alias("created_at"),
        F.to_timestamp(F.lit("2023-02-01 00:00:00")).alias("updated_at"),
    )
    new = docs.filter(n % 3 != 0).select(
        "doc_id", F.when(n % 4 != 0, F.concat(F.lit("new "), "lang")).alias("title")
    )
    out = TB.upsert(old, new, ["doc_id"], _now())
    return out.withColumns(
        {c: F.date_format(c, _STAMP) for c in ("created_at", "updated_at")}
    )


@query(
    "union_jobs",
    """SELECT doc_id, array_to_string(list_concat(['job-1', 'job-2'],
      CASE WHEN doc_id % 4 IN (1, 2) THEN [] ELSE ['job-' || (doc_id % 4)] END), ' ') AS job_ids
    FROM documents""",
)
def union_jobs(spark, sf):
    new = F.concat(F.lit("job-"), (F.col("doc_id") % 4).cast("string"))
    ids = TB.union_ids(F.array(F.lit("job-1"), F.lit("job-2")), new)
    return table(spark, sf, "documents").select("doc_id", F.array_join(ids, " ").alias("job_ids"))


@query(
    "distinct_jobs",
    "SELECT DISTINCT source AS project_id, lang AS job_id FROM documents",
)
def distinct_jobs(spark, sf):
    docs = table(spark, sf, "documents")
    return TB.distinct_jobs(docs.select(F.col("source").alias("project_id"), F.col("lang").alias("job_id")))


@query(
    "redact_config",
    """SELECT source AS job_id, '{"provider":"demo","model":"' || max(lang) || '"}' AS config
    FROM documents GROUP BY source""",
)
def redact_config(spark, sf):
    jobs = table(spark, sf, "documents").groupBy(F.col("source").alias("job_id")).agg(
        F.max("lang").alias("model"), F.max(F.sha2("text", 256)).alias("secret")
    )
    full = jobs.select(
        "job_id",
        F.col("secret").alias("api_key"),
        F.struct(F.lit("demo").alias("provider"), "model", F.col("secret").alias("apiKey")).alias("config"),
    )
    return TB.redact(full).select("job_id", F.to_json("config").alias("config"))


@query(
    "order_listing",
    "SELECT doc_id, strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * doc_id, '%Y-%m-%d %H:%M:%S') AS updated_at FROM documents",
)
def order_listing(spark, sf):
    start = F.unix_timestamp(F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    rows = table(spark, sf, "documents").select(
        "doc_id", F.timestamp_seconds(start + F.col("doc_id") * 60).alias("updated_at")
    )
    return TB.order_listing(rows).withColumn("updated_at", F.date_format("updated_at", _STAMP))


