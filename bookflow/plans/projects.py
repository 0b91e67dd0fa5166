"""Queries over several projects at once: rows of one project never meet those of another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.functions.arrays import explode_rows
from bookflow.operators import glossary as G
from bookflow.operators import retrieval as R
from bookflow.operators import work as WK
from bookflow.operators.context import prompt_context
from bookflow.operators.ordering import ordinal
from bookflow.operators.summaries import previous_summaries
from bookflow.plans import sql as S
from bookflow.plans.adapters import CONFIG, bank, pairs, table, terms
from bookflow.plans.registry import query

DOC = ["doc_id"]
# A language is a project; its glossary and bank are every fourth item.
LANGS = ("en", "fr", "de", "es")
_PROJECT_SQL = "CASE {} % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END"


def _project(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LANGS)), (number % 4 + 1).cast("int"))


def _documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").withColumn("project_id", F.col("lang"))


def _terms(spark, sf) -> DataFrame:
    return terms(spark, sf).withColumn("project_id", _project(F.col("term_idx")))


def _bank(spark, sf) -> DataFrame:
    return bank(spark, sf).withColumn("project_id", _project(F.col("item_idx")))


_MATCHED_SQL = S.with_(S.TERMS) + f"""SELECT s.doc_id, s.lang AS project_id, t.term_idx
  FROM documents s JOIN terms t ON s.lang = {_PROJECT_SQL.format('t.term_idx')} AND {S.hits()}"""


@query("glossary_match_projects", _MATCHED_SQL)
def glossary_match(spark, sf):
    found = G.match_terms(_documents(spark, sf), _terms(spark, sf), DOC)
    return found.select("doc_id", "project_id", "term_idx")


@query("glossary_match_projects_by_anchor", _MATCHED_SQL)
def glossary_match_by_anchor(spark, sf):
    found = G.match_terms(_documents(spark, sf), _terms(spark, sf), DOC, small=False)
    return found.select("doc_id", "project_id", "term_idx")


_SCORED_SQL = f"""{S.BANK}, hay AS (
  SELECT item_idx, {_PROJECT_SQL.format('item_idx')} AS project_id, lower(title || {S.LF} || text) AS h FROM bank),
toks AS (SELECT doc_id, lang AS project_id, unnest({S.tokens('text')}) AS token FROM documents),
scored AS (
  SELECT doc_id, project_id, item_idx, CAST(sum(least(6, length(token))) AS BIGINT) AS score
  FROM toks JOIN hay USING (project_id) WHERE contains(h, token) GROUP BY ALL)"""


@query(
    "top_context_projects",
    S.with_(_SCORED_SQL)
    + """SELECT doc_id, project_id, item_idx, score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_idx) AS rank FROM scored)
    WHERE rank <= 3""",
)
def top_context(spark, sf):
    """Blocks of the bank that are cut within and across projects."""
    best = R.best_context(_documents(spark, sf), _bank(spark, sf), 3, block=7)
    rows = explode_rows(best.select(*DOC, "project_id", "retrieved"), "retrieved", pos="pos", item="item")
    return rows.select(*DOC, "project_id", "item.item_idx", "item.score", (F.col("pos") + 1).alias("rank"))


@query("score_context_projects", S.with_(_SCORED_SQL) + "SELECT doc_id, item_idx, score FROM scored")
def score_context(spark, sf):
    """The plan for banks beyond the broadcast bound."""
    return R.score_context(_documents(spark, sf), _bank(spark, sf), DOC, small=False)


_BOOKS_SQL = """chaps AS (
  SELECT lang AS project_id, doc_id, text,
    CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS INTEGER) AS chapter_index FROM documents),
sums AS (SELECT project_id, chapter_index, 'T' || doc_id || '：' || 'S ' || text AS line
  FROM chaps WHERE chapter_index % 3 <> 1)"""


def _chapters(spark, sf) -> DataFrame:
    numbered = ordinal(_documents(spark, sf).select("project_id", "doc_id", "text"), ["project_id"], "doc_id", "n")
    return numbered.select("project_id", "doc_id", "text", F.col("n").cast("int").alias("chapter_index"))


def _summaries(chaps: DataFrame) -> DataFrame:
    return chaps.filter(F.col("chapter_index") % 3 != 1).select(
        "project_id",
        "chapter_index",
        F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"),
        F.concat(F.lit("S "), "text").alias("summary"),
    )


@query(
    "previous_summaries_projects",
    S.with_(_BOOKS_SQL)
    + f"""SELECT project_id, chapter_index, string_agg(line, {S.LF} ORDER BY place) AS previous FROM (
      SELECT c.project_id, c.chapter_index, s.line, s.chapter_index AS place,
        row_number() OVER (PARTITION BY c.project_id, c.chapter_index ORDER BY s.chapter_index DESC) AS rn
      FROM chaps c JOIN sums s ON s.project_id = c.project_id AND s.chapter_index < c.chapter_index
        AND s.chapter_index >= c.chapter_index - 8)
    WHERE rn <= 3 GROUP BY ALL""",
)
def previous(spark, sf):
    """Whole texts as summaries, a book for each project."""
    chaps = _chapters(spark, sf)
    return previous_summaries(chaps, _summaries(chaps))


_CONTEXT_SQL = f"""{_SCORED_SQL}, {S.TERMS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_idx) AS rank FROM scored),
tm AS (SELECT s.doc_id, t.*, row_number() OVER (PARTITION BY s.doc_id ORDER BY t.term_idx) AS rn
  FROM documents s JOIN terms t ON s.lang = {_PROJECT_SQL.format('t.term_idx')} AND {S.hits()}),
tl AS (SELECT doc_id, string_agg({S.TERM_LINE}, {S.LF} ORDER BY term_idx) AS txt FROM tm WHERE rn <= 80 GROUP BY ALL),
td AS (SELECT {_PROJECT_SQL.format('term_idx')} AS lang, string_agg({S.TERM_LINE}, {S.LF} ORDER BY term_idx) AS txt
  FROM terms GROUP BY ALL),
rt AS (SELECT doc_id, string_agg('' || item_idx, ' ' ORDER BY rank) AS items FROM ranked WHERE rank <= 5 GROUP BY ALL)"""


@query(
    "prompt_context_projects",
    S.with_(_CONTEXT_SQL)
    + """SELECT d.doc_id, coalesce(tl.txt, td.txt) AS glossary_text, coalesce(rt.items, '') AS items
    FROM documents d LEFT JOIN tl USING (doc_id) LEFT JOIN td USING (lang) LEFT JOIN rt USING (doc_id)""",
)
def context(spark, sf):
    """Each text sees the glossary, the default terms and the bank of its own project only."""
    docs = _documents(spark, sf)
    segs = docs.select(
        F.col("lang").alias("job_id"), F.col("doc_id").cast("string").alias("segment_id"), "project_id",
        F.col("doc_id").cast("int").alias("chapter_index"), "doc_id", "text",
    )
    no_summaries = _summaries(_chapters(spark, sf)).limit(0)
    shown = prompt_context(segs, _terms(spark, sf), no_summaries, _bank(spark, sf), CONFIG)
    best = R.best_context(docs, _bank(spark, sf), CONFIG.retrieval_count).select(
        "doc_id", F.array_join(F.transform("retrieved", lambda x: x["item_idx"].cast("string")), " ").alias("items")
    )
    return shown.select("doc_id", "glossary_text").join(best, "doc_id")


@query(
    "reset_failed_blank",
    S.with_(S.PAIRS)
    + """SELECT job_id, segment_id, CASE WHEN status = 'failed' OR status IN ('completed', 'cached') AND
      chapter_index % 3 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN status = 'failed' OR
      status IN ('completed', 'cached') AND chapter_index % 3 = 0 THEN NULL ELSE 'e' END AS error FROM pairs""",
)
def reset_failed_blank(spark, sf):
    """Blank results are redone too."""
    blank = F.when(F.col("chapter_index") % 3 == 0, "").otherwise(F.col("translated_text"))
    rows = pairs(spark, sf).withColumns({"translated_text": blank, "error": F.lit("e")})
    return WK.reset_failed(rows, include_empty=True).select("job_id", "segment_id", "status", "error")
