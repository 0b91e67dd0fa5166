"""Queries of glossary matching, context retrieval and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookflow.config import Preset, JobConfig
from bookflow.functions.arrays import explode_rows
from bookflow.operators import glossary as G
from bookflow.operators import requests as RQ
from bookflow.operators import retrieval as R
from bookflow.operators import summaries as SM
from bookflow.operators.context import prompt_context, prompt_messages
from bookflow.plans import sql as S
from bookflow.plans.adapters import CONFIG, bank, chapters, documents, segments, summaries, table, terms
from bookflow.plans.registry import query
from bookflow.session import materialize, scratch_dir

DOC = ["doc_id"]

# --- glossary -----------------------------------------------------------------------------------------

_MATCHED = f"""{S.TERMS}, matched AS (
  SELECT s.doc_id, t.*, row_number() OVER (PARTITION BY s.doc_id ORDER BY t.term_idx) AS rn
  FROM documents s JOIN terms t ON {S.hits()})"""
_PAIRS_SQL = S.with_(_MATCHED) + "SELECT doc_id, term_idx FROM matched"


@query("glossary_match", _PAIRS_SQL)
def glossary_match(spark, sf):
    return G.match_terms(documents(spark, sf), terms(spark, sf), DOC).select("doc_id", "term_idx")


@query("glossary_match_by_anchor", _PAIRS_SQL)
def glossary_match_by_anchor(spark, sf):
    """The plan for glossaries beyond the broadcast bound."""
    found = G.match_terms(documents(spark, sf), terms(spark, sf), DOC, small=False)
    return found.select("doc_id", "term_idx")


@query("first_terms", S.with_(_MATCHED) + "SELECT doc_id, term_idx FROM matched WHERE rn <= 3")
def first_terms(spark, sf):
    found = G.match_terms(documents(spark, sf), terms(spark, sf), DOC)
    return G.first_terms(found, DOC, 3).select("doc_id", "term_idx")


@query(
    "terms_or_default",
    S.with_(_MATCHED)
    + """SELECT doc_id, term_idx FROM matched WHERE rn <= 5 UNION ALL
    SELECT d.doc_id, t.term_idx FROM documents d,
      (SELECT term_idx FROM terms ORDER BY term_idx LIMIT 5) t
    WHERE d.doc_id NOT IN (SELECT doc_id FROM matched)""",
)
def terms_or_default(spark, sf):
    docs, glossary = documents(spark, sf), terms(spark, sf)
    found = G.match_terms(docs, glossary, DOC)
    return G.terms_or_default(docs, found, glossary, DOC, 5).select("doc_id", "term_idx")


_SHOWN = f"""{_MATCHED}, firsts AS (
  SELECT *, row_number() OVER (ORDER BY term_idx) AS rn FROM terms),
prompts AS (
  SELECT doc_id, string_agg({S.TERM_LINE}, {S.LF} ORDER BY term_idx) AS txt, count(*) AS n
  FROM matched WHERE rn <= 80 GROUP BY doc_id),
dflt AS (SELECT string_agg({S.TERM_LINE}, {S.LF} ORDER BY term_idx) AS txt FROM firsts WHERE rn <= 80)"""


@query(
    "glossary_preview",
    S.with_(_SHOWN)
    + """SELECT d.doc_id, coalesce(p.n, 0) AS matched, coalesce(p.txt, dflt.txt) AS prompt_text
    FROM documents d LEFT JOIN prompts p USING (doc_id), dflt""",
)
def glossary_preview(spark, sf):
    shown = G.glossary_preview(documents(spark, sf), terms(spark, sf), DOC)
    return shown.withColumn("matched", F.size("matched"))


@query(
    "glossary_preview_by_anchor",
    S.with_(_SHOWN)
    + """SELECT d.doc_id, coalesce(p.n, 0) AS matched, coalesce(p.txt, dflt.txt) AS prompt_text
    FROM documents d LEFT JOIN prompts p USING (doc_id), dflt""",
)
def glossary_preview_by_anchor(spark, sf):
    shown = G.glossary_preview(documents(spark, sf), terms(spark, sf), DOC, small=False)
    return shown.withColumn("matched", F.size("matched"))


# --- retrieval ------------------------------------------------------------------------------------------


def _scored(source: str, key: str) -> str:
    return f"""{S.BANK}, hay AS (SELECT item_idx, lower(title || {S.LF} || text) AS h FROM bank),
toks AS (SELECT {key}, unnest({S.tokens('text')}) AS token FROM {source}),
scored AS (
  SELECT {key}, item_idx, CAST(sum(least(6, length(token))) AS BIGINT) AS score
  FROM toks JOIN hay ON contains(h, token) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, item_idx) AS rank
  FROM scored)"""


_SCORED_DOCS = _scored("documents", "doc_id")


@query("score_context", S.with_(_SCORED_DOCS) + "SELECT doc_id, item_idx, score FROM scored")
def score_context(spark, sf):
    return R.score_context(documents(spark, sf), bank(spark, sf), DOC)


@query(
    "score_context_large_bank", S.with_(_SCORED_DOCS) + "SELECT doc_id, item_idx, score FROM scored"
)
def score_context_large_bank(spark, sf):
    """The plan for banks beyond the broadcast bound."""
    docs, items = documents(spark, sf), bank(spark, sf)
    return R.score_context(docs, items, DOC, small=False)


@query(
    "top_context",
    S.with_(_SCORED_DOCS) + "SELECT doc_id, item_idx, score, rank FROM ranked WHERE rank <= 5",
)
def top_context(spark, sf):
    best = R.best_context(documents(spark, sf), bank(spark, sf), 5, block=50)
    ranked = explode_rows(best.select(*DOC, "retrieved"), "retrieved", pos="pos", item="item")
    return ranked.select(*DOC, "item.item_idx", "item.score", (F.col("pos") + 1).alias("rank"))


# --- summaries --------------------------------------------------------------------------------------------

_PREVIOUS = f"""{S.BOOKS}, {S.SUMMARIES}, lined AS (
  SELECT job_id, chapter_index, CASE WHEN title <> '' THEN title
    ELSE '第 ' || (chapter_index + 1) || ' 章' END || '：' || summary AS line FROM summaries),
prev AS (
  SELECT job_id, chapter_index, string_agg(line, {S.LF} ORDER BY place) AS previous FROM (
    SELECT b.job_id, b.chapter_index, l.line, l.chapter_index AS place,
      row_number() OVER (PARTITION BY b.job_id, b.chapter_index ORDER BY l.chapter_index DESC) AS rn
    FROM books b JOIN lined l ON l.job_id = b.job_id AND l.chapter_index < b.chapter_index)
  WHERE rn <= 3 GROUP BY ALL)"""


@query("previous_summaries", S.with_(_PREVIOUS) + "SELECT job_id, chapter_index, previous FROM prev")
def previous_summaries(spark, sf):
    return SM.previous_summaries(chapters(spark, sf), summaries(spark, sf), book="job_id")


@query(
    "current_summary",
    S.with_(S.SEGMENTS, S.SUMMARIES)
    + """SELECT s.job_id, s.segment_id, u.summary FROM segments s
    LEFT JOIN summaries u USING (job_id, chapter_index)""",
)
def current_summary(spark, sf):
    joined = SM.current_summary(segments(spark, sf), summaries(spark, sf), "job_id")
    return joined.select("job_id", "segment_id", "summary")


# --- prompts ------------------------------------------------------------------------------------------------

_SEG = "job_id, segment_id"
_CONTEXT = f"""{S.SEGMENTS}, {S.TERMS}, {_PREVIOUS.replace(S.BOOKS + ', ', '')}, {_scored('segments', _SEG)},
tm AS (SELECT s.job_id, s.segment_id, t.*, row_number() OVER (PARTITION BY s.job_id, s.segment_id
    ORDER BY t.term_idx) AS rn FROM segments s JOIN terms t ON {S.hits()}),
tl AS (SELECT job_id, segment_id, string_agg({S.TERM_LINE}, {S.LF} ORDER BY term_idx) AS txt
  FROM tm WHERE rn <= 80 GROUP BY ALL),
td AS (SELECT string_agg({S.TERM_LINE}, {S.LF} ORDER BY term_idx) AS txt FROM (
  SELECT *, row_number() OVER (ORDER BY term_idx) AS rn FROM terms) WHERE rn <= 80),
rt AS (SELECT r.job_id, r.segment_id, string_agg('- ' || CASE WHEN b.title <> '' THEN b.title
    ELSE '资料 ' || (b.item_idx + 1) END || '：' || b.text, {S.LF} ORDER BY r.rank) AS txt
  FROM ranked r JOIN bank b USING (item_idx) WHERE r.rank <= 5 GROUP BY ALL),
parts AS (
  SELECT s.*, tl.txt AS matched, coalesce(tl.txt, td.txt) AS glossary_text,
    coalesce(p.previous, '') AS prev, coalesce(rt.txt, '') AS ret,
    'Shared context.' || CASE WHEN u.summary IS NOT NULL
        THEN {S.LF} || {S.LF} || '当前章节摘要：' || u.summary ELSE '' END
      || CASE WHEN p.previous IS NOT NULL
        THEN {S.LF} || {S.LF} || '前文摘要：' || {S.LF} || p.previous ELSE '' END AS sum_text
  FROM segments s LEFT JOIN tl USING (job_id, segment_id) LEFT JOIN rt USING (job_id, segment_id)
    LEFT JOIN summaries u USING (job_id, chapter_index)
    LEFT JOIN prev p USING (job_id, chapter_index), td),
ctx AS (
  SELECT job_id, segment_id, chapter_title, segment_index, segments_total, text, glossary_text,
    {S.budget('sum_text', 350)} AS summary_text,
    CASE WHEN ret = '' THEN '无' ELSE {S.budget('ret', 320)} END AS retrieval_text,
    {S.est_tokens("coalesce(matched, '无')")} AS glossary_tokens,
    {S.est_tokens('prev')} AS summary_tokens, {S.est_tokens('ret')} AS retrieval_tokens
  FROM parts)"""


def _context(spark, sf, cfg=CONFIG):
    # as in a run, segments and summaries are tables by the time prompts are made
    root = scratch_dir(spark)
    return prompt_context(
        materialize(segments(spark, sf, cfg), "segments", root),
        terms(spark, sf),
        materialize(summaries(spark, sf), "summaries", root),
        bank(spark, sf),
        cfg,
        book="job_id",
    )


@query(
    "prompt_context",
    S.with_(_CONTEXT)
    + """SELECT job_id, segment_id, glossary_text, summary_text, retrieval_text, glossary_tokens,
      summary_tokens, retrieval_tokens FROM ctx""",
)
def context(spark, sf):
    return _context(spark, sf).select(
        "job_id", "segment_id", "glossary_text", "summary_text", "retrieval_text",
        "glossary_tokens", "summary_tokens", "retrieval_tokens",
    )


def _user_sql() -> str:
    gap = f"{S.LF} || {S.LF}"
    return f""" || {gap} || """.join(
        [
            "'章节：' || chapter_title",
            "'片段：' || segment_index || '/' || segments_total",
            "'源语言：自动识别'",
            "'目标语言：Chinese'",
            f"'术语表：' || {S.LF} || glossary_text",
            f"'上下文摘要：' || {S.LF} || summary_text",
            f"'相关资料：' || {S.LF} || retrieval_text",
            "'待翻译文本：'",
            "text",
        ]
    )


_SYSTEM = CONFIG.prompt.replace("{{sourceLanguage}}", "").replace("{{targetLanguage}}", "Chinese")


@query(
    "prompt_messages",
    S.with_(_CONTEXT)
    + f"""SELECT job_id, segment_id, '{_SYSTEM}' AS system, {_user_sql()} AS "user" FROM ctx""",
)
def messages(spark, sf):
    return prompt_messages(_context(spark, sf), CONFIG).select(
        "job_id", "segment_id", "system", "user"
    )


_TEMPLATE = JobConfig(
    target_language="Chinese",
    context="Shared context.",
    preset=Preset("own", "own", 0.5, "To {{targetLanguage}} [{{glossary}}] {{chapterTitle}}: {{text}}"),
)


@query(
    "prompt_messages_template",
    S.with_(_CONTEXT)
    + """SELECT job_id, segment_id, '你是一个严格遵守用户翻译模板的文学翻译助手。只输出最终译文。' AS system,
      'To Chinese [' || glossary_text || '] ' || chapter_title || ': ' || text AS "user" FROM ctx""",
)
def template_messages(spark, sf):
    return prompt_messages(_context(spark, sf, _TEMPLATE), _TEMPLATE).select(
        "job_id", "segment_id", "system", "user"
    )


# --- requests and responses -----------------------------------------------------------------------------------

_PROVIDERS = ("openai", "claude", "gemini")


@query(
    "build_requests",
    """SELECT provider, job_id, segment_id, url, model, CAST(0.35 AS DOUBLE) AS temperature, max_tokens,
      'System ' || lang AS system, text AS "user"
    FROM (SELECT CAST(doc_id AS VARCHAR) AS segment_id, source AS job_id, lang, text FROM documents),
    (VALUES ('openai', 'https://x.test/v1/chat/completions', 'm 1', NULL),
            ('claude', 'https://x.test/v1/messages', 'm 1', CAST(4096 AS BIGINT)),
            ('gemini', 'https://x.test/v1/models/m%201:generateContent', NULL, NULL))
      AS p(provider, url, model, max_tokens)""",
)
def build_requests(spark, sf):
    prompts = documents(spark, sf).select(
        F.col("source").alias("job_id"),
        F.col("doc_id").cast("string").alias("segment_id"),
        F.concat(F.lit("System "), "lang").alias("system"),
        F.col("text").alias("user"),
    )
    out = None
    for provider in _PROVIDERS:
        cfg = JobConfig(provider=provider, model="m 1", base_url="https://x.test/v1//")
        rows = RQ.build_requests(prompts, cfg)
        out = rows if out is None else out.unionByName(rows)

    def field(*paths: str):
        return F.coalesce(*[F.get_json_object("body", p) for p in paths])

    return out.select(
        "provider",
        "job_id",
        "segment_id",
        "url",
        field("$.model").alias("model"),
        field("$.temperature", "$.generationConfig.temperature").cast("double").alias("temperature"),
        field("$.max_tokens").cast("long").alias("max_tokens"),
        field(
            "$.system", "$.systemInstruction.parts[0].text", "$.messages[0].content"
        ).alias("system"),
        F.when(F.col("provider") == "gemini", field("$.contents[0].parts[0].text"))
        .when(F.col("provider") == "claude", field("$.messages[0].content"))
        .otherwise(field("$.messages[1].content"))
        .alias("user"),
    )


@query(
    "parse_responses",
    """SELECT doc_id,
      CASE WHEN status = 200 THEN CASE WHEN doc_id % 11 = 5 THEN ''
        WHEN provider IN ('gemini', 'claude') THEN text || lang ELSE text END END AS text,
      CASE WHEN status = 200 AND doc_id % 11 <> 5 THEN '{"total":' || doc_id || '}' END AS usage,
      CASE WHEN status <> 200 THEN 'API ' || status || ' Error: ' || substring(text, 1, 2000) END AS error,
      CASE WHEN status <> 200 THEN status = 429 OR status >= 500 END AS retryable
    FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'gemini' WHEN 1 THEN 'claude' ELSE 'openai' END AS provider,
      CASE doc_id % 7 WHEN 4 THEN 429 WHEN 5 THEN 503 WHEN 6 THEN 404 ELSE 200 END AS status
      FROM documents)""",
)
def parse_responses(spark, sf):
    n, text = F.col("doc_id"), F.col("text")
    usage = F.struct(n.alias("total"))
    parts = F.array(F.struct(text.alias("text")), F.struct(F.col("lang").alias("text")))
    gemini = F.to_json(
        F.struct(
            F.array(F.struct(F.struct(parts.alias("parts")).alias("content"))).alias("candidates"),
            usage.alias("usageMetadata"),
        )
    )
    claude = F.to_json(F.struct(parts.alias("content"), usage.alias("usage")))
    choice = F.struct(F.struct(text.alias("content")).alias("message"))
    chat = F.to_json(F.struct(F.array(choice).alias("choices"), usage.alias("usage")))
    status = F.when(n % 7 == 4, 429).when(n % 7 == 5, 503).when(n % 7 == 6, 404).otherwise(200)
    raw = (
        F.when(status != 200, text)
        .when(n % 11 == 5, F.concat(F.lit("<"), text))
        .when(n % 3 == 0, gemini)
        .when(n % 3 == 1, claude)
        .otherwise(chat)
    )
    provider = F.when(n % 3 == 0, "gemini").when(n % 3 == 1, "claude").otherwise("openai")
    responses = table(spark, sf, "documents").select(
        "doc_id",
        provider.alias("provider"),
        status.alias("status"),
        F.lit("Error").alias("status_text"),
        raw.alias("raw"),
    )
    return RQ.parse_responses(responses).select("doc_id", "text", "usage", "error", "retryable")
