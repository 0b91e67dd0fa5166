"""SQL fragments that say in DuckDB what the functions and adapters say in Spark."""

from __future__ import annotations

from bookflow import constants as C
from bookflow.plans.adapters import KANA, LATIN, MIXED

LF = "chr(10)"
WS = f"'{C.WS_CHARS}'"
WSC = C.WS_CLASS


def trim(x: str) -> str:
    return f"trim({x}, {WS})"


def lines(x: str) -> str:
    return f"string_split({x}, {LF})"


def paras(x: str) -> str:
    return (
        f"list_filter(list_transform({lines(x)}, lambda v: {trim('v')}), lambda v: v <> '')"
    )


def cjk(x: str) -> str:
    return f"(length({x}) - length(regexp_replace({x}, '{C.CJK_CLASS}', '', 'g')))"


def est_tokens(x: str) -> str:
    return (
        f"CAST(ceil({cjk(x)} * CAST(0.8 AS DOUBLE) + (length({x}) - {cjk(x)}) / CAST(4 AS DOUBLE))"
        " AS BIGINT)"
    )


def budget(x: str, tokens: int) -> str:
    limit = max(160, int(tokens * 3.2))
    t = trim(x)
    return (
        f"CASE WHEN length({t}) <= {limit} THEN {t} "
        f"ELSE {trim(f'substring({t}, 1, {limit})')} || '...' END"
    )


def normal(x: str) -> str:
    lf = f"replace(replace({x}, chr(13) || {LF}, {LF}), chr(13), {LF})"
    tail = f"regexp_replace({lf}, '[ \\t]+\\n', {LF}, 'g')"
    return trim(f"regexp_replace({tail}, '\\n{{4,}}', {LF} || {LF} || {LF}, 'g')")


def collapse(x: str) -> str:
    return trim(f"regexp_replace({x}, '[{WSC}]+', ' ', 'g')")


def sentences(x: str, limit: int) -> str:
    marked = f"regexp_replace({collapse(x)}, '([。！？.!?])[{WSC}]*', '\\1' || chr(1), 'g')"
    kept = f"list_filter(string_split({marked}, chr(1)), lambda v: v <> '')"
    return f"substring(array_to_string(({kept})[1:4], ''), 1, {limit})"


def tokens(x: str) -> str:
    return (
        "list_distinct(regexp_extract_all(lower("
        + x
        + "), '[\\p{Han}\\p{Hiragana}\\p{Katakana}A-Za-z0-9_]{2,}'))"
    )


def decode(x: str) -> str:
    """Named entities only."""
    for name, char in (
        ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
    ):
        x = f"regexp_replace({x}, '(?i){name}', '{char}', 'g')"
    return x


def strip(x: str) -> str:
    return collapse(decode(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"))


def body(x: str) -> str:
    tags = "p|div|section|article|li|h[1-6]|blockquote"
    for pattern, new in (
        ("(?is)<script.*?</script>", "''"),
        ("(?is)<style.*?</style>", "''"),
        (f"(?i)<br[{WSC}]*/?>", LF),
        (f"(?i)</({tags})>", LF),
        (f"(?i)<({tags})[^>]*>", LF),
        ("<[^>]+>", "''"),
    ):
        x = f"regexp_replace({x}, '{pattern}', {new}, 'g')"
    return normal(f"array_to_string({paras(decode(x))}, {LF})")


def escape(x: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = f"replace({x}, '{char}', '{entity}')"
    return x


def demo(x: str, target: str, preset: str) -> str:
    marked = f"list_transform(list_filter({lines(x)}, lambda v: v <> ''), lambda v: '译：' || v)"
    return f"'【Demo 译文｜{target}｜{preset}】' || {LF} || array_to_string({marked}, {LF})"


def kana(x: str) -> str:
    return f"translate(lower({x}), '{LATIN}', '{KANA}')"


def mixed(x: str) -> str:
    return f"translate(lower({x}), '{LATIN}', '{MIXED}')"


def pieces(x: str, limit: int) -> str:
    """Greedy packing as a fold over the paragraphs, carrying the texts themselves."""
    cut = (
        f"list_transform(range(0, CAST(ceil(length(x) / {limit}.0) AS BIGINT)), "
        f"lambda i: substring(x, i * {limit} + 1, {limit}))"
    )
    fold = f"""list_reduce({paras(x)}, lambda a, x:
        CASE WHEN length(x) > {limit} THEN {{'done': list_concat(
                 CASE WHEN a.open <> '' THEN list_append(a.done, a.open) ELSE a.done END, {cut}),
                 'open': ''}}
             WHEN a.open = '' THEN {{'done': a.done, 'open': x}}
             WHEN length(a.open) + 2 + length(x) > {limit}
                 THEN {{'done': list_append(a.done, a.open), 'open': x}}
             ELSE {{'done': a.done, 'open': a.open || {LF} || {LF} || x}} END,
        {{'done': []::VARCHAR[], 'open': ''}})"""
    return (
        f"(SELECT CASE WHEN r.open <> '' THEN list_append(r.done, r.open) ELSE r.done END "
        f"FROM (SELECT {fold} AS r))"
    )


BOOKS = """books AS (
  SELECT source AS job_id, source AS book_id,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chapter_index,
         'Doc ' || doc_id AS title, text, doc_id
  FROM documents)"""


def _segments(limit: int = C.DEFAULT_CHUNK_CHARS) -> str:
    return f"""packed AS (SELECT job_id, chapter_index, title, {pieces('text', limit)} AS ps FROM books),
segs AS (
  SELECT job_id, 'corpus' AS project_id, chapter_index, title AS chapter_title,
         len(ps) AS segments_total, unnest(ps) AS text, generate_subscripts(ps, 1) AS segment_index
  FROM packed),
segments AS (
  SELECT *, 'c' || (chapter_index + 1) || '-s' || segment_index AS segment_id FROM segs)"""


SEGMENTS = f"{BOOKS}, {_segments()}"

TERMS = """terms AS (
  SELECT 'corpus' AS project_id, item_id AS term_idx, lower(substring(w[1], 1, 4)) AS source,
         CASE WHEN item_id % 7 = 3 THEN '' ELSE lower(substring(w[2], 1, 3)) END AS target,
         CASE WHEN item_id % 3 = 0 THEN lower(substring(w[3], 1, 5)) END AS alias,
         CASE WHEN item_id % 5 = 0 THEN 'note ' || item_id ELSE '' END AS note
  FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]{4,}') AS w FROM benchmark)
  WHERE len(w) >= 3)"""

BANK = """bank AS (
  SELECT 'corpus' AS project_id, item_id AS item_idx,
         CASE WHEN item_id % 2 = 0 THEN 'Item ' || item_id ELSE '' END AS title, text
  FROM benchmark)"""

SUMMARIES = """summaries AS (
  SELECT job_id, chapter_index,
         CASE WHEN chapter_index % 5 = 0 THEN '' ELSE title END AS title,
         'S ' || substring(text, 1, 60) AS summary
  FROM books WHERE chapter_index % 3 <> 1)"""

PAIRS = """pairs AS (
  SELECT 'job-' || (u.conv_id % 8) AS job_id,
         'c' || (u.conv_id + 1) || '-s' || (u.turn // 2 + 1) AS segment_id, 'corpus' AS project_id,
         u.conv_id AS chapter_index, 'Conv ' || u.conv_id AS chapter_title,
         u.turn // 2 + 1 AS segment_index, u.text, a.text AS translated_text,
         CASE u.conv_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'cached' WHEN 2 THEN 'pending'
              ELSE 'completed' END AS status
  FROM (SELECT *, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.nxt
  WHERE u.role = 'user' AND a.role = 'assistant')"""

QA_PAIRS = f"""{PAIRS}, bent AS (
  SELECT *, (chapter_index * 3 + segment_index) % 9 AS kind FROM pairs),
qa_pairs AS (
  SELECT job_id, segment_id, project_id, chapter_index, chapter_title, segment_index, status,
         CASE WHEN kind = 2 THEN {kana('text')} ELSE text END AS text,
         CASE kind WHEN 0 THEN ' ' || {LF} || ' '
                   WHEN 1 THEN 'Sure: ' || translated_text
                   WHEN 2 THEN {kana('text')}
                   WHEN 3 THEN repeat(substring(translated_text, 1, 40) || {LF}, 4) || translated_text
                   WHEN 4 THEN substring(translated_text, 1, 5)
                   WHEN 5 THEN repeat(translated_text, 6)
                   ELSE translated_text END AS translated_text
  FROM bent)"""

STATUS = """CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'cached'
    WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' ELSE 'pending' END"""

RESULTS = f"""results AS (
  SELECT CAST(user_id AS VARCHAR) AS job_id, CAST(event_id AS VARCHAR) AS segment_id,
         {STATUS} AS status, CASE WHEN event_type = 'error' THEN props END AS error
  FROM events)"""

ATTEMPTS = f"""attempts AS (
  SELECT CAST(user_id AS VARCHAR) AS job_id,
         's' || CAST(CAST(floor(value) AS BIGINT) % 20 AS VARCHAR) AS segment_id,
         event_id AS attempt, {STATUS} AS status, ts
  FROM events)"""

TERM_LINE = """'- ' || source || CASE WHEN target <> '' THEN ' => ' || target ELSE '' END
    || CASE WHEN alias IS NOT NULL THEN '；别名：' || alias ELSE '' END
    || CASE WHEN note <> '' THEN '；备注：' || note ELSE '' END"""


def hits(text: str = "s.text") -> str:
    """The relevance condition between a text and a term ``t``."""
    return f"(contains({text}, t.source) OR coalesce(contains({text}, t.alias), false))"


def progress(by: str, source: str) -> str:
    counts = ", ".join(
        f"count(*) FILTER (WHERE status = '{s}') AS {s}"
        for s in ("pending", "running", "completed", "cached", "failed", "interrupted")
    )
    return f"""SELECT *, completed + cached AS done,
      CAST(floor(100.0::DOUBLE * (completed + cached) / total + 0.5) AS BIGINT) AS percent
      FROM (SELECT {by}, count(*) AS total, {counts} FROM {source} GROUP BY {by})"""


OUTCOME = """CASE WHEN failed > 0 AND done > 0 THEN 'completed_with_errors'
    WHEN failed > 0 THEN 'failed' ELSE 'completed' END"""


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + "\n"
