"""Queries of the text, HTML and template functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookflow import constants as C
from bookflow.functions import html as H
from bookflow.functions import text as X
from bookflow.functions.arrays import value_counts
from bookflow.functions.template import render_template
from bookflow.operators.qa import first_repeats, repeated_lines, repeats
from bookflow.operators.summaries import name_counts, top_names
from bookflow.plans import sql as S
from bookflow.plans.adapters import KANA, MIXED, documents, table, translate_letters
from bookflow.plans.registry import query


def _text():
    return F.col("text")


def _docs(spark, sf, *columns):
    return documents(spark, sf).select("doc_id", *columns)


_MESSY_SQL = f"replace(text, {S.LF}, '  ' || chr(13) || {S.LF}) || repeat({S.LF}, 5) || 'x '"


@query("normalize_text", f"SELECT doc_id, {S.normal(_MESSY_SQL)} AS text FROM documents")
def normalize_text(spark, sf):
    messy = F.concat(F.replace(_text(), F.lit("\n"), F.lit("  \r\n")), F.lit("\n" * 5 + "x "))
    return _docs(spark, sf, X.normalize_text(messy).alias("text"))


@query(
    "paragraph_preview",
    f"SELECT doc_id, array_to_string(({S.paras('text')})[1:6], {S.LF}) AS preview FROM documents",
)
def paragraph_preview(spark, sf):
    return _docs(spark, sf, F.array_join(X.preview(_text(), 6), "\n").alias("preview"))


@query("count_cjk", f"SELECT doc_id, {S.cjk(S.kana('text'))} AS cjk FROM documents")
def count_cjk(spark, sf):
    return _docs(spark, sf, X.count_cjk(translate_letters(_text(), KANA)).alias("cjk"))


@query("count_paragraphs", f"SELECT doc_id, len({S.paras('text')}) AS n FROM documents")
def count_paragraphs(spark, sf):
    return _docs(spark, sf, X.count_paragraphs(_text()).alias("n"))


@query(
    "estimate_tokens",
    f"""SELECT doc_id, {S.est_tokens('text')} AS latin, {S.est_tokens('k')} AS cjk
    FROM (SELECT doc_id, text, {S.kana('text')} AS k FROM documents)""",
)
def estimate_tokens(spark, sf):
    return _docs(
        spark,
        sf,
        X.estimate_tokens(_text()).alias("latin"),
        X.estimate_tokens(translate_letters(_text(), KANA)).alias("cjk"),
    )


@query(
    "trim_to_budget",
    f"""SELECT doc_id, {S.budget('text', 40)} AS low, {S.budget('text', 350)} AS high, '' AS none
    FROM documents""",
)
def trim_to_budget(spark, sf):
    return _docs(
        spark,
        sf,
        X.trim_to_budget(_text(), 40).alias("low"),
        X.trim_to_budget(_text(), 350).alias("high"),
        X.trim_to_budget(_text(), 0).alias("none"),
    )


@query(
    "first_sentences",
    f"SELECT doc_id, {S.sentences('text', 360)} AS summary FROM documents",
)
def first_sentences(spark, sf):
    return _docs(spark, sf, X.first_sentences(_text(), 360).alias("summary"))


@query("xml_escape", f"SELECT page_id, {S.escape('html')} AS escaped FROM pages")
def xml_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.xml_escape(F.col("html")).alias("escaped"))


@query(
    "demo_translate",
    f"SELECT doc_id, {S.demo('text', 'Chinese', '默认预设')} AS translated FROM documents",
)
def demo_translate(spark, sf):
    return _docs(spark, sf, X.demo_translate(_text(), "Chinese").alias("translated"))


@query("clip_error", f"SELECT doc_id, substring(text, 1, {C.ERROR_CHARS}) AS error FROM documents")
def clip_error(spark, sf):
    return _docs(spark, sf, X.clip_error(_text()).alias("error"))


@query(
    "tokens",
    f"SELECT doc_id, len(t) AS n, array_to_string(list_sort(t), ' ') AS tokens "
    f"FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)",
)
def tokens(spark, sf):
    return _docs(spark, sf, X.tokens(_text()).alias("t")).select(
        "doc_id", F.size("t").alias("n"), F.array_join(F.sort_array("t"), " ").alias("tokens")
    )


@query(
    "distinct_tokens",
    f"SELECT DISTINCT lang, unnest({S.tokens('text')}) AS token FROM documents",
)
def distinct_tokens(spark, sf):
    return (
        documents(spark, sf).select("lang", F.explode(X.tokens(_text())).alias("token")).distinct()
    )


@query(
    "render_template",
    "SELECT doc_id, 'Doc ' || doc_id || ' (' || lang || ')[]: ' || text AS rendered FROM documents",
)
def render(spark, sf):
    values = {"doc": F.col("doc_id"), "lang": F.col("lang"), "text": _text()}
    rendered = render_template("Doc {{ doc }} ({{lang}})[{{ nope }}]: {{text}}", values)
    return documents(spark, sf).select("doc_id", rendered.alias("rendered"))


@query(
    "retry_delay",
    """SELECT event_id, CAST(least(30000, 1000 * power(2, event_id % 8)) AS BIGINT) AS delay_ms
    FROM events""",
)
def retry_delay(spark, sf):
    attempt = (F.col("event_id") % 8 + 1).cast("int")
    return table(spark, sf, "events").select(
        "event_id", X.retry_delay_base(attempt).alias("delay_ms")
    )


@query(
    "is_retryable",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false
      ELSE CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true
           ELSE false END END AS retryable FROM events""",
)
def is_retryable(spark, sf):
    n = F.col("event_id")
    flag = F.when(n % 3 == 0, True).when(n % 3 == 1, False)
    status = (
        F.when(n % 5 == 1, 429).when(n % 5 == 2, 500).when(n % 5 == 3, 404).when(n % 5 == 4, 400)
    )
    return table(spark, sf, "events").select("event_id", X.is_retryable(flag, status).alias("retryable"))


# --- HTML ------------------------------------------------------------------------------------------


@query(
    "html_decode",
    f"""SELECT page_id, {S.decode('html')} || repeat(chr(CAST(page_id % 90 + 40 AS INTEGER)), 2) AS decoded
    FROM pages""",
)
def html_decode(spark, sf):
    code = F.col("page_id") % 90 + 40
    entities = F.concat(
        F.lit("&#x"), F.hex(code), F.lit(";&#"), code.cast("string"), F.lit(";")
    )
    return table(spark, sf, "pages").select(
        "page_id", H.html_decode(F.concat("html", entities)).alias("decoded")
    )


@query("strip_tags", f"SELECT page_id, {S.strip('html')} AS plain FROM pages")
def strip_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.strip_tags(F.col("html")).alias("plain"))


@query(
    "html_to_text",
    f"""SELECT page_id, {S.body('html')} AS text,
      CASE WHEN t <> '' THEN t ELSE 'Page ' || page_id END AS title
    FROM (SELECT page_id, html, {S.strip(
        "CASE WHEN regexp_matches(html, '(?is)<h[1-3][^>]*>.*?</h[1-3]>') "
        "THEN regexp_extract(html, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1) "
        "ELSE regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) END"
    )} AS t FROM pages)""",
)
def html_to_text(spark, sf):
    fallback = F.concat(F.lit("Page "), F.col("page_id").cast("string"))
    return table(spark, sf, "pages").select(
        "page_id",
        H.html_title(F.col("html"), fallback).alias("title"),
        H.html_body(F.col("html")).alias("text"),
    )


@query(
    "extract_attrs",
    f"""SELECT page_id, n, {S.decode("regexp_extract(tag, 'href=.([^\"]*)', 1)")} AS href
    FROM (SELECT page_id, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS n
          FROM (SELECT page_id, regexp_extract_all(html, '<a[^>]*>') AS tags FROM pages))
    WHERE regexp_matches(tag, 'href="')""",
)
def extract_attrs(spark, sf):
    tags = F.regexp_extract_all("html", F.lit("<a[^>]*>"), F.lit(0))
    return (
        table(spark, sf, "pages")
        .select("page_id", F.posexplode(tags).alias("n", "tag"))
        .select("page_id", "n", H.extract_attrs(F.col("tag"))["href"].alias("href"))
        .filter(F.col("href").isNotNull())
    )


@query(
    "resolve_path",
    """SELECT page_id, array_to_string(list_reduce(
        string_split(url || '/' || '../' || page_id || '/./x.html', '/'),
        lambda a, p: CASE WHEN p = '' OR p = '.' THEN a
                          WHEN p = '..' THEN a[1:len(a) - 1]
                          ELSE list_append(a, p) END, []::VARCHAR[]), '/') AS path
    FROM pages""",
)
def resolve_path(spark, sf):
    href = F.concat(F.lit("../"), F.col("page_id").cast("string"), F.lit("/./x.html"))
    return table(spark, sf, "pages").select(
        "page_id", H.resolve_path(F.col("url"), href).alias("path")
    )


@query(
    "path_names",
    """SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base,
      regexp_extract(lower(url), '([.][^.]*)$', 1) AS ext,
      regexp_replace(regexp_extract(url || '/Book.TXT', '([^/]*)$', 1), '(?i)[.]txt$', '') AS stem
    FROM pages""",
)
def path_names(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id",
        H.base_name(url).alias("base"),
        H.ext_name(url).alias("ext"),
        H.base_name(F.concat(url, F.lit("/Book.TXT")), ".txt").alias("stem"),
    )


@query(
    "sanitize_id",
    f"""SELECT page_id, substring(regexp_replace(regexp_replace({S.trim('url')},
      '[^a-zA-Z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS id FROM pages""",
)
def sanitize_id(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.sanitize_id(F.col("url")).alias("id"))


# --- counts inside a text -----------------------------------------------------------------------------

_LONG_LINES = f"""l AS (
  SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS pos
  FROM (SELECT doc_id, list_filter({S.paras('text')}, lambda v: length(v) >= 8) AS p FROM documents)),
rep AS (SELECT doc_id, line, count(*) AS n, min(pos) AS first_pos FROM l
        GROUP BY doc_id, line HAVING count(*) >= 3)"""


@query("repeated_lines", S.with_(_LONG_LINES) + "SELECT doc_id, line, n, first_pos FROM rep")
def repeated(spark, sf):
    return repeated_lines(documents(spark, sf), ["doc_id"], "text")


@query(
    "first_repeats",
    S.with_(_LONG_LINES)
    + """SELECT doc_id, rank, line, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id
      ORDER BY first_pos) AS rank FROM rep) WHERE rank <= 5""",
)
def first_repeat_rows(spark, sf):
    return (
        _docs(spark, sf, F.posexplode(first_repeats(repeats(_text()))).alias("rank", "x"))
        .select("doc_id", (F.col("rank") + 1).alias("rank"), "x.line", "x.n")
    )


_NAMES = f"""names AS (
  SELECT doc_id, unnest(m) AS name, generate_subscripts(m, 1) - 1 AS pos
  FROM (SELECT doc_id, regexp_extract_all({S.mixed('text')}, '{C.NAME_PATTERN}') AS m
        FROM documents)),
counted AS (SELECT doc_id, name, count(*) AS n, min(pos) AS first_pos FROM names GROUP BY 1, 2)"""


def _named(spark, sf):
    return documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("book_id"),
        F.lit(0).alias("chapter_index"),
        translate_letters(_text(), MIXED).alias("text"),
        F.lit("").alias("translated_text"),
    )


@query(
    "name_counts",
    S.with_(_NAMES)
    + "SELECT CAST(doc_id AS VARCHAR) AS book_id, CAST(0 AS BIGINT) AS chapter_index, name, n, first_pos FROM counted",
)
def name_count_rows(spark, sf):
    return name_counts(_named(spark, sf))


@query(
    "top_names",
    S.with_(_NAMES)
    + """SELECT CAST(doc_id AS VARCHAR) AS book_id, rank, name FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(name) DESC, first_pos)
        AS rank FROM counted) WHERE rank <= 10""",
)
def top_name_rows(spark, sf):
    named = _named(spark, sf)
    m = F.regexp_extract_all("text", F.lit(C.NAME_PATTERN), F.lit(0))
    return named.select("book_id", F.posexplode(top_names(value_counts(m))).alias("rank", "name")).select(
        "book_id", (F.col("rank") + 1).alias("rank"), "name"
    )
