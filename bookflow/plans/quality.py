"""Queries of quality checks, results and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookflow import constants as C
from bookflow.functions.text import demo_translate, js_trim
from bookflow.operators import qa as Q
from bookflow.operators import reports as RP
from bookflow.operators import summaries as SM
from bookflow.operators import work as WK
from bookflow.plans import sql as S
from bookflow.plans.adapters import (
    CONFIG,
    chapters,
    pairs,
    qa_pairs,
    segments,
    segments_of,
    table,
    terms,
)
from bookflow.plans.registry import query
from bookflow.session import materialize


def _src():
    return F.col("text")


def _tgt():
    return F.col("translated_text")


def _now():
    return F.to_timestamp(F.lit("2024-06-01 00:00:00"))


# --- single rules -----------------------------------------------------------------------------------------

_BLANK = f"{S.trim('translated_text')} = ''"
_RATIO = "length(translated_text) / CAST(greatest(1, length(text)) AS DOUBLE)"
_SPARA, _TPARA = (f"len({S.paras(c)})" for c in ("text", "translated_text"))
_FORMAT = (
    f"{_SPARA} >= 2 AND abs({_SPARA} - {_TPARA}) > greatest(2, ceil({_SPARA} * CAST(0.35 AS DOUBLE)))"
)
_UNTRANSLATED = (
    f"{S.cjk('text')} > 20 AND {S.cjk('translated_text')} > {S.cjk('text')} * CAST(0.9 AS DOUBLE) "
    f"AND regexp_matches(text, '{C.KANA_PATTERN}')"
)
_INSTRUCTION = f"regexp_matches({S.trim('translated_text')}, '{C.INSTRUCTION_PATTERN}')"
_FORMAT_MSG = f"'段落数量差异较大：原文 ' || {_SPARA} || ' 段，译文 ' || {_TPARA} || ' 段。'"

_RULES = {
    "check_empty": ("empty", "error", f"'{C.MSG_EMPTY}'", _BLANK),
    "check_short": ("length", "warning", f"'{C.MSG_SHORT}'", f"{_RATIO} < CAST(0.18 AS DOUBLE)"),
    "check_long": ("length", "warning", f"'{C.MSG_LONG}'", f"{_RATIO} > CAST(4.2 AS DOUBLE)"),
    "check_untranslated": ("untranslated", "warning", f"'{C.MSG_UNTRANSLATED}'", _UNTRANSLATED),
    "check_format": ("format", "warning", _FORMAT_MSG, _FORMAT),
    "check_instruction": ("instruction", "warning", f"'{C.MSG_INSTRUCTION}'", _INSTRUCTION),
}


def _rule_sql(name: str) -> str:
    kind, severity, message, condition = _RULES[name]
    return (
        S.with_(S.QA_PAIRS)
        + f"""SELECT job_id, segment_id, '{kind}' AS type, '{severity}' AS severity, {message} AS message
        FROM qa_pairs WHERE {condition}"""
    )


def _flagged(spark, sf, check):
    rows = qa_pairs(spark, sf).select("job_id", "segment_id", F.explode(F.array(check)).alias("i"))
    return rows.filter(F.col("i").isNotNull()).select(
        "job_id", "segment_id", "i.type", "i.severity", "i.message"
    )


@query("check_empty", _rule_sql("check_empty"))
def check_empty(spark, sf):
    return _flagged(spark, sf, Q.check_empty(_tgt()))


@query("check_short", _rule_sql("check_short"))
def check_short(spark, sf):
    return _flagged(spark, sf, Q.check_short(_src(), _tgt()))


@query("check_long", _rule_sql("check_long"))
def check_long(spark, sf):
    return _flagged(spark, sf, Q.check_long(_src(), _tgt()))


@query("check_untranslated", _rule_sql("check_untranslated"))
def check_untranslated(spark, sf):
    return _flagged(spark, sf, Q.check_untranslated(_src(), _tgt()))


@query("check_format", _rule_sql("check_format"))
def check_format(spark, sf):
    return _flagged(spark, sf, Q.check_format(_src(), _tgt()))


@query("check_instruction", _rule_sql("check_instruction"))
def check_instruction(spark, sf):
    return _flagged(spark, sf, Q.check_instruction(_tgt()))


# --- whole checks --------------------------------------------------------------------------------------------

_MISSES = f"""miss AS (
  SELECT p.*, t.term_idx, t.source, t.target FROM {{src}} p JOIN terms t ON {S.hits('p.text')}
  WHERE t.target <> '' AND NOT contains(p.translated_text, t.target))"""
_MISS_MSG = "'术语「' || source || '」建议译为「' || target || '」，译文中未检测到目标译名。'"
_REPEAT = f"""rl AS (
  SELECT job_id, segment_id, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS pos
  FROM (SELECT job_id, segment_id, list_filter({S.paras('translated_text')}, lambda v: length(v) >= 8) AS p
        FROM {{src}})),
rep AS (SELECT *, row_number() OVER (PARTITION BY job_id, segment_id ORDER BY first_pos) AS rn FROM (
  SELECT job_id, segment_id, line, count(*) AS n, min(pos) AS first_pos FROM rl
  GROUP BY ALL HAVING count(*) >= 3))"""
_REPEAT_MSG = "'译文中疑似重复输出 ' || n || ' 次：' || substring(line, 1, 60)"


@query(
    "glossary_misses",
    S.with_(S.PAIRS, S.TERMS, _MISSES.format(src="pairs"))
    + f"""SELECT job_id, segment_id, source, target, {_MISS_MSG} AS message,
      row_number() OVER (PARTITION BY job_id, segment_id ORDER BY term_idx) - 1 AS issue_no FROM miss""",
)
def glossary_misses(spark, sf):
    found = Q.glossary_misses(pairs(spark, sf), terms(spark, sf))
    return found.select("job_id", "segment_id", "source", "target", "message", "issue_no")


@query(
    "check_repetition",
    S.with_(S.QA_PAIRS, _REPEAT.format(src="qa_pairs"))
    + f"SELECT job_id, segment_id, rn - 1 AS issue_no, {_REPEAT_MSG} AS message FROM rep WHERE rn <= 5",
)
def check_repetition(spark, sf):
    found = Q.check_repetition(qa_pairs(spark, sf))
    return found.select("job_id", "segment_id", "issue_no", "message")


def _all_issues() -> str:
    """Every issue with a sort key (group, position) within its segment."""
    scalar = " UNION ALL ".join(
        f"""SELECT job_id, segment_id, chapter_index, segment_index, {i} AS g, 0 AS o, '{kind}' AS type,
        '{severity}' AS severity, {message} AS message, NULL AS source, NULL AS target
        FROM ok WHERE {condition}"""
        for i, (kind, severity, message, condition) in enumerate(
            v for k, v in _RULES.items() if k != "check_empty"
        )
    )
    return f"""done AS (SELECT * FROM qa_pairs WHERE status IN ('completed', 'cached')),
ok AS (SELECT * FROM done WHERE NOT ({_BLANK})), {_MISSES.format(src='ok')}, {_REPEAT.format(src='ok')},
issues0 AS (
  SELECT job_id, segment_id, chapter_index, segment_index, 0 AS g, 0 AS o, 'empty' AS type,
    'error' AS severity, '{C.MSG_EMPTY}' AS message, NULL AS source, NULL AS target
  FROM done WHERE {_BLANK}
  UNION ALL {scalar}
  UNION ALL SELECT job_id, segment_id, chapter_index, segment_index, 8, term_idx, 'glossary', 'warning',
    {_MISS_MSG}, source, target FROM miss
  UNION ALL SELECT rep.job_id, rep.segment_id, chapter_index, segment_index, 9, rn, 'repetition', 'warning',
    {_REPEAT_MSG}, NULL, NULL FROM rep JOIN ok USING (job_id, segment_id) WHERE rn <= 5),
issues AS (SELECT *, row_number() OVER (PARTITION BY job_id, segment_id ORDER BY g, o) - 1 AS issue_no
  FROM issues0)"""


_ISSUES = f"{S.QA_PAIRS}, {S.TERMS}, {_all_issues()}"
_ISSUE_COLS = ["job_id", "segment_id", "issue_no", "type", "severity", "message", "source", "target"]


@query("check_jobs", S.with_(_ISSUES) + f"SELECT {', '.join(_ISSUE_COLS)} FROM issues")
def check_jobs(spark, sf):
    return Q.check_jobs(qa_pairs(spark, sf), terms(spark, sf)).select(*_ISSUE_COLS)


@query(
    "cap_issues",
    S.with_(_ISSUES)
    + """SELECT job_id, segment_id, issue_no, type FROM (SELECT *, row_number() OVER (PARTITION BY job_id
      ORDER BY chapter_index, segment_index, segment_id, issue_no) AS rn FROM issues) WHERE rn <= 80""",
)
def cap_issues(spark, sf):
    issues = Q.check_jobs(qa_pairs(spark, sf), terms(spark, sf))
    order = ["chapter_index", "segment_index", "segment_id", "issue_no"]
    return RP.cap_issues(issues, C.REPORT_QA, order).select("job_id", "segment_id", "issue_no", "type")


# --- consistency -------------------------------------------------------------------------------------------------

_CONSISTENT = f"""{S.PAIRS}, {S.TERMS}, hit AS (
  SELECT p.*, t.term_idx, t.source, t.target, NOT contains(p.translated_text, t.target) AS missing
  FROM pairs p JOIN terms t ON contains(p.text, t.source) WHERE t.target <> ''),
cons AS (SELECT job_id, term_idx, source, target, count(*) AS seen, count(*) FILTER (WHERE missing) AS missing
  FROM hit GROUP BY ALL HAVING count(*) >= 2 AND count(*) FILTER (WHERE missing) > 0),
loc AS (SELECT *, row_number() OVER (PARTITION BY job_id, term_idx
  ORDER BY chapter_index, segment_index, segment_id) AS rn FROM hit WHERE missing),
places AS (SELECT job_id, term_idx, string_agg(chapter_index || '/' || chapter_title || '/' || segment_index,
  ' ' ORDER BY rn) AS locations FROM loc WHERE rn <= 8 GROUP BY ALL)"""
_CONS_MSG = (
    "'术语「' || source || '」在 ' || seen || ' 个片段出现，其中 ' || missing || ' 个片段未使用「' || target || '」。'"
)


def _places():
    text = F.transform(
        "locations",
        lambda x: F.concat_ws(
            "/", x["chapter_index"].cast("string"), x["chapter_title"], x["segment_index"].cast("string")
        ),
    )
    return F.array_join(text, " ").alias("locations")


@query(
    "term_consistency",
    S.with_(_CONSISTENT) + "SELECT job_id, term_idx, source, target, seen, missing FROM cons",
)
def term_consistency(spark, sf):
    return RP.term_consistency(pairs(spark, sf), terms(spark, sf))


@query(
    "term_consistency_by_anchor",
    S.with_(_CONSISTENT) + "SELECT job_id, term_idx, source, target, seen, missing FROM cons",
)
def term_consistency_by_anchor(spark, sf):
    return RP.term_consistency(pairs(spark, sf), terms(spark, sf), small=False)


@query("first_locations", S.with_(_CONSISTENT) + "SELECT job_id, term_idx, locations FROM places")
def first_locations(spark, sf):
    hits = RP._source_hits(pairs(spark, sf), terms(spark, sf), None)
    return RP.first_locations(hits.filter("missing")).select("job_id", "term_idx", _places())


@query(
    "consistency_issues",
    S.with_(_CONSISTENT)
    + f"""SELECT job_id, term_idx, 'consistency' AS type, 'warning' AS severity, {_CONS_MSG} AS message,
      locations FROM cons JOIN places USING (job_id, term_idx)""",
)
def consistency_issues(spark, sf):
    found = RP.consistency_issues(pairs(spark, sf), terms(spark, sf))
    return found.select("job_id", "term_idx", "type", "severity", "message", _places())


# --- results ---------------------------------------------------------------------------------------------------------

_DEMO_SQL = S.demo("text", "Chinese", CONFIG.preset.name)
# chapters with an index divisible by 7 stay without a translation
_TRANSLATED = f"""{S.SEGMENTS}, done AS (
  SELECT *, CASE WHEN chapter_index % 7 = 0 THEN '' ELSE {S.trim(_DEMO_SQL)} END AS translated_text,
    CASE WHEN chapter_index % 7 = 0 THEN 'failed' WHEN segment_index % 2 = 0 THEN 'cached'
         ELSE 'completed' END AS status FROM segments),
whole AS (SELECT job_id, chapter_index, string_agg(translated_text, {S.LF} || {S.LF}
  ORDER BY segment_index) AS translated_text FROM done WHERE translated_text <> '' GROUP BY ALL),
chapter_results AS (SELECT b.job_id, b.chapter_index, b.title, b.text AS source_text, w.translated_text
  FROM books b JOIN whole w USING (job_id, chapter_index))"""


def _translated(spark, sf):
    return _translate(segments(spark, sf))


def _translate(segs):
    text = js_trim(demo_translate(_src(), "Chinese", CONFIG.preset.name))
    skipped = F.col("chapter_index") % 7 == 0
    status = F.when(skipped, "failed").when(F.col("segment_index") % 2 == 0, "cached").otherwise("completed")
    return segs.withColumns(
        {"translated_text": F.when(skipped, "").otherwise(text), "status": status}
    )


def chapter_results(spark, sf):
    whole = RP.reassemble(_translated(spark, sf))
    return RP.attach_segments(chapters(spark, sf), whole)


@query("reassemble", S.with_(_TRANSLATED) + "SELECT job_id, chapter_index, translated_text FROM whole")
def reassemble(spark, sf):
    return RP.reassemble(_translated(spark, sf))


@query(
    "attach_segments",
    S.with_(_TRANSLATED)
    + "SELECT job_id, chapter_index, title, source_text, translated_text FROM chapter_results",
)
def attach_segments(spark, sf):
    return chapter_results(spark, sf)


_SUMMARY = f"""{_TRANSLATED}, {S.TERMS},
st AS (SELECT s.job_id, s.chapter_index, t.*, row_number() OVER (PARTITION BY s.job_id, s.chapter_index
  ORDER BY t.term_idx) AS rn FROM books s JOIN terms t ON {S.hits()}),
sl AS (SELECT job_id, chapter_index, string_agg(source || '>' || target || '>' || note, ' ' ORDER BY term_idx) AS terms
  FROM st WHERE rn <= 12 GROUP BY ALL),
nm AS (SELECT job_id, chapter_index, unnest(m) AS name, generate_subscripts(m, 1) AS pos FROM (
  SELECT job_id, chapter_index, regexp_extract_all(source_text || {S.LF} || translated_text, '{C.NAME_PATTERN}') AS m
  FROM chapter_results)),
nc AS (SELECT *, row_number() OVER (PARTITION BY job_id, chapter_index ORDER BY n DESC, length(name) DESC, p) AS rn
  FROM (SELECT job_id, chapter_index, name, count(*) AS n, min(pos) AS p FROM nm GROUP BY ALL)),
nl AS (SELECT job_id, chapter_index, string_agg(name, ' ' ORDER BY rn) AS characters FROM nc WHERE rn <= 10 GROUP BY ALL),
chapter_summaries AS (
  SELECT r.job_id, r.chapter_index, r.title, {S.sentences('r.translated_text', 360)} AS summary,
    coalesce(nl.characters, '') AS characters, coalesce(sl.terms, '') AS terms
  FROM chapter_results r LEFT JOIN nl USING (job_id, chapter_index) LEFT JOIN sl USING (job_id, chapter_index))"""


def _summaries(spark, sf):
    chaps = materialize(chapters(spark, sf), "chapters")
    whole = RP.reassemble(_translate(segments_of(chaps)))
    return SM.summarize_chapters(chaps, whole, terms(spark, sf), _now())


@query(
    "summarize_chapters",
    S.with_(_SUMMARY)
    + "SELECT job_id, chapter_index, title, summary, characters, terms FROM chapter_summaries",
)
def summarize_chapters(spark, sf):
    listed = F.transform("terms", lambda t: F.concat_ws(">", t["source"], t["target"], t["note"]))
    return _summaries(spark, sf).select(
        "job_id",
        "chapter_index",
        "title",
        "summary",
        F.array_join("characters", " ").alias("characters"),
        F.array_join(listed, " ").alias("terms"),
    )


@query(
    "estimate",
    S.with_(S.SEGMENTS)
    + """SELECT b.book_id, b.chapters, b.chars, s.segments, b.chars * CAST(0 AS DOUBLE) AS cost FROM (
      SELECT book_id, count(*) AS chapters, CAST(sum(length(text)) AS BIGINT) AS chars FROM books GROUP BY 1) b
    JOIN (SELECT job_id, count(*) AS segments FROM segments GROUP BY 1) s ON s.job_id = b.book_id""",
)
def estimate(spark, sf):
    return RP.estimate(chapters(spark, sf), CONFIG)


@query(
    "estimate_providers",
    """SELECT source AS book_id, provider, CAST(sum(length(text)) AS DOUBLE) * rate AS cost
    FROM documents, (VALUES ('claude', CAST(0.0000022 AS DOUBLE)), ('deepseek', CAST(0.00000035 AS DOUBLE)),
      ('other', CAST(0.000001 AS DOUBLE))) AS r(provider, rate) GROUP BY source, provider, rate""",
)
def estimate_providers(spark, sf):
    from bookflow.config import JobConfig

    out = None
    for provider in ("claude", "deepseek", "other"):
        rows = RP.estimate(chapters(spark, sf), JobConfig(provider=provider)).select(
            "book_id", F.lit(provider).alias("provider"), "cost"
        )
        out = rows if out is None else out.unionByName(rows)
    return out


# --- projects and jobs ---------------------------------------------------------------------------------------------------


def _projects(spark, sf):
    """A project per source; a third of them without a title."""
    number = F.substring("source", 4, 9).cast("int")
    docs = table(spark, sf, "documents").groupBy("source").agg(F.min("lang").alias("lang"))
    return docs.select(
        F.col("source").alias("project_id"),
        F.when(number % 3 == 0, "").otherwise(F.concat(F.lit("P "), "source")).alias("title"),
        F.when(number % 6 == 0, "").otherwise(F.concat(F.lit("B "), "source")).alias("book_title"),
        F.col("lang").alias("glossary"),
        F.when(number % 2 == 0, F.lit("job-0")).alias("last_job_id"),
        F.lit("completed").alias("last_job_status"),
        F.lit(100).alias("last_job_percent"),
        F.array(F.lit("job-0")).alias("job_ids"),
        F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("created_at"),
        F.to_timestamp(F.lit("2024-02-01 00:00:00")).alias("updated_at"),
    )


_PROJECTS = """projects AS (SELECT source AS project_id, CAST(substring(source, 4) AS INTEGER) AS number,
  CASE WHEN CAST(substring(source, 4) AS INTEGER) % 3 = 0 THEN '' ELSE 'P ' || source END AS title,
  CASE WHEN CAST(substring(source, 4) AS INTEGER) % 6 = 0 THEN '' ELSE 'B ' || source END AS book_title,
  min(lang) AS glossary FROM documents GROUP BY source)"""
_TITLE = f"""CASE WHEN title <> '' THEN title WHEN book_title <> '' THEN book_title
  ELSE '{C.UNTITLED_PROJECT}' END"""


@query(
    "list_projects",
    S.with_(_TRANSLATED, _PROJECTS)
    + f"""SELECT p.project_id, {_TITLE} AS title, CASE WHEN number % 2 = 0 THEN 'job-0' END AS last_job_id,
      (SELECT count(*) FROM chapter_results r WHERE r.job_id = p.project_id) AS result_chapters,
      (SELECT count(*) FROM books b WHERE b.job_id = p.project_id) AS chapter_count FROM projects p""",
)
def list_projects(spark, sf):
    chaps = chapters(spark, sf).select(F.col("job_id").alias("project_id"))
    done = chapter_results(spark, sf).select(F.col("job_id").alias("project_id"))
    listed = RP.list_projects(_projects(spark, sf), chaps, done)
    return listed.select("project_id", "title", "last_job_id", "result_chapters", "chapter_count")


@query(
    "sync_projects",
    S.with_(_PROJECTS)
    + f"""SELECT project_id, CASE WHEN number % 4 <> 3 THEN {_TITLE} ELSE title END AS title,
      CASE WHEN number % 4 = 1 THEN 'new' ELSE glossary END AS glossary,
      CASE WHEN number % 4 <> 3 THEN 'job-1' WHEN number % 2 = 0 THEN 'job-0' END AS last_job_id,
      CASE WHEN number % 4 <> 3 THEN 'failed' ELSE 'completed' END AS last_job_status,
      CAST(CASE WHEN number % 4 <> 3 THEN 50 ELSE 100 END AS BIGINT) AS last_job_percent,
      CASE WHEN number % 4 <> 3 THEN 'job-0 job-1' ELSE 'job-0' END AS job_ids,
      CAST(CASE WHEN number % 4 <> 3 THEN 10 END AS BIGINT) AS last_job_total,
      CAST(CASE WHEN number % 4 <> 3 THEN 5 END AS BIGINT) AS last_job_done,
      CASE WHEN number % 4 <> 3 THEN nullif(book_title, '') END AS book_title,
      CASE WHEN number % 4 <> 3 THEN 'demo' END AS provider, 'bank ' || number AS context_bank,
      '2024-01-01' AS created_at FROM projects""",
)
def sync_projects(spark, sf):
    projects = _projects(spark, sf)
    number = F.substring("project_id", 4, 9).cast("int")
    jobs = projects.filter(number % 4 != 3).select(
        "project_id",
        F.lit("job-1").alias("job_id"),
        "book_title",
        F.when(number % 4 == 1, "new").otherwise("").alias("glossary"),
        F.lit("failed").alias("status"),
        F.lit(50).alias("percent"),
        F.lit(10).alias("total"),
        F.lit(5).alias("done"),
        F.lit("").alias("context_bank"),
        F.create_map(F.lit("provider"), F.lit("demo"), F.lit("apiKey"), F.lit("k")).alias("settings"),
    )
    known = projects.drop("book_title").withColumn("context_bank", F.concat(F.lit("bank "), number.cast("string")))
    synced = RP.sync_projects(known, jobs, _now())
    keys = F.size(F.coalesce(F.map_keys("settings"), F.array()))
    return synced.select(
        *[c for c in synced.columns if c not in ("updated_at", "created_at", "job_ids", "settings")],
        F.array_join("job_ids", " ").alias("job_ids"),
        F.when(keys == 1, F.col("settings")["provider"]).alias("provider"),
        F.date_format("created_at", "yyyy-MM-dd").alias("created_at"),
    )


_REPORT = f"""{_ISSUES}, {_CONSISTENT.replace(S.PAIRS + ', ' + S.TERMS + ', ', '')},
prog AS ({S.progress('job_id', 'qa_pairs')}),
res AS (SELECT job_id, count(DISTINCT chapter_index) AS results FROM qa_pairs WHERE translated_text <> '' GROUP BY 1),
qc AS (SELECT job_id, count(*) AS qa_count FROM issues GROUP BY 1),
cc AS (SELECT job_id, count(*) AS consistency_count FROM cons GROUP BY 1)"""


@query(
    "job_report",
    S.with_(_REPORT)
    + f"""SELECT p.job_id, p.total, p.done, p.percent, {S.OUTCOME} AS status,
      coalesce(res.results, 0) AS results, coalesce(qc.qa_count, 0) AS qa_count,
      coalesce(cc.consistency_count, 0) AS consistency_count,
      '{{"provider":"demo","model":"' || p.job_id || '"}}' AS config
    FROM prog p LEFT JOIN res USING (job_id) LEFT JOIN qc USING (job_id) LEFT JOIN cc USING (job_id)""",
)
def job_report(spark, sf):
    return _job(spark, sf)[0].select(
        "job_id", "total", "done", "percent", "status", "results", "qa_count", "consistency_count", "config"
    )


@query(
    "job_record",
    S.with_(_REPORT)
    + f"""SELECT job_id, 'job' AS section, '' AS place, '{{"provider":"demo","model":"' || job_id || '"}}' AS content FROM prog
    UNION ALL SELECT job_id, 'results', CAST(chapter_index AS VARCHAR),
      string_agg(translated_text, {S.LF} || {S.LF} ORDER BY segment_index)
      FROM qa_pairs WHERE translated_text <> '' GROUP BY job_id, chapter_index
    UNION ALL SELECT job_id, 'qa', chapter_index || ',' || segment_index || ',' || issue_no, type || ' ' || message FROM issues
    UNION ALL SELECT job_id, 'consistency', CAST(term_idx AS VARCHAR), 'consistency ' || {_CONS_MSG} FROM cons""",
)
def job_record(spark, sf):
    report, *tables = _job(spark, sf)
    record = RP.job_record(report, *tables).filter("section <> 'summaries'")
    value = lambda name: F.get_json_object("json", f"$.{name}")
    content = F.coalesce(
        value("config"), value("translated_text"), F.concat_ws(" ", value("type"), value("message"))
    )
    place = F.array_join(F.col("place").cast("array<string>"), ",")
    return record.select("job_id", "section", place.alias("place"), content.alias("content"))


def _job(spark, sf):
    """The report and the tables behind it, of one run whose issue tables are written once."""
    results, glossary = materialize(qa_pairs(spark, sf), "results"), terms(spark, sf)
    whole = RP.reassemble(results)
    configs = results.select("job_id").distinct().select(
        "job_id", F.lit("demo").alias("provider"), F.col("job_id").alias("model"), F.lit("k").alias("apiKey")
    )
    chaps = results.select(
        "job_id", "project_id", "chapter_index", F.col("chapter_title").alias("title"), "text"
    ).dropDuplicates(["job_id", "chapter_index"])
    tables = (
        whole,
        materialize(Q.check_jobs(results, glossary), "issues"),
        SM.summarize_chapters(chaps, whole, glossary, _now()),
        materialize(RP.consistency_issues(pairs(spark, sf), glossary), "consistency"),
    )
    return RP.job_report(results, *tables, configs), *tables


# --- flagship ----------------------------------------------------------------------------------------------------------------

_STATUS_SQL = f"""{_TRANSLATED}, prog AS ({S.progress('job_id', 'done')}),
q AS (SELECT job_id, count(*) FILTER (WHERE {_RATIO} < CAST(0.18 AS DOUBLE)) AS short_issues,
  count(*) FILTER (WHERE {_FORMAT}) AS format_issues
  FROM done WHERE status IN ('completed', 'cached') GROUP BY 1),
r AS (SELECT job_id, count(*) AS chapters, CAST(sum(length(translated_text)) AS BIGINT) AS chars
  FROM whole GROUP BY 1)"""


@query(
    "book_status",
    S.with_(_STATUS_SQL)
    + f"""SELECT prog.job_id, total, done, percent, {S.OUTCOME} AS status,
      coalesce(q.short_issues, 0) AS short_issues, coalesce(q.format_issues, 0) AS format_issues,
      coalesce(r.chapters, 0) AS chapters, coalesce(r.chars, 0) AS chars
    FROM prog LEFT JOIN q USING (job_id) LEFT JOIN r USING (job_id)""",
)
def book_status(spark, sf):
    # results are a table that several reports read
    done = materialize(_translated(spark, sf), "results")
    prog = WK.progress(done)
    checks = WK.qa_eligible(done).select(
        "job_id",
        Q.check_short(_src(), _tgt()).isNotNull().alias("short"),
        Q.check_format(_src(), _tgt()).isNotNull().alias("format"),
    )
    counts = checks.groupBy("job_id").agg(
        F.count_if("short").alias("short_issues"), F.count_if("format").alias("format_issues")
    )
    whole = RP.reassemble(done).groupBy("job_id").agg(
        F.count("*").alias("chapters"), F.sum(F.length("translated_text")).alias("chars")
    )
    joined = prog.join(WK.job_outcome(prog), "job_id").join(counts, "job_id", "left").join(
        whole, "job_id", "left"
    )
    return joined.select(
        "job_id", "total", "done", "percent", "status",
        *[
            F.coalesce(c, F.lit(0)).alias(c)
            for c in ("short_issues", "format_issues", "chapters", "chars")
        ],
    )


