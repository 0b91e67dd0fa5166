"""Queries of the work queue, the cache and translation runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookflow.config import JobConfig
from bookflow.operators import cache as K
from bookflow.operators import work as WK
from bookflow.operators.translate import TranslateError, translate, translate_batch
from bookflow.plans import sql as S
from bookflow.plans.adapters import (
    CONFIG,
    attempts,
    bank,
    documents,
    event_results,
    segments,
    summaries,
    table,
    terms,
)
from bookflow.plans.registry import query
from bookflow.schemas import CACHE
from bookflow.session import scratch_dir
from bookflow.streaming.state import read_keyed, write_keyed


def _now():
    return F.to_timestamp(F.lit("2024-06-01 00:00:00"))


# --- work queue ---------------------------------------------------------------------------------------


@query(
    "pending_segments",
    S.with_(S.RESULTS)
    + "SELECT job_id, segment_id, status FROM results WHERE status NOT IN ('completed', 'cached', 'failed')",
)
def pending_segments(spark, sf):
    return WK.pending(event_results(spark, sf)).drop("error")


@query(
    "pending_with_retry",
    S.with_(S.RESULTS)
    + "SELECT job_id, segment_id, status FROM results WHERE status NOT IN ('completed', 'cached')",
)
def pending_with_retry(spark, sf):
    return WK.pending(event_results(spark, sf), retry_failed=True).drop("error")


@query(
    "qa_eligible",
    S.with_(S.RESULTS)
    + "SELECT job_id, segment_id, status FROM results WHERE status IN ('completed', 'cached')",
)
def qa_eligible(spark, sf):
    return WK.qa_eligible(event_results(spark, sf)).drop("error")


_RESUMED = "CASE WHEN status IN ('running', 'interrupted') THEN 'pending' ELSE status END"


@query(
    "reset_for_resume",
    S.with_(S.RESULTS) + f"SELECT job_id, segment_id, {_RESUMED} AS status, error FROM results",
)
def reset_for_resume(spark, sf):
    return WK.reset_for_resume(event_results(spark, sf))


@query(
    "reset_failed",
    S.with_(S.RESULTS)
    + """SELECT job_id, segment_id, CASE WHEN status IN ('running', 'interrupted', 'failed')
      THEN 'pending' ELSE status END AS status, CASE WHEN status <> 'failed' THEN error END AS error
    FROM results""",
)
def reset_failed(spark, sf):
    return WK.reset_failed(event_results(spark, sf))


_JOBS = """jobs AS (SELECT job_id, CASE CAST(job_id AS BIGINT) % 4 WHEN 0 THEN 'running'
  WHEN 1 THEN 'queued' WHEN 2 THEN 'completed' ELSE 'failed' END AS job_status
  FROM (SELECT DISTINCT job_id FROM results))"""


def _jobs(spark, sf):
    n = F.col("job_id").cast("long") % 4
    status = F.when(n == 0, "running").when(n == 1, "queued").when(n == 2, "completed").otherwise("failed")
    ids = event_results(spark, sf).select("job_id").distinct()
    return ids.withColumns({"status": status, "error": F.lit(None).cast("string")})


@query(
    "mark_interrupted",
    S.with_(S.RESULTS, _JOBS)
    + """SELECT r.job_id, r.segment_id, CASE WHEN job_status IN ('running', 'queued') AND status = 'running'
      THEN 'pending' ELSE status END AS status,
      CASE WHEN job_status IN ('running', 'queued') THEN 'interrupted' ELSE job_status END AS job_status
    FROM results r JOIN jobs USING (job_id)""",
)
def mark_interrupted(spark, sf):
    jobs, segs = WK.mark_interrupted(_jobs(spark, sf), event_results(spark, sf))
    return segs.select("job_id", "segment_id", "status").join(
        jobs.select("job_id", F.col("status").alias("job_status")), "job_id"
    )


@query(
    "resume_filter",
    S.with_(S.RESULTS)
    + """SELECT job_id, segment_id FROM results r WHERE NOT EXISTS (
      SELECT 1 FROM results d WHERE d.job_id = r.job_id AND d.segment_id = r.segment_id
        AND d.status IN ('completed', 'cached'))""",
)
def resume_filter(spark, sf):
    results = event_results(spark, sf)
    return WK.resume_filter(results.select("job_id", "segment_id"), results)


@query("progress", S.with_(S.RESULTS) + S.progress("job_id", "results"))
def progress(spark, sf):
    return WK.progress(event_results(spark, sf))


@query(
    "status_counts",
    'SELECT CAST(user_id AS VARCHAR) AS job_id, event_type AS status, count(*) AS "count" FROM events GROUP BY 1, 2',
)
def status_counts(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("status")
    )
    return WK.status_counts(rows)


@query(
    "percent",
    """SELECT CAST(doc_id AS BIGINT) AS doc_id, CASE WHEN n_chars % 50 = 0 THEN 0
      ELSE CAST(floor(100.0::DOUBLE * least(doc_id % 50, n_chars % 50) / (n_chars % 50) + 0.5) AS BIGINT) END AS percent
    FROM documents""",
)
def percent(spark, sf):
    total = F.col("n_chars") % 50
    done = F.least(F.col("doc_id") % 50, total)
    return table(spark, sf, "documents").select("doc_id", WK.percent(done, total).alias("percent"))


@query(
    "job_outcome",
    S.with_(S.RESULTS, f"prog AS ({S.progress('job_id', 'results')})")
    + f"SELECT job_id, {S.OUTCOME} AS status FROM prog",
)
def job_outcome(spark, sf):
    return WK.job_outcome(WK.progress(event_results(spark, sf)))


@query(
    "attempt_stats",
    S.with_(S.ATTEMPTS)
    + """SELECT job_id, segment_id, count(*) AS attempts,
      strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_attempt_at FROM attempts GROUP BY ALL""",
)
def attempt_stats(spark, sf):
    return WK.attempt_stats(attempts(spark, sf)).withColumn(
        "last_attempt_at", F.date_format("last_attempt_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )


LATEST_SQL = """latest AS (SELECT job_id, segment_id, status FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id, segment_id ORDER BY ts DESC, attempt DESC) AS rn
  FROM attempts) WHERE rn = 1)"""


@query(
    "latest_status",
    S.with_(S.ATTEMPTS, LATEST_SQL) + "SELECT job_id, segment_id, status FROM latest",
)
def latest_status(spark, sf):
    return WK.latest_status(attempts(spark, sf)).select("job_id", "segment_id", "status")


# --- cache ------------------------------------------------------------------------------------------------


def _doc_segments(spark, sf):
    return documents(spark, sf).select(
        F.col("source").alias("job_id"),
        F.col("doc_id").cast("string").alias("segment_id"),
        F.col("doc_id").cast("int").alias("chapter_index"),
        F.lit(1).alias("segment_index"),
        F.sha2("text", 256).alias("fingerprint"),
        "text",
    )


def _doc_cache(spark, sf, rest: int = 0):
    docs = documents(spark, sf).filter(F.col("doc_id") % 2 == rest)
    keyed = docs.groupBy(F.sha2("text", 256).alias("key")).agg(F.max("text").alias("t"))
    return keyed.select(
        F.lit(1).alias("version"),
        "key",
        _now().alias("created_at"),
        F.lit("demo").alias("provider"),
        F.lit("m").alias("model"),
        F.lit("").alias("source_language"),
        F.lit("").alias("target_language"),
        F.concat(F.lit(" "), "t", F.lit("\n")).alias("text"),
        F.lit(None).cast("string").alias("usage"),
    )


_CACHE_TEXT = S.trim("text")


@query(
    "cache_lookup",
    f"""SELECT CAST(doc_id AS VARCHAR) AS segment_id,
      text IN (SELECT text FROM documents WHERE doc_id % 2 = 0) AS hit,
      CASE WHEN text IN (SELECT text FROM documents WHERE doc_id % 2 = 0) THEN {_CACHE_TEXT} END AS translated_text
    FROM documents""",
)
def cache_lookup(spark, sf):
    looked = K.cache_lookup(_doc_segments(spark, sf).drop("text"), _doc_cache(spark, sf))
    return looked.select("segment_id", "hit", "translated_text")


@query(
    "cache_store",
    f"""SELECT CAST(doc_id AS VARCHAR) AS segment_id,
      CASE WHEN text IN (SELECT text FROM documents WHERE doc_id % 2 = 0) THEN {_CACHE_TEXT} END AS translated_text
    FROM documents""",
)
def cache_store(spark, sf):
    """The cache as a table that grows by batches and is read by the buckets of what is asked for."""
    path = f"{scratch_dir(spark)}/cache"
    entries = _doc_cache(spark, sf)
    for number, part in enumerate((F.col("key") < "8", F.col("key") >= "8")):
        write_keyed(entries.filter(part), path, number, ["key"])
    segs = _doc_segments(spark, sf).drop("text")
    found = read_keyed(spark, path, CACHE, segs.select(F.col("fingerprint").alias("key")), ["key"])
    return K.cache_lookup(segs, found.drop("batch")).select("segment_id", "translated_text")


@query(
    "dedupe_work",
    """SELECT CAST(doc_id AS VARCHAR) AS segment_id, row_number() OVER (
      PARTITION BY text ORDER BY source, doc_id) = 1 AS first FROM documents""",
)
def dedupe_work(spark, sf):
    first, rest = WK.dedupe_work(_doc_segments(spark, sf).drop("text"))
    return first.select("segment_id", F.lit(True).alias("first")).unionByName(
        rest.select("segment_id", F.lit(False).alias("first"))
    )


def _joined_sql(*fields: str) -> str:
    return " || chr(31) || ".join(f"length({f}) || chr(31) || {f}" for f in fields)


def _tree_sql(name: str, source: str, keys: str, order: str, row: str) -> str:
    """Hashes folded 1024 at a time, three levels."""
    by = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""{name}_0 AS (SELECT {by}CAST({order} AS BIGINT) AS i, sha256({row}) AS h FROM {source}),
{name}_1 AS (SELECT {by}i // 1024 AS i, sha256(string_agg(h, {S.LF} ORDER BY i)) AS h FROM {name}_0 GROUP BY {by}i // 1024),
{name}_2 AS (SELECT {by}i // 1024 AS i, sha256(string_agg(h, {S.LF} ORDER BY i)) AS h FROM {name}_1 GROUP BY {by}i // 1024),
{name} AS (SELECT {by}sha256(string_agg(h, {S.LF} ORDER BY i)) AS sha FROM {name}_2 {group})"""


_DIGESTS = ",\n".join(
    [
        _tree_sql("gsha", "terms", "", "term_idx", _joined_sql("source", "target", "coalesce(alias, '')", "note")),
        _tree_sql("bsha", "bank", "", "item_idx", _joined_sql("title", "text")),
        _tree_sql("ssha", "summaries", "job_id", "chapter_index", _joined_sql("title", "summary")),
    ]
)


@query(
    "fingerprint",
    S.with_(S.SEGMENTS, S.TERMS, S.BANK, S.SUMMARIES, _DIGESTS)
    + f"""SELECT s.job_id, s.segment_id, sha256('{CONFIG.digest()}' || chr(31) || gsha.sha || chr(31)
      || bsha.sha || chr(31) || coalesce(ssha.sha, '') || chr(31) || sha256(s.text)) AS fingerprint
    FROM segments s LEFT JOIN ssha USING (job_id), gsha, bsha""",
)
def fingerprint(spark, sf):
    marked = K.fingerprint(
        segments(spark, sf), CONFIG, terms(spark, sf), bank(spark, sf), summaries(spark, sf), "job_id"
    )
    return marked.select("job_id", "segment_id", "fingerprint")


@query(
    "cache_put",
    """SELECT sha256(text) AS key, CASE WHEN max(doc_id % 2) = 1 THEN 'T ' || text
      ELSE ' ' || text || chr(10) END AS text FROM documents GROUP BY text""",
)
def cache_put(spark, sf):
    segs = _doc_segments(spark, sf).filter(F.col("chapter_index") % 2 == 1)
    results = segs.select(
        "fingerprint",
        F.lit("completed").alias("status"),
        F.concat(F.lit("T "), F.col("text")).alias("translated_text"),
        F.lit(None).cast("string").alias("usage"),
    )
    entries = K.new_entries(results, CONFIG, _now())
    return K.cache_put(_doc_cache(spark, sf), entries).select("key", "text")


@query(
    "cache_evict",
    """SELECT DISTINCT sha256(text) AS key FROM documents WHERE doc_id % 2 = 0 AND text NOT IN (
      SELECT text FROM documents WHERE doc_id % 3 = 0)""",
)
def cache_evict(spark, sf):
    gone = documents(spark, sf).filter(F.col("doc_id") % 3 == 0)
    keys = gone.select(F.sha2("text", 256).alias("key")).distinct()
    return K.cache_evict(_doc_cache(spark, sf), keys).select("key")


@query(
    "cache_stats",
    """SELECT count(*) AS entries, CAST(sum(strlen('{"version":1,"key":"","text":') + 64
      + strlen(to_json(text)) + 1) AS BIGINT) AS bytes FROM (SELECT DISTINCT text FROM documents)""",
)
def cache_stats(spark, sf):
    docs = documents(spark, sf).select("text").distinct()
    cache = docs.select(F.lit(1).alias("version"), F.sha2("text", 256).alias("key"), "text")
    return K.cache_stats(cache)


# --- translation runs -----------------------------------------------------------------------------------------


def _flaky(request: dict):
    """A translator whose outcome depends on the text's length only."""
    kind = len(request["text"]) % 5
    if kind == 1:
        raise TranslateError("busy " + "x" * 3000, status=503)
    if kind == 2:
        raise TranslateError("bad request", status=400)
    return f"T {request['text']}", '{"mode":"test"}'


@query(
    "translate_with_retries",
    f"""SELECT sha256(text) AS fingerprint, CASE WHEN k IN (1, 2) THEN NULL ELSE 'T ' || text END AS translated_text,
      CASE k WHEN 1 THEN 'busy ' || repeat('x', 1995) WHEN 2 THEN 'bad request' END AS error,
      CASE k WHEN 1 THEN CAST(3 AS BIGINT) ELSE 1 END AS attempts
    FROM (SELECT DISTINCT text, length(text) % 5 AS k FROM documents)""",
)
def translate_with_retries(spark, sf):
    docs = documents(spark, sf).select("text").distinct()
    requests = docs.select(F.sha2("text", 256).alias("fingerprint"), "text")
    calls = translate(requests, _flaky, max_retries=2, sleep=lambda _: None)
    return calls.select("fingerprint", "translated_text", "error", F.size("log").alias("attempts"))


_BATCH_SQL = f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS rn,
    text IN (SELECT text FROM documents WHERE doc_id % 2 = 0) AS hit FROM documents)
  SELECT source AS job_id, CAST(doc_id AS VARCHAR) AS segment_id, sha256(text) AS fingerprint,
    CASE WHEN hit OR rn > 1 THEN 'cached' ELSE 'completed' END AS status,
    CASE WHEN hit THEN {_CACHE_TEXT} ELSE {S.trim(S.demo('text', 'Chinese', CONFIG.preset.name))} END AS translated_text,
    CASE WHEN hit OR rn > 1 THEN CAST(0 AS BIGINT) ELSE 1 END AS attempts
  FROM d"""


@query("translate_batch", _BATCH_SQL)
def translate_documents(spark, sf):
    out = translate_batch(_doc_segments(spark, sf), _doc_cache(spark, sf), CONFIG, _now())
    return out.results.select(
        "job_id", "segment_id", "fingerprint", "status", "translated_text", "attempts"
    )


@query(
    "translate_batch_failures",
    """WITH d AS (SELECT *, length(text) % 5 AS k,
      row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS rn FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS segment_id,
      CASE WHEN k IN (1, 2) THEN CASE WHEN rn = 1 THEN 'failed' ELSE 'pending' END
           WHEN rn = 1 THEN 'completed' ELSE 'cached' END AS status,
      CASE WHEN rn > 1 THEN CAST(0 AS BIGINT) WHEN k = 1 THEN 3 ELSE 1 END AS attempts,
      CASE WHEN rn = 1 THEN CASE k WHEN 1 THEN 'busy ' || repeat('x', 1995) WHEN 2 THEN 'bad request' END END AS error
    FROM d""",
)
def translate_failures(spark, sf):
    cfg = JobConfig(provider="test", model="t")
    none = _doc_cache(spark, sf).limit(0)
    out = translate_batch(
        _doc_segments(spark, sf), none, cfg, _now(), fn=_flaky, sleep=lambda _: None
    )
    return out.results.select("segment_id", "status", "attempts", "error")


