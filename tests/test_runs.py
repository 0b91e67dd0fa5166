"""Translation runs and streams: retries, sharing, restarts."""

import pytest
from pyspark.sql import functions as F

from bookflow import constants as C
from bookflow.config import JobConfig
from bookflow.operators.translate import TranslateError, translate, translate_batch, with_retries
from bookflow.schemas import CACHE
from bookflow.streaming.books import read_library, stream_books
from bookflow.streaming.progress import read_progress, stream_progress
from bookflow.streaming import translate as runs
from bookflow.streaming.translate import read_attempts, read_results, stream_translate

SEGS = (
    "job_id string, segment_id string, chapter_index int, segment_index int, "
    "fingerprint string, text string"
)
NOW = "2024-01-01 00:00:00"
CFG = JobConfig(provider="test", model="m")


def segments(spark, texts):
    rows = [("j", f"s{i}", i, 1, f"f-{t}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SEGS)


def now():
    return F.to_timestamp(F.lit(NOW))


def test_retry_policy():
    def outcome(*errors, retries=2):
        left, waits = list(errors), []

        def fn(request):
            if left:
                raise left.pop(0)
            return "ok", None

        result = with_retries(fn, retries, waits.append)({})
        return result["translated_text"], len(result["log"]), len(waits)

    busy, bad = TranslateError("x", status=503), TranslateError("x", status=400)
    assert outcome() == ("ok", 1, 0)
    assert outcome(busy, ValueError("?")) == ("ok", 3, 2)
    assert outcome(busy, busy, busy) == (None, 3, 2)
    assert outcome(bad) == (None, 1, 0)
    assert outcome(TranslateError("x", status=400, retryable=True)) == ("ok", 2, 1)
    assert outcome(busy, retries=0) == (None, 1, 0)


def test_equal_requests_are_sent_once(spark, tmp_path):
    def fn(request):
        return f"T {request['text']}", None

    texts = ["a", "b", "a", "a", ""]
    none = spark.createDataFrame([], CACHE)
    out = translate_batch(segments(spark, texts), none, CFG, now(), fn)
    got = {r.segment_id: (r.status, r.attempts) for r in out.results.collect()}
    assert got == {"s0": ("completed", 1), "s1": ("completed", 1), "s2": ("cached", 0),
                   "s3": ("cached", 0), "s4": ("completed", 1)}
    assert out.attempts.count() == 3 and out.entries.count() == 3
    apart = translate_batch(segments(spark, texts), none, JobConfig(use_cache=False), now(), fn)
    assert {r.status for r in apart.results.collect()} == {"completed"}
    assert apart.attempts.count() == 5 and apart.entries.count() == 0


def test_followers_of_a_failure_stay_pending(spark):
    def fn(request):
        raise TranslateError("no", status=401)

    out = translate_batch(segments(spark, ["a", "a"]), spark.createDataFrame([], CACHE), CFG, now(), fn)
    assert {r.segment_id: r.status for r in out.results.collect()} == {"s0": "failed", "s1": "pending"}
    assert out.entries.count() == 0


def test_calls_run_concurrently_in_order(spark):
    requests = segments(spark, [f"t{i}" for i in range(30)]).select("fingerprint", "text")
    calls = translate(requests, lambda r: (r["text"].upper(), None), partitions=2, concurrency=4)
    assert all(r.fingerprint == f"f-{r.translated_text.lower()}" for r in calls.collect())


def test_stream_of_books_takes_each_file_once(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for n, name in enumerate(("a.txt", "b.txt")):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(f"book {n}")
        stream_books(spark, source, out, mark).awaitTermination()
    library = read_library(spark, out)
    assert sorted(r.title for r in library.books.collect()) == ["a", "b"]
    assert sorted(r.text for r in library.chapters.collect()) == ["book 0", "book 1"]


def test_stream_translation_resumes_after_a_crash(spark, tmp_path, monkeypatch):
    source, state, mark, calls = (str(tmp_path / n) for n in ("in", "state", "mark", "calls"))
    (tmp_path / "calls").mkdir()

    def translator(poison):
        def fn(request):
            import uuid
            from pathlib import Path

            (Path(calls) / f"{request['text']}-{uuid.uuid4().hex}").touch()
            if request["text"] == poison:
                raise TranslateError("later", status=401)
            return request["text"].upper(), None

        return fn

    def start(fn):
        stream = spark.readStream.schema(SEGS).parquet(source)
        stream_translate(stream, state, mark, CFG, fn, now()).awaitTermination()

    def made():
        return len(list((tmp_path / "calls").iterdir()))

    # the first start dies after its calls, before its results are written
    write = runs.write_batch

    def dying(df, path, batch_id):
        if path.endswith("/results"):
            raise RuntimeError("lost")
        write(df, path, batch_id)

    segments(spark, ["a", "b"]).coalesce(1).write.parquet(source)
    monkeypatch.setattr(runs, "write_batch", dying)
    with pytest.raises(Exception, match="lost"):
        start(translator("b"))
    assert made() == 2 and read_results(spark, state).count() == 0
    monkeypatch.setattr(runs, "write_batch", write)

    # the replay takes the committed calls instead of repeating them
    start(translator("b"))
    assert made() == 2
    assert {r.segment_id: r.status for r in read_results(spark, state).collect()} == {
        "s0": "completed", "s1": "failed"}

    # the failed segment and a copy of a finished one arrive again
    again = segments(spark, ["a", "b", "a"]).coalesce(1)
    again.write.mode("append").parquet(source)
    start(translator(None))
    rows = {r.segment_id: (r.status, r.translated_text) for r in read_results(spark, state).collect()}
    assert rows == {"s0": ("completed", "A"), "s1": ("completed", "B"), "s2": ("cached", "A")}
    assert made() == 3 and read_attempts(spark, state).count() == 3


@pytest.mark.parametrize("first, second", [([0, 1], [2]), ([2], [0, 1])])
def test_progress_ignores_the_order_of_batches(spark, tmp_path, first, second):
    source, state, mark = (str(tmp_path / n) for n in ("in", "state", "mark"))
    rows = [("j", "s1", 1, "running", None, "2024-01-01 00:00:00"),
            ("j", "s2", 1, "completed", None, "2024-01-01 00:00:00"),
            ("j", "s1", 2, "failed", None, "2024-01-01 00:01:00")]
    schema = "job_id string, segment_id string, attempt int, status string, error string, t string"
    for part in (first, second):
        df = spark.createDataFrame([rows[i] for i in part], schema)
        typed = df.withColumn("ts", F.to_timestamp("t")).drop("t").coalesce(1)
        typed.write.mode("append").parquet(source)
        stream = spark.readStream.schema(typed.schema).parquet(source)
        stream_progress(stream, state, mark).awaitTermination()
    r = read_progress(spark, state).first()
    assert (r.total, r.completed, r.failed, r.outcome) == (2, 1, 1, "completed_with_errors")


def test_queue_of_unfinished_segments(spark, tmp_path):
    """A representative fails, its follower waits; a start without new input completes both."""
    src, state, checkpoint = (str(tmp_path / n) for n in ("src", "state", "checkpoint"))
    segments(spark, ["a", "a", "b"]).write.parquet(src)

    def start(fn, **options):
        source = spark.readStream.schema(SEGS).parquet(src)
        stream_translate(source, state, checkpoint, CFG, fn, now(), **options).awaitTermination()
        return {r.segment_id: r.status for r in read_results(spark, state).collect()}

    def refuse(request):
        if request["text"] == "a":
            raise TranslateError("no", status=401)
        return "B", None

    def work(request):
        return f"T {request['text']}", None

    assert start(refuse) == {"s0": "failed", "s1": "pending", "s2": "completed"}
    assert start(refuse) == {"s0": "failed", "s1": "failed", "s2": "completed"}  # the pending one was tried
    assert start(work) == {"s0": "failed", "s1": "failed", "s2": "completed"}  # failed ones wait to be asked for
    assert start(work, retry_failed=True) == {"s0": "completed", "s1": "cached", "s2": "completed"}
    assert start(work, retry_failed=True) == {"s0": "completed", "s1": "cached", "s2": "completed"}


def test_texts_of_calls_are_not_shuffled_into_results(spark):
    """Without broadcasts too, a call's own result and cache entry are its row; copies and hits come out right."""
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        first = translate_batch(segments(spark, ["a", "b", "a", ""]), spark.createDataFrame([], CACHE), CFG, now())
        for part in (first.entries, first.attempts):
            assert "Exchange" not in part._jdf.queryExecution().executedPlan().toString()
        again = translate_batch(segments(spark, ["c", "b", "c"]), first.entries, CFG, now())
        status = [{r.segment_id: r.status for r in out.results.collect()} for out in (first, again)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)
    assert status[0] == {"s0": "completed", "s1": "completed", "s2": "cached", "s3": "completed"}
    assert status[1] == {"s0": "completed", "s1": "cached", "s2": "cached"}


def test_repeated_and_missing_keys_keep_their_results(spark):
    rows = [("j", "s0", 0, 1, "f-a", "a"), ("j", "s0", 0, 1, "f-a", "a"), ("j", "s1", 1, 1, "f-a", "a"),
            (None, "s2", 2, 1, "f-b", "b"), ("k", "s3", 3, 1, "f-b", "b"), ("j", "s4", 4, 1, None, None)]
    out = translate_batch(spark.createDataFrame(rows, SEGS), spark.createDataFrame([], CACHE), CFG, now())
    # each of two equal rows takes both of their calls; a row without a job cannot lead its copies
    assert sorted((r.segment_id, r.status) for r in out.results.collect()) == [
        *[("s0", "completed")] * 4, *[("s1", "cached")] * 2]


def test_a_batch_with_repeated_keys_meets_waiting_segments(spark, tmp_path):
    src, state, checkpoint = (str(tmp_path / n) for n in ("src", "state", "checkpoint"))

    def start(fn, texts, **options):
        batch = segments(spark, texts)
        batch.unionByName(batch).coalesce(1).write.mode("append").parquet(src)
        source = spark.readStream.schema(SEGS).parquet(src)
        stream_translate(source, state, checkpoint, CFG, fn, now(), **options).awaitTermination()
        return {r.segment_id: (r.status, r.translated_text) for r in read_results(spark, state).collect()}

    def refuse(request):
        if request["text"] == "a":
            raise TranslateError("no", status=401)
        return "B", None

    assert start(refuse, ["a", "a", "b"]) == {"s0": ("failed", None), "s1": ("pending", None), "s2": ("completed", "B")}
    # s1 waits and arrives again, again behind s0, s3 is new; the cache has s2's text
    got = start(refuse, ["a", "a", "b", "b"])
    assert got == {"s0": ("failed", None), "s1": ("pending", None), "s2": ("completed", "B"), "s3": ("cached", "B")}


def test_results_of_a_segment_finished_twice(spark, tmp_path):
    from bookflow.streaming.state import write_batch

    state, fields = str(tmp_path), [c.split()[0] for c in runs.RESULTS.split(", ")]

    def put(number, rows):
        made = [(j, s, "f", status, text, 1, None, None, None) for j, s, status, text in rows]
        write_batch(spark.createDataFrame(made, runs.RESULTS).select(fields), f"{state}/results", number)

    def read():
        return sorted((r.segment_id, r.status, r.translated_text) for r in read_results(spark, state).collect())

    put(1, [("j", "s0", "completed", "A"), ("j", "s1", "failed", None), (None, "s2", "pending", None)])
    put(2, [("j", "s1", "completed", "B"), (None, "s2", "cached", "C"), ("j", "s3", "failed", None)])
    plain = [("s0", "completed", "A"), ("s1", "completed", "B"), ("s2", "cached", "C"), ("s3", "failed", None)]
    assert read() == plain
    put(3, [("j", "s0", "completed", "A2"), (None, "s2", "failed", None)])
    assert read() == [("s0", "completed", "A2"), ("s1", "completed", "B"), ("s2", "failed", None), ("s3", "failed", None)]


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    from bookflow import session

    assert session.is_local("local[8]") and session.is_local("local")
    assert not session.is_local("local-cluster[2,1,1024]") and not session.is_local("spark://x:7077")
    monkeypatch.setattr(session, "is_local", lambda master: False)

    class Bare:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "yarn"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_dir(Bare)


def test_a_key_stored_twice_gives_one_hit(spark):
    from bookflow.operators.cache import cache_lookup

    rows = [(1, "f-a", f"2024-01-0{d} 00:00:00", f"T{d}") for d in (1, 2)]
    cache = spark.createDataFrame(rows, "version int, key string, created_at string, text string")
    hits = cache_lookup(segments(spark, ["a"]), cache.withColumn("version", F.lit(C.CACHE_VERSION)))
    assert [r.translated_text for r in hits.collect()] == ["T2"]
