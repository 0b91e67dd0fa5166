"""Steps whose memory or time once grew faster than their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookflow.operators import glossary as G
from bookflow.operators import retrieval as R
from bookflow.sources import text_files as T

BANK = "project_id string, item_idx int, title string, text string"
SEGS = "project_id string, doc_id long, text string"


def _bank(spark):
    words = ["river", "mountain", "dragon", "castle", "winter"]
    rows = [
        (p, i, words[i % 5] if i % 3 else None, f"{words[(i * 7) % 5]} {words[(i + 1) % 5]} w{i} {'y' * 40 if i == 5 else ''}")
        for p in ("a", "b") for i in range(40)
    ]
    return spark.createDataFrame(rows, BANK)


def _texts(spark):
    rows = [
        ("a", 1, "the River by a castle w7 w12"), ("b", 2, "dragon dragon winter y" + "y" * 20), ("c", 3, "river"),
        ("a", 4, None), ("b", 5, ""), (None, 6, "river"), ("a", 7, "yyyy w3 mountain"),
    ]
    return spark.createDataFrame(rows, SEGS)


def _python_steps(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_small_blocks_share_a_worker(spark):
    """A block a worker took one Python process per block in every task."""
    best = R.best_context(_texts(spark), _bank(spark), 3, block=7)
    assert _python_steps(best) == 1


def test_large_banks_bound_the_workers_of_a_stage(spark, monkeypatch):
    monkeypatch.setattr(R, "MAX_BANK_ROWS", 5)
    segs, bank = _texts(spark), _bank(spark)
    best = R.best_context(segs, bank, 3, block=5)
    assert _python_steps(best) <= R.CHAIN
    want = R.top_context(R.score_context(segs, bank, ["doc_id"], small=False), ["doc_id"], 3)
    rows = best.select("doc_id", F.posexplode("retrieved").alias("p", "r"))
    got = rows.select("doc_id", "r.item_idx", "r.score", (F.col("p") + 1).alias("rank"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    assert best.count() == segs.count()


def test_scores_in_slices(spark, monkeypatch):
    segs, bank = _texts(spark), _bank(spark)
    want = sorted(map(tuple, R.score_context(segs, bank, ["doc_id"], small=False).collect()))
    monkeypatch.setattr(R, "SLICE_TOKENS", 2)
    assert sorted(map(tuple, R.score_context(segs, bank, ["doc_id"], small=True).collect())) == want


def test_terms_are_found_in_one_pass(spark):
    """A text was searched once per term, in an interpreted expression."""
    names = [("abcd", ["x"]), ("ab", [""]), ("abcde", None), ("bcdx", ["日本語"]), ("語", []), (None, ["q"]), ("a b", ["", None, "zz"])]
    kind = "project_id string, term_idx int, source string, target string, aliases array<string>, note string"
    terms = spark.createDataFrame([("a", i, s, "t", al, "n") for i, (s, al) in enumerate(names)], kind)
    texts = ["abcd", "xabcde", "日本語 bcdx", "zz", "ab", "", None, "本語", "a b q", "abc", "ABCD"]
    segs = spark.createDataFrame([("a", i, t) for i, t in enumerate(texts)] + [("b", 99, "abcd"), (None, 98, "abcd")], SEGS)

    def expected(text, limit):
        hits = [i for i, (s, al) in enumerate(names) if al is not None and any(n and text and n in text for n in (s, *al))]
        return hits[:limit]

    out = G.attach_terms(segs, terms, ["doc_id"], 2, small=True)
    assert _python_steps(out) == 1
    got = {r["doc_id"]: [t["term_idx"] for t in r["matched"]] for r in out.collect()}
    assert got == {i: expected(t, 2) for i, t in enumerate(texts)} | {99: [], 98: []}


def test_clean_utf8_is_decoded_in_place(spark):
    """Every text went through Python, a batch of files at a time."""
    values = [
        b"", None, b"Hello", "héllo 日本語".encode(), b"\xef\xbb\xbfmark", b"\xff\xfeh\x00i\x00", b"a\x01b\x7f",
        "こんにちは".encode("shift_jis"), "café".encode("latin-1"), b"nul\x00", "�\u0085\U0001f600".encode(),
        b"\xed\xa0\x80", b"\xc0\x80", ("日" * 300).encode(), "x﻿".encode(),
    ]
    files = spark.createDataFrame([(str(i), "n", v) for i, v in enumerate(values)], "book_id string, name string, content binary")
    got = {r["book_id"]: (r["encoding"], r["score"], r["text"]) for r in T.decode_books(files).collect()}
    assert got == {str(i): T.detect(v or b"") for i, v in enumerate(values)}


def test_only_other_bytes_reach_python(spark, monkeypatch):
    def nothing(data):
        if data:
            raise ValueError("clean bytes in Python")
        return "utf-8", 0.0, ""

    monkeypatch.setattr(T, "detect", nothing)
    files = spark.createDataFrame([("a", "n", "héllo".encode())], "book_id string, name string, content binary")
    assert T.decode_books(files).first()["text"] == "héllo"
