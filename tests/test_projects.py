"""Project documents with fields that no schema names, and one import of all their tables."""

import gzip
import io
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from bookflow.functions.json_slices import sliced
from bookflow.operators.tables import OPEN, upsert
from bookflow.session import _MADE, materialize, scratch_dir
from bookflow.sinks import projects as sinks
from bookflow.sinks.projects import export_projects, project_lines, write_documents
from bookflow.sources import projects as PJ
from bookflow.sources.stores import Unpacked


def documents(spark, *docs):
    return PJ.parse_projects(spark.createDataFrame([(json.dumps(d),) for d in docs], "json string"))


def now():
    return F.to_timestamp(F.lit("2024-06-01 00:00:00"))


def empty_projects(spark):
    return PJ.project_headers(documents(spark, {"id": "x"})).limit(0)


def test_open_fields_survive_import_upsert_and_export(spark, tmp_path):
    first = {"id": "p", "title": "A", "mood": {"deep": [1, 2.5, None]}, "shelf": "s", "apiKey": "secret", "api_key": "s"}
    second = {"id": "p", "title": "B", "mood": None, "new": True}
    projects = empty_projects(spark)
    for doc in (first, second):
        projects = PJ.import_projects(documents(spark, doc), projects, now())
    header = projects.drop("settings", "book_title")
    out = json.loads(export_projects(header, {}, now()).first().json)
    assert out["title"] == "B" and out["mood"] is None and out["shelf"] == "s" and out["new"] is True
    assert not {"apiKey", "api_key", "extra"} & set(out)
    line = json.loads(project_lines(header, {}).first().json)
    assert {k: line[k] for k in ("mood", "shelf", "new")} == {"mood": None, "shelf": "s", "new": True}
    # written to a file and read again
    write_documents(export_projects(header, {}, now()), str(tmp_path / "out"))
    again = PJ.read_projects(spark, str(tmp_path / "out")).select(F.to_json("extra")).first()[0]
    assert {"mood": None, "shelf": "s", "new": True}.items() <= json.loads(again).items()


def test_merge_by_name(spark):
    def table(*rows):
        frame = spark.createDataFrame([(k, json.dumps(v) if v is not None else None) for k, v in rows], "k string, j string")
        return frame.select("k", F.from_json("j", OPEN).alias("extra"))

    old = table(("a", {"x": 1, "y": {"z": 1}}), ("b", {"x": 1}), ("c", None))
    new = table(("a", {"y": {"q": 2}, "w": [3]}), ("c", {"x": 5}), ("d", {"x": 6}))
    got = {r.k: json.loads(r.e) for r in upsert(old, new, ["k"], now()).select("k", F.to_json("extra").alias("e")).collect()}
    assert got == {"a": {"x": 1, "y": {"q": 2}, "w": [3]}, "b": {"x": 1}, "c": {"x": 5}, "d": {"x": 6}}


def test_broken_documents(spark):
    docs = PJ.parse_projects(spark.createDataFrame([("no json",), (None,), ("{}",)], "json string"))
    assert docs.count() == 3 and docs.filter(F.col("id").isNotNull()).count() == 0


def test_import_of_all_tables(spark):
    """A section that a document holds replaces the rows, one that it leaves out keeps them."""
    old = documents(
        spark,
        {"id": "p", "qaIssues": [{"type": "old"}], "results": [{"title": "r", "translatedText": "old"}],
         "contextBank": [{"id": "1", "content": "c"}]},
        {"id": "q", "qaIssues": [{"type": "kept"}]},
    )
    sections = list(PJ.SECTIONS)
    none = {s: t.limit(0) for s, t in tables(old).items()}
    first = PJ.import_documents(old, empty_projects(spark), none, now())
    new = documents(
        spark,
        {"id": "p", "qaIssues": [{"type": "new"}, {"type": "newer"}], "book": {"chapters": [{"title": "c", "text": "t"}]},
         "consistencyIssues": [], "chapterSummaries": [{"chapterIndex": 3, "summary": "s"}]},
    )
    out = PJ.import_documents(new, first.pop("projects"), first, now())
    assert set(out) == {"projects", *sections}
    assert sorted((r.project_id, r.type) for r in out["qaIssues"].collect()) == [("p", "new"), ("p", "newer"), ("q", "kept")]
    assert [r.translatedText for r in out["results"].collect()] == ["old"]
    assert [(r.project_id, r.text) for r in out["contextBank"].collect()] == [("p", "c")]
    assert [(r.chapter_index, r.text) for r in out["chapters"].collect()] == [(0, "t")]
    assert [(r.chapterIndex, r.summary) for r in out["chapterSummaries"].collect()] == [(3, "s")]
    assert out["consistencyIssues"].count() == 0


def tables(docs):
    return {
        s: PJ.project_bank(docs) if s == "contextBank" else PJ._children(docs, place, index)
        for s, (place, index) in PJ.SECTIONS.items()
    }


def test_documents_in_slices():
    """Large documents are cut at their sections, however the blocks of the file fall."""
    text = 'a "b" [c], {d}: \\ \n é漢'
    first = {"results": [{"title": text, "n": i} for i in range(40)], "id": "p", "x": {"results": [1]},
             "book": {"title": "t", "chapters": [{"text": text}] * 30, "more": [[], {}]}, "qaIssues": []}
    second = {"results": "none", "id": None}
    content = (json.dumps(first, indent=1) + "\n" + json.dumps(second, ensure_ascii=False)).encode()
    for block in (1, 7, 1 << 20):
        for size in (1, 100, 1 << 20):
            rows = list(sliced(io.BytesIO(content), ["book.chapters", "results", "qaIssues"], size, block))
            heads = [json.loads(t) for t, offset in rows if offset is None]
            for t, offset in rows:
                if offset is not None:
                    part = json.loads(t)
                    assert part["id"] == "p" and len(t) < 600
                    whole, more = (heads[0]["book"]["chapters"], part["book"]["chapters"]) if "book" in part else (
                        heads[0]["results"], part["results"])
                    assert len(whole) == offset
                    whole.extend(more)
            assert heads == [first, second]
    for broken in (b"no json", b'{"a": [', b"", b" ", b'[{"id": 1}]'):
        assert list(sliced(io.BytesIO(broken), ["results"], 100)) == [(broken, None)]
    assert list(sliced(io.BytesIO(b'{"results": [1, 2'), ["results"], 2)) == [(None, None)]


def test_large_projects_are_written_and_read_in_pieces(spark, tmp_path):
    """No row holds a project, and what comes back is what one document would have held."""
    ids = ["p", "p2", "q x", None]
    header = spark.createDataFrame([(p, p, f"T {p}") for p in ids] + [("", "e", "E")], "project_id string, id string, title string")
    n = 300
    rows = [(p, i, f"c{i}", f'{p} "{i}", [x]\n' * 40) for p in ("p", "q x", None, "absent") for i in range(n)]
    chaps = spark.createDataFrame(rows, "project_id string, i int, title string, text string").repartition(7)
    results = chaps.filter("project_id = 'p'").select("project_id", "i", "title", F.col("text").alias("translatedText"))
    pieces = export_projects(header, {"chapters": (chaps, "i"), "results": (results, "i")}, now())
    assert pieces.agg(F.max(F.length("json"))).first()[0] < 2000
    path = str(tmp_path / "out")
    write_documents(pieces, path)
    text = spark.read.text(f"{path}/project_id=p", wholetext=True).first()[0]
    doc = json.loads(text)
    assert [c["title"] for c in doc["book"]["chapters"]] == [f"c{i}" for i in range(n)] == [r["title"] for r in doc["results"]]
    docs = PJ.read_projects(spark, path).cache()
    assert sorted(r.title for r in docs.filter("title is not null").collect()) == ["E", "T None", "T p", "T p2", "T q x"]
    assert docs.agg(F.max(F.size("book.chapters"))).first()[0] < n
    got = sorted((r.project_id, r.chapter_index, r.title, r.text) for r in PJ.project_chapters(docs).collect())
    want = sorted((p.replace(" ", "-"), i, c, t) for p, i, c, t in rows if p in ("p", "q x"))
    assert got == want
    assert sorted((r.result_index, r.title) for r in PJ.project_results(docs).collect()) == [(i, f"c{i}") for i in range(n)]
    assert PJ.project_headers(docs).count() == 5


def test_documents_take_little_disk(spark, tmp_path):
    """Documents are packed, and what they were made of is gone when they are whole: scratch and shuffle files."""
    header = spark.createDataFrame([("p", "p", "P"), ("q/1", "q", "Q")], "project_id string, id string, title string")
    text = [(p, i, " ".join(f"w{(i * 31 + k) % 997}" for k in range(400))) for p in ("p", "q/1") for i in range(200)]
    chaps = spark.createDataFrame(text, "project_id string, i int, text string").repartition(5)
    spent = scratch_dir(spark)
    kept = materialize(chaps, "chapters", spent)
    made, path = set(_MADE[spark.sparkContext.applicationId]) - {spent}, str(tmp_path / "out")
    results = kept.select("project_id", "i", F.col("text").alias("translatedText"))
    pieces = export_projects(header, {"chapters": (kept, "i"), "results": (results, "i")}, now())
    shuffles, until = blocks(spark), time.time() + 30
    write_documents(pieces, path, 2, spent)
    while blocks(spark) - shuffles and time.time() < until:  # the session deletes them in the background
        time.sleep(0.2)
    assert not blocks(spark) - shuffles and not os.path.exists(spent.removeprefix("file:"))
    assert {os.listdir(f.removeprefix("file:"))[0] for f in set(_MADE[spark.sparkContext.applicationId]) - made} <= {"heads", "lookup"}
    files = [str(f) for f in (tmp_path / "out").rglob("*") if f.is_file()]
    assert sorted(os.path.basename(os.path.dirname(f)) for f in files) == ["project_id=p", "project_id=q%2F1"]
    assert sum(map(os.path.getsize, files)) < sum(len(t) for *_, t in text)  # of twice as much text
    docs = PJ.read_projects(spark, path)
    assert sorted((r.chapter_index, r.text) for r in PJ.project_chapters(docs).collect()) == sorted(t[1:] for t in text)
    with pytest.raises(FileExistsError):
        write_documents(pieces, path)


def blocks(spark):
    """Shuffle files of the session."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}


def test_pieces_in_order(spark, tmp_path, monkeypatch):
    """Runs of positions, equal and missing positions, copies and small pieces: the same text as by one sort."""
    monkeypatch.setattr(sinks, "RUN_BITS", 2)
    ids = ["p", None, "", "a:b", "empty"]
    heads = [(p, f"{p}", "T") for p in ids] + [("p", "other", None)]
    header = spark.createDataFrame(heads, "project_id string, id string, title string")
    far = "x" * 300
    rows = [(p, i if i % 7 else None, f"{far if i % 3 else ''}{i % 5}") for p in ids[:4] for i in range(-9, 60)]
    rows += [("p", 8, t) for t in ("a", "a", far + "b", far + "a", far + "a")]
    chaps = spark.createDataFrame(rows, "project_id string, i int, title string").repartition(6)
    items = chaps.filter("i > 3").select("project_id", "i", F.col("title").alias("id"))
    pieces = export_projects(header, {"chapters": (chaps, "i"), "contextBank": (items, "i")}, now()).cache()

    def texts(name):
        found = spark.read.text(str(tmp_path / name), wholetext=True).select("value", F.col("project_id").cast("string"))
        parts = [(r.project_id, json.loads(t)) for r in found.collect() for t in split(r.value)]
        return sorted((str(p), json.dumps(d, sort_keys=True)) for p, d in parts)

    def split(value):
        at = 0
        while value[at:].strip():
            at += len(value[at:]) - len(value[at:].lstrip())
            _, end = json.JSONDecoder().raw_decode(value[at:])
            yield value[at : at + end]
            at += end

    write_documents(pieces, str(tmp_path / "packed"))
    write_documents(pieces, str(tmp_path / "apart"), 2)
    monkeypatch.setattr(sinks, "opened_path", lambda *_: None)  # as in a store that tasks do not open
    write_documents(pieces, str(tmp_path / "text"))
    assert texts("packed") == texts("apart") == texts("text")
    assert len(texts("text")) == 6


def test_gzip_from_any_place(tmp_path):
    """Files of small, large and plain members, read on from any place."""
    parts = [bytes([65 + i % 26]) * (i * 37 % 900) for i in range(300)] + [os.urandom(200_000), b"end"]
    whole = b"".join(parts)
    for name, packed in (("many", b"".join(map(gzip.compress, parts))), ("one", gzip.compress(whole)), ("tail", gzip.compress(whole) + bytes(9))):
        (tmp_path / name).write_bytes(packed)
        with open(tmp_path / name, "rb") as file:
            seen = Unpacked(file, step=1000, chunk=64)
            for at in (0, 5, 150_000, 3, len(whole) - 2, 70_000, 70_001, len(whole) + 9, 0):
                seen.seek(at)
                assert seen.tell() == min(at, len(whole))
                assert [seen.read(10), seen.read(5000)] == [whole[at : at + 10], whole[at + 10 : at + 5010]]
            seen.seek(11)
            assert seen.read() == whole[11:]
