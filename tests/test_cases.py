"""The basic cases: splitting, packing, the EPUB round trip and a whole demo job."""

import pytest
from pyspark.sql import functions as F

from bookflow.config import JobConfig
from bookflow.functions import html as H
from bookflow.functions import text as X
from bookflow.operators import cache as K
from bookflow.operators import glossary as G
from bookflow.operators import qa as Q
from bookflow.operators import reports as RP
from bookflow.operators import work as WK
from bookflow.operators.chapters import clean_chapters, split_chapters
from bookflow.operators.segments import build_segments, pack_segments
from bookflow.operators.summaries import names, top_names
from bookflow.functions.arrays import value_counts
from bookflow.operators.translate import translate_batch
from bookflow.schemas import CACHE, CONTEXT_BANK, GLOSSARY
from bookflow.sinks.epub import book_epub
from bookflow.sources.books import parse_files
from bookflow.sources.text_files import detect

TXT = b"Chapter 1\nHello world.\n\nChapter 2\nAnother scene."
FILES = "book_id string, name string, ext string, content binary"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_text_book_is_split_at_its_headings(spark):
    files = spark.createDataFrame([("f1", "sample.txt", ".txt", bytearray(TXT))], FILES)
    library = parse_files(files)
    book = library.books.first()
    assert (book.title, book.format, book.encoding) == ("sample", "txt", "utf-8")
    chapters = library.chapters.orderBy("chapter_index").collect()
    assert [c.title for c in chapters] == ["Chapter 1", "Chapter 2"]
    assert "Hello world" in chapters[0].text


def test_epub_round_trip(spark):
    rows = [("b", "Translated Sample", 0, "One", "First paragraph.\n\nSecond paragraph."),
            ("b", "Translated Sample", 1, "Two", "Final <paragraph> & more.")]
    chapters = spark.createDataFrame(
        rows, "book_id string, book_title string, chapter_index int, title string, text string"
    )
    archive = book_epub(chapters).first()
    files = spark.createDataFrame([("e", "t.epub", ".epub", archive.epub)], FILES)
    library = parse_files(files)
    book = library.books.first()
    assert (book.title, book.format, book.files) == ("Translated Sample", "epub", 7)
    read = library.chapters.orderBy("chapter_index").collect()
    assert len(read) == 2 and "First paragraph" in read[0].text
    assert "Final <paragraph> & more." in read[1].text


def test_large_books_continue_in_volumes(spark):
    rows = [("b", "B", i, "", f"text {i}") for i in range(7)]
    chapters = spark.createDataFrame(
        rows, "book_id string, book_title string, chapter_index int, title string, text string"
    )
    volumes = book_epub(chapters, volume_bytes=500).orderBy("volume").collect()
    assert len(volumes) > 1
    files = spark.createDataFrame(
        [(f"v{v.volume}", "v.epub", ".epub", v.epub) for v in volumes], FILES
    )
    read = parse_files(files).chapters.orderBy("book_id", "chapter_index").collect()
    assert [r.text.split("\n")[-1] for r in read] == [f"text {i}" for i in range(7)]
    assert read[-1].title == "Chapter 7"


def test_packing(spark):
    df = spark.createDataFrame([("alpha\n\nbeta\n\ngamma",), (" \n ",)], "text string")
    got = [r.pieces for r in pack_segments(df, 12).collect()]
    assert got == [["alpha\n\nbeta", "gamma"], []]


def test_demo_job_end_to_end_and_second_run_translates_nothing(spark, tmp_path):
    cfg = JobConfig(target_language="Chinese", chunk_size=1200)
    files = spark.createDataFrame([("p", "sample.txt", ".txt", bytearray(TXT))], FILES)
    chapters = clean_chapters(parse_files(files).chapters).withColumn("job_id", F.lit("j"))
    segs = build_segments(chapters, cfg).withColumn("project_id", F.lit("p"))
    none = {n: spark.createDataFrame([], s) for n, s in (("t", GLOSSARY), ("b", CONTEXT_BANK))}
    summaries = spark.createDataFrame(
        [], "project_id string, chapter_index int, title string, summary string"
    )
    marked = K.fingerprint(segs, cfg, none["t"], none["b"], summaries)
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    first = translate_batch(marked, spark.createDataFrame([], CACHE), cfg, now)
    places = segs.select("job_id", "segment_id", "chapter_index", "segment_index")
    done = first.results.join(places, ["job_id", "segment_id"])
    prog = WK.progress(done)
    assert WK.job_outcome(prog).first().status == "completed"
    assert prog.first().percent == 100
    results = RP.attach_segments(chapters, RP.reassemble(done)).collect()
    assert len(results) == 2 and all("译：" in r.translated_text for r in results)

    again = translate_batch(marked, first.entries, cfg, now)
    assert {r.status for r in again.results.collect()} == {"cached"}
    assert again.attempts.count() == 0
    assert WK.resume_filter(marked, first.results).count() == 0


def test_heading_lines(spark):
    text = "第 十二 章 剑\na\n序章\nb\nchapter x\n正文第1章"
    books = spark.createDataFrame([("b", text)], "book_id string, text string")
    rows = split_chapters(books).orderBy("chapter_index").collect()
    assert [r.title for r in rows] == ["第 十二 章 剑", "序章"]
    assert rows[1].text == "序章\nb\nchapter x\n正文第1章"


def test_text_before_the_first_heading(spark):
    books = spark.createDataFrame([("b", "intro\n序章\na\n终章")], "book_id string, text string")
    assert [r.title for r in split_chapters(books).collect()] == ["序章", "终章"]
    kept = split_chapters(books, keep_preamble=True).collect()
    assert [(r.chapter_index, r.text) for r in kept][0] == (0, "intro")


def test_glossary_lines(spark):
    raw = spark.createDataFrame(
        [("p", "# c\nA => B # n // x\r\nC：D\nE=\nF")], "project_id string, glossary string"
    )
    got = [(r.term_idx, r.source, r.target, r.note) for r in G.parse_glossary(raw).collect()]
    assert got == [(1, "A", "B", "n"), (2, "C", "D", ""), (3, "E=", "", ""), (4, "F", "", "")]


SRC, TGT = "s" * 100, "t"


@pytest.mark.parametrize(
    "src, tgt, kinds",
    [
        ("abc", " \n ", ["empty"]),
        (SRC, TGT * 17, ["length"]),
        (SRC, TGT * 18, []),
        (SRC, TGT * 420, []),
        (SRC, TGT * 421, ["length"]),
        ("ひ" + "漢" * 20, "ひ" + "漢" * 20, ["untranslated"]),
        ("漢" * 21, "漢" * 21, []),
        ("ひ" * 20, "ひ" * 20, []),
        ("aa\nbb", "a\nb\nc\nd", []),
        ("aa\nbb", "a\nb\nc\nd\ne", ["format"]),
        ("abc", "Sure: abc", ["instruction"]),
        ("abcdef", "以下是 abc", ["instruction"]),
        ("abcdef", "Surely abc", []),
        ("x" * 20, "12345678\n12345678\n12345678", ["repetition"]),
        ("x" * 20, "1234567\n1234567\n1234567", []),
        ("x" * 20, "12345678\n12345678", []),
    ],
)
def test_rules(spark, src, tgt, kinds):
    nothing = F.array().cast(f"array<{G.TERM_TYPE}>")
    df = spark.createDataFrame([(src, tgt)], "s string, t string")
    issues = df.select(Q.check_segment(F.col("s"), F.col("t"), nothing).alias("i")).first().i
    assert [i.type for i in issues] == kinds


def test_term_rules(spark):
    terms = spark.createDataFrame(
        [("p", 0, "t1", "Alice", "爱丽丝", ["Ally"], "", "term", "contains"),
         ("p", 1, "t2", "Bob", "", [], "", "term", "contains")],
        GLOSSARY,
    )
    results = spark.createDataFrame(
        [("j", "c1-s1", "p", 0, "C", 1, "Ally and Bob", "…", "completed"),
         ("j", "c1-s2", "p", 0, "C", 2, "Alice", "爱丽丝", "completed"),
         ("j", "c2-s1", "p", 1, "D", 1, "Alice", "", "failed")],
        "job_id string, segment_id string, project_id string, chapter_index int, "
        "chapter_title string, segment_index int, text string, translated_text string, status string",
    )
    for small in (True, False):
        issues = Q.check_jobs(results, terms, small=small).filter("type = 'glossary'").collect()
        assert [(i.segment_id, i.source) for i in issues] == [("c1-s1", "Alice")]
        found = RP.consistency_issues(results, terms, small=small).collect()
        assert [(r.source, r.seen, r.missing) for r in found] == [("Alice", 2, 1)]
        assert [tuple(x) for x in found[0].locations] == [(1, "D", 1)]


def test_names(spark):
    counted = value_counts(names(F.lit("アリス アリス 王国 王国 勇者")))
    assert value(spark, top_names(counted)) == ["アリス", "王国", "勇者"]
    assert value(spark, top_names(counted, 2)) == ["アリス", "王国"]


@pytest.mark.parametrize("tokens, length", [(0, 0), (50, 163), (51, 166), (1000, 400)])
def test_budgets(spark, tokens, length):
    cut = value(spark, F.length(X.trim_to_budget(F.lit("x" * 400), tokens)))
    assert cut == length


def test_html(spark):
    assert value(spark, H.html_decode(F.lit("&amp;lt; &#x41;&#66; &copy; &#x110000;"))) == (
        "&lt; AB &copy; &#x110000;".replace("&lt;", "<")
    )
    attrs = value(spark, H.extract_attrs(F.lit("a=\"1\" b='x&amp;y' a=\"2\"")))
    assert attrs == {"a": "2", "b": "x&y"}
    assert value(spark, H.resolve_path(F.lit("a/b/"), F.lit("../c/./d.x"))) == "a/c/d.x"
    page = F.lit("<title>T</title><script>x</script><h2></h2><p>a<br/>b</p><pre>c</pre>")
    assert value(spark, H.html_body(page)) == "T\na\nb\nc"
    assert value(spark, H.html_title(page, F.lit("fallback"))) == "fallback"


HELLO = "こんにちは"


@pytest.mark.parametrize(
    "data, encoding, text",
    [
        (HELLO.encode("utf-8"), "utf-8", HELLO),
        (HELLO.encode("cp932"), "shift_jis", HELLO),
        (HELLO.encode("euc_jp"), "euc-jp", HELLO),
        ("Hello world".encode("utf-16-le"), "utf-16le", "Hello world"),
        (HELLO.encode("utf-16-le"), "latin1", None),
        (b"\xff\xfe" + HELLO.encode("utf-16-le"), "utf-16le", HELLO),
        (b"", "utf-8", ""),
    ],
)
def test_charsets(data, encoding, text):
    label, _, decoded = detect(data)
    assert label == encoding
    assert text is None or decoded == text


def test_rejected_files(spark):
    import io
    import zipfile

    def archive(**members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in members.items():
                z.writestr(name.replace("__", "/").replace("_xml", ".xml"), data)
        return bytearray(out.getvalue())

    rootfile = '<rootfile full-path="x.opf"/>'
    files = spark.createDataFrame(
        [
            ("a", "a.pdf", ".pdf", bytearray(b"x")),
            ("b", "b.epub", ".epub", bytearray(b"no zip")),
            ("c", "c.epub", ".epub", archive(mimetype="x")),
            ("d", "d.epub", ".epub", archive(**{"META-INF__container_xml": "<a/>"})),
            ("e", "e.epub", ".epub", archive(**{"META-INF__container_xml": rootfile})),
            ("f", "f.epub", ".epub",
             archive(**{"META-INF__container_xml": rootfile, "x.opf": "<package/>"})),
        ],
        FILES,
    )
    got = {r.book_id: r.reason.split(":")[-1].strip() for r in parse_files(files).rejects.collect()}
    assert got["a"].startswith("Only .txt") and got["c"] == "missing META-INF/container.xml"
    assert got["d"] == "missing OPF path" and got["e"] == "missing OPF file x.opf"
    assert got["f"] == "no readable XHTML chapters" and set(got) == set("abcdef")


def test_glossary_lines_are_split_once(spark):
    """White space beside a separator is no part of a value, whatever it is, and a text is split once."""
    lines = ["a =  # n", "a =>", "=a=b", "b\u3000：\xa0c // d // e", "x # y", "a\u2028=\u2028b", "a\u2028b=c", "a= b // \x85"]
    raw = spark.createDataFrame([("p", "\n".join(lines)), ("q", None), ("r", "")], "project_id string, glossary string")
    parsed = G.parse_glossary(raw)
    got = [(r.term_idx, r.source, r.target, r.note) for r in parsed.collect()]
    assert got == [
        (0, "a", "# n", ""), (1, "a", ">", ""), (2, "=a", "b", ""), (3, "b", "c", "d"), (4, "x # y", "", ""),
        (5, "a", "b", ""), (6, "a\u2028b=c", "", ""), (7, "a", "b", ""),
    ]
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("split(glossary") == 1
