"""Archives as ordered pieces, and archives read member by member."""

import io
import re
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from bookflow.functions import zips as Z
from bookflow.sinks.epub import book_epub, epub_pieces, write_epubs
from bookflow.sources import epub as E
from bookflow.sources.books import parse_files, read_books

CHAPTERS = "book_id string, book_title string, chapter_index int, title string, text string"


def chapters(spark, n, book="b"):
    return spark.range(n).select(
        F.lit(book).alias("book_id"),
        F.lit("T & {n}").alias("book_title"),
        (F.col("id") * 3).cast("int").alias("chapter_index"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("{title} é <"), F.col("id").cast("string"))).otherwise("").alias("title"),
        F.concat(F.lit("Text\n\nof 😀 "), F.col("id").cast("string")).alias("text"),
    )


def test_joined_crc():
    a, b = b"some bytes", b"and more of them" * 1000
    assert Z.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert Z.joined_crc(zlib.crc32(a), 0, 0) == zlib.crc32(a)
    assert Z.joined_crc(0, zlib.crc32(b), len(b)) == zlib.crc32(b)


def test_pieces_of_a_book_with_many_chapters(spark):
    """More members than 16 bits count and several buckets of lines; no piece holds more than a chapter."""
    n = 70_000
    pieces = epub_pieces(chapters(spark, n)).select("piece", "content", F.octet_length("content").alias("size"))
    rows = pieces.orderBy("piece").collect()
    assert len({r.piece for r in rows}) == len(rows) and max(r.size for r in rows) < 4096
    with zipfile.ZipFile(io.BytesIO(b"".join(bytes(r.content) for r in rows))) as archive:
        assert len(archive.namelist()) == n + 5
        assert archive.testzip() is None
        opf, nav = (archive.read(f"OEBPS/{p}").decode() for p in ("content.opf", "nav.xhtml"))
        page = archive.read(f"OEBPS/chapters/chapter-{n}.xhtml").decode()
    assert opf.count("<item ") == n + 2 and opf.count("<itemref ") == n and "<dc:title>T &amp; {n}</dc:title>" in opf
    assert nav.count("<li>") == n and f">Chapter {n}</a>" in nav and ">{title} é &lt;2</a>" in nav
    assert f"<h1>Chapter {n}</h1>" in page and f"<p>of 😀 {n - 1}</p>" in page


def test_records_beyond_32_bits(spark):
    at, size, members = (1 << 33) + 5, 100, 9
    row = spark.range(1).select(
        Z.entry(F.lit("x"), F.lit(7), F.lit(size), F.lit(at)).alias("entry"),
        Z.entry_size(F.lit("x"), F.lit(at)).alias("size"),
        Z.ending(F.lit(members), F.lit(size), F.lit(at)).alias("end"),
        Z.ending(F.lit(members), F.lit(size), F.lit(50)).alias("short"),
    ).first()
    entry, end = bytes(row.entry), bytes(row.end)
    assert len(entry) == row.size == 46 + 1 + 12
    assert struct.unpack("<L", entry[42:46])[0] == 0xFFFFFFFF and entry[46:47] == b"x"
    assert struct.unpack("<HHQ", entry[47:]) == (1, 8, at)
    assert struct.unpack("<QQQQ", end[24:56]) == (members, members, size, at)
    assert struct.unpack("<LLQL", end[56:76]) == (Z.LOCATOR64, 0, at + size, 1)
    assert len(bytes(row.short)) == 22


def test_written_files_are_the_pieces(spark, tmp_path):
    both = chapters(spark, 30, "a/b").unionByName(chapters(spark, 3, "c"))
    values = {r.book_id: bytes(r.epub) for r in book_epub(both).collect()}
    written = {r.book_id: r for r in write_epubs(both, str(tmp_path)).collect()}
    assert {b: open(r.path, "rb").read() for b, r in written.items()} == values
    assert {b: r.bytes for b, r in written.items()} == {b: len(v) for b, v in values.items()}
    assert len(list(tmp_path.iterdir())) == 2
    library = read_books(spark, str(tmp_path))
    assert library.rejects.count() == 0
    read = library.chapters.orderBy("book_id", "chapter_index").collect()
    assert len(read) == 33 and [r.chapter_index for r in read[:30]] == list(range(30))


def archive_of(path, pages, method=zipfile.ZIP_DEFLATED, image=b"\x89PNG" * 1000):
    items = "".join(f'<item id="p{i}" href="p{i}.html" media-type="text/html"/>' for i in range(len(pages)))
    refs = "".join(f'<itemref idref="p{i}"/>' for i in reversed(range(len(pages))))
    with zipfile.ZipFile(path, "w", method) as z:
        z.writestr("META-INF/container.xml", '<rootfile full-path="o/c.opf"/>')
        z.writestr("image.png", image)
        z.writestr("o/c.opf", f"<dc:title>B</dc:title><manifest>{items}</manifest><spine>{refs}</spine>")
        for i, page in enumerate(pages):
            z.writestr(f"o/p{i}.html", page)


def test_members_are_read_by_place(spark, tmp_path):
    """Only what the spine needs is read: a broken image does not matter, a broken page does."""
    archive_of(tmp_path / "good.epub", [f"<h1>T{i}</h1><p>text {i}</p>" for i in range(4)])
    archive_of(tmp_path / "stored.epub", ["<p>one</p>"], zipfile.ZIP_STORED)
    for name, part in (("image.epub", b"\x89PNG"), ("page.epub", b"plain")):
        archive_of(tmp_path / name, ["<p>plain</p>"], zipfile.ZIP_STORED)
        data = (tmp_path / name).read_bytes()
        (tmp_path / name).write_bytes(data.replace(part, part[::-1], 1))
    (tmp_path / "none.epub").write_bytes(b"no archive")
    library = read_books(spark, str(tmp_path))
    books = {r.name: r for r in library.books.collect()}
    assert set(books) == {"good.epub", "stored.epub", "image.epub"} and books["good.epub"].files == 7
    rejects = {r.name: r.reason for r in library.rejects.collect()}
    assert set(rejects) == {"page.epub", "none.epub"} and "bad checksum" in rejects["page.epub"]
    texts = library.chapters.where(F.endswith("book_id", F.lit("good.epub"))).orderBy("chapter_index").collect()
    assert [r.text for r in texts] == [f"T{i}\ntext {i}" for i in (3, 2, 1, 0)]


def test_scan_reads_no_contents(spark, tmp_path):
    archive_of(tmp_path / "a.epub", ["<p>x</p>"])
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    listing = E.epub_listing(files.select(F.col("path").alias("book_id"), F.lit("a").alias("name"), "path"))
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert [re.sub("#.*", "", c) for c in re.findall(r"FileScan binaryFile \[([^\]]*)\]", plan)] == ["path"]
    assert {r.member_path for r in listing.collect()} == {"META-INF/container.xml", "image.png", "o/c.opf", "o/p0.html"}


@pytest.mark.parametrize("path, scheme", [("file:/x/y", "local"), ("file:///x/y", "local"), ("/x/y", "local")])
def test_store(path, scheme):
    from bookflow.sources.stores import store

    files, place = store(path)
    assert files.type_name == scheme and place == "/x/y"


def test_no_files(spark):
    empty = spark.createDataFrame([], "book_id string, name string, ext string, content binary, path string")
    library = parse_files(empty)
    assert [t.count() for t in (library.books, library.chapters, library.rejects)] == [0, 0, 0]
    assert epub_pieces(spark.createDataFrame([], CHAPTERS)).count() == 0


def test_tags_of_packages_are_dealt_over_tasks(spark, monkeypatch):
    """Packages in one partition do not keep the parsing of their tags in its task; odd tags come out right."""
    made = []

    def seen(df, name, *args, **options):
        made.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return materialize(df, name, *args, **options)

    materialize = E.materialize
    monkeypatch.setattr(E, "materialize", seen)
    opf = (
        '<manifest><item id="a" href="x.xhtml" media-type="text/html"/>'
        '<ITEM id="b" id="c" href="d/../&amp;.xhtml" media-type="application/xhtml+xml"/>'
        '<item id="a" href="y.xhtml" media-type="text/html"/><item id="n" media-type="text/html"/>'
        '<item href="z.xhtml" media-type="text/html"/><item id="p" href="p.png" media-type="image/png"/></manifest>'
    )
    spine = '<spine><itemref idref="c"/><itemref/><itemref idref="p"/><itemref idref="a"/><itemref idref="a"/></spine>'
    rows = [("k", "O/content.opf", opf + spine), ("f", "content.opf", opf), ("none", None, None)]
    packages = spark.createDataFrame(rows, "book_id string, opf_path string, opf string").coalesce(1)
    got = sorted((r.book_id, r.pos, r.href) for r in E.epub_spine(packages).collect())
    assert got == [("f", 0, "y.xhtml"), ("f", 1, "&.xhtml"),
                   ("k", 0, "O/&.xhtml"), ("k", 1, "O/y.xhtml"), ("k", 2, "O/y.xhtml")]
    plan = dict(made)["spine"]
    # each use of the tags stands above a shuffle of them by book and place
    assert plan.count("REPARTITION_BY_COL") >= 2
