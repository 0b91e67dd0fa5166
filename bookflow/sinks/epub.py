"""EPUB export: an archive is ordered pieces, rows that concatenate to its bytes.

Every chapter is a row: its page with the record before it, its lines in the navigation and the package
file, its entry in the directory. Where a page starts is a running sum; the checksums of the two files
that grow with the chapters are combined from those of buckets of lines. So no group, task or value
holds a book; a writer streams the pieces of one archive into one file.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.functions import zips as Z
from bookflow.functions.text import non_empty, paragraphs, xml_escape
from bookflow.operators.matching import bounded_broadcast
from bookflow.operators.ordering import ordinal, running_total
from bookflow.session import materialize
from bookflow.sources.stores import store

# The parts of an archive that do not depend on the chapters.
XML = '<?xml version="1.0" encoding="UTF-8"?>'
MIMETYPE = "application/epub+zip"
CONTAINER = (
    f'{XML}<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container">'
    '<rootfiles><rootfile full-path="OEBPS/content.opf" '
    'media-type="application/oebps-package+xml"/></rootfiles></container>'
)
STYLE = (
    "body{font-family:serif;line-height:1.8;}h1{font-size:1.4em;}"
    "p{text-indent:2em;margin:0 0 .6em;}"
)
PAGE_HEAD = (
    f'{XML}\n<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="zh-CN"><head><title>'
)
PAGE_STYLE = '</title><link rel="stylesheet" href="../style.css" /></head><body><h1>'
NAV_HEAD = (
    f'{XML}<html xmlns="http://www.w3.org/1999/xhtml" '
    'xmlns:epub="http://www.idpf.org/2007/ops"><head><title>Contents</title></head><body>'
    '<nav epub:type="toc"><h1>Contents</h1><ol>'
)
NAV_TAIL = "</ol></nav></body></html>"
OPF_HEAD = (
    f'{XML}<package xmlns="http://www.idpf.org/2007/opf" version="3.0" '
    'unique-identifier="bookid"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
)
OPF_ITEMS = (
    '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>'
    '<item id="style" href="style.css" media-type="text/css"/>'
)

# The rows of a chapter in the manifest, the spine and the navigation.
ITEM = '<item id="chapter-{n}" href="chapters/chapter-{n}.xhtml" media-type="application/xhtml+xml"/>'
REF = '<itemref idref="chapter-{n}"/>'
LINK = '<li><a href="chapters/chapter-{n}.xhtml">{title}</a></li>'

BETWEEN = "</manifest><spine>"
OPF_TAIL = "</spine></package>"
NAV_PATH, OPF_PATH = "OEBPS/nav.xhtml", "OEBPS/content.opf"
FIXED = (("mimetype", MIMETYPE), ("META-INF/container.xml", CONTAINER), ("OEBPS/style.css", STYLE))

PACKED = "book_id string, volume long, epub binary"
WRITTEN = "book_id string, volume long, path string, bytes long"
BOOK = ["book_id", "volume"]
# Lines whose checksum is taken in one go.
CRC_BITS = 14
# Pieces are numbered by section, then by place.
SECTION_BITS = 40
OPENING, NAV, ITEMS, REFS, CLOSING, PAGES, DIRECTORY, ENDING = range(8)


def chapter_page(title: Column, text: Column) -> Column:
    """The XHTML page of a chapter; ``title`` is not empty."""
    body = F.array_join(
        F.transform(
            paragraphs(text), lambda p: F.concat(F.lit("<p>"), xml_escape(p), F.lit("</p>"))
        ),
        "\n",
    )
    heading = xml_escape(title)
    return F.concat(
        F.lit(PAGE_HEAD), heading, F.lit(PAGE_STYLE), heading, F.lit("</h1>"), body,
        F.lit("</body></html>"),
    )


def chapter_pages(chapters: DataFrame, volume_bytes: int | None = None) -> DataFrame:
    """``book_id, book_title, volume, chapter_index, title, page`` of every chapter.

    A book is one volume. If a caller asks for volumes of some bytes, they fill up in chapter order
    by the bytes of the pages before. Numbers and sizes are running sums: a book never meets in one task.
    """
    counted = ordinal(chapters, ["book_id"], "chapter_index", "__n")
    numbered = F.concat(F.lit("Chapter "), (F.col("__n") + 1).cast("string"))
    title = F.coalesce(non_empty(F.col("title")), numbered)
    paged = counted.select(
        "book_id",
        "book_title",
        "chapter_index",
        F.col("__n").alias("n"),
        title.alias("title"),
        chapter_page(title, F.col("text")).alias("page"),
    )
    if not volume_bytes:
        return paged.withColumn("volume", F.lit(0).cast("long"))
    sized = running_total(paged, ["book_id"], "chapter_index", F.octet_length("page"), "__b")
    volumes = sized.withColumn("volume", F.floor(F.col("__b") / volume_bytes).cast("long")).drop("__b", "n")
    return ordinal(volumes, BOOK, "chapter_index", "n")


def _line(form: str, n: Column, title: Column | None = None) -> Column:
    """A row template filled in; the title comes last, whatever it holds."""
    line = F.replace(F.lit(form), F.lit("{n}"), (n + 1).cast("string"))
    return line if title is None else F.replace(line, F.lit("{title}"), title)


def _lines(n: Column, safe_title: Column) -> dict[str, Column]:
    glue = F.when(n > 0, "\n").otherwise("")
    return {
        "link": F.concat(glue, _line(LINK, n, safe_title)),
        "item": F.concat(glue, _line(ITEM, n)),
        "ref": F.concat(glue, _line(REF, n)),
    }


def _page_path(n: Column) -> Column:
    return _line("OEBPS/chapters/chapter-{n}.xhtml", n)


def _bucket_crc(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("n")
    out = {c: [rows[c].iloc[0]] for c in (*BOOK, "bucket")}
    for c in ("link", "item", "ref"):
        joined = "".join(rows[c]).encode()
        out |= {f"{c}_crc": [zlib.crc32(joined)], f"{c}_bytes": [len(joined)]}
    return pd.DataFrame(out)


_CRCS = ", ".join(f"{c}_crc long, {c}_bytes long" for c in ("link", "item", "ref"))


def _file_crc(rows: pd.DataFrame) -> pd.DataFrame:
    """Sizes and checksums of a book's navigation and package file; a row is a bucket of lines."""
    rows = rows.sort_values("bucket")
    first = rows.iloc[0]

    def joined(parts: list) -> tuple[int, int]:
        crc = size = 0
        for part in parts:
            if isinstance(part, str):
                parted = [(zlib.crc32(part.encode()), len(part.encode()))]
            else:
                parted = zip(rows[f"{part[0]}_crc"], rows[f"{part[0]}_bytes"])
            for c, n in parted:
                crc, size = Z.joined_crc(crc, int(c), int(n)), size + int(n)
        return crc, size

    nav = joined([NAV_HEAD, ("link",), NAV_TAIL])
    opf = joined([first["opf_head"], ("item",), BETWEEN, ("ref",), OPF_TAIL])
    row = [first["book_id"], first["volume"], first["opf_head"], int(rows["chapters"].sum()), *nav, *opf]
    return pd.DataFrame([row], columns=_HEAD_NAMES)


_HEAD = "book_id string, volume long, opf_head string, chapters long, nav_crc long, nav_bytes long, opf_crc long, opf_bytes long"
_HEAD_NAMES = [c.split()[0] for c in _HEAD.split(", ")]


def epub_pieces(chapters: DataFrame, volume_bytes: int | None = None) -> DataFrame:
    """``book_id, volume, piece, content``: the pieces of an archive, in order, are its bytes.

    ``chapters(book_id, book_title, chapter_index, title, text)``; one archive per book (volume 0) of any
    size, unless ``volume_bytes`` asks for volumes. Pages are stored, not packed, under a fixed date.
    Chapters without a book are left out.
    """
    n, page = F.col("n"), F.col("page").cast("binary")
    pages = chapter_pages(chapters, volume_bytes).select(
        *BOOK, "book_title", "n", xml_escape(F.col("title")).alias("safe_title"), "page",
        F.crc32(page).alias("crc"), F.octet_length("page").alias("size"),
    )
    pages = materialize(pages, "pages")

    name = xml_escape(F.coalesce(non_empty(F.col("book_title")), F.lit("translated-novel")))
    identifier = F.substring(F.sha2(F.concat_ws("\x1f", *BOOK), 256), 1, 32)
    opf_head = F.concat(
        F.lit(f'{OPF_HEAD}<dc:identifier id="bookid">urn:uuid:'), identifier, F.lit("</dc:identifier><dc:title>"),
        name, F.lit(f"</dc:title><dc:language>zh-CN</dc:language></metadata><manifest>{OPF_ITEMS}"),
    )
    lines = pages.select(*BOOK, "n", F.shiftright("n", CRC_BITS).alias("bucket"), *[c.alias(k) for k, c in _lines(n, F.col("safe_title")).items()])
    buckets = lines.groupBy(*BOOK, "bucket").applyInPandas(_bucket_crc, f"book_id string, volume long, bucket long, {_CRCS}")
    titles = pages.where("n = 0").select(*BOOK, opf_head.alias("opf_head"))
    counts = pages.groupBy(*BOOK, F.shiftright("n", CRC_BITS).alias("bucket")).agg(F.count("*").alias("chapters"))
    known = buckets.join(counts, [*BOOK, "bucket"]).join(titles, BOOK)
    heads = known.groupBy(*BOOK).applyInPandas(_file_crc, _HEAD)

    opening, fixed, at = [], [], 0
    for path, data in FIXED:
        member = (F.lit(path), F.lit(zlib.crc32(data.encode())), F.lit(len(data)))
        opening += [Z.local_header(*member), F.lit(data.encode())]
        fixed.append(Z.entry(*member, F.lit(at).cast("long")))
        at += Z.LOCAL_BYTES + len(path) + len(data)
    nav_at = F.lit(at).cast("long")
    opf_at = nav_at + Z.local_size(F.lit(NAV_PATH), F.col("nav_bytes"))
    heads = heads.withColumns({"nav_at": nav_at, "opf_at": opf_at, "pages_at": opf_at + Z.local_size(F.lit(OPF_PATH), F.col("opf_bytes"))})
    heads = materialize(heads, "heads")

    # where a page starts needs the pages before it only
    spans = pages.select(*BOOK, "n", "crc", "size", Z.local_size(_page_path(n), F.col("size")).alias("span"))
    placed = running_total(spans, BOOK, "n", F.col("span"), "before").drop("span")
    far = materialize(
        placed.join(bounded_broadcast(heads.select(*BOOK, "pages_at")), BOOK).select(
            *BOOK, "n", "crc", "size", (F.col("pages_at") + F.col("before")).alias("at")
        ),
        "places",
    )
    path, at_ = _page_path(n), F.col("at")
    ends = far.groupBy(*BOOK).agg(
        F.sum(Z.entry_size(path, at_)).alias("entry_bytes"),
        F.max(at_ + Z.local_size(path, F.col("size"))).alias("directory_at"),
    )
    fixed += [
        Z.entry(F.lit(NAV_PATH), F.col("nav_crc"), F.col("nav_bytes"), F.col("nav_at")),
        Z.entry(F.lit(OPF_PATH), F.col("opf_crc"), F.col("opf_bytes"), F.col("opf_at")),
    ]
    directory = F.concat(*fixed)
    closed = heads.join(ends, BOOK)
    members = F.col("chapters") + len(fixed)
    count = F.col("chapters") + 1
    whole = [
        (OPENING, F.lit(0), F.concat(*opening)),
        (NAV, F.lit(0), F.concat(Z.local_header(F.lit(NAV_PATH), F.col("nav_crc"), F.col("nav_bytes")), F.lit(NAV_HEAD).cast("binary"))),
        (NAV, count, F.lit(NAV_TAIL).cast("binary")),
        (ITEMS, F.lit(0), F.concat(Z.local_header(F.lit(OPF_PATH), F.col("opf_crc"), F.col("opf_bytes")), F.col("opf_head").cast("binary"))),
        (REFS, F.lit(0), F.lit(BETWEEN).cast("binary")),
        (CLOSING, F.lit(0), F.lit(OPF_TAIL).cast("binary")),
        (DIRECTORY, F.lit(0), directory),
        (ENDING, F.lit(0), Z.ending(members, F.octet_length(directory) + F.col("entry_bytes"), F.col("directory_at"))),
    ]
    line = _lines(n, F.col("safe_title"))
    own = [
        (NAV, n + 1, line["link"].cast("binary")),
        (ITEMS, n + 1, line["item"].cast("binary")),
        (REFS, n + 1, line["ref"].cast("binary")),
        (PAGES, n, F.concat(Z.local_header(path, F.col("crc"), F.col("size")), page)),
    ]
    listed = [(DIRECTORY, n + 1, Z.entry(path, F.col("crc"), F.col("size"), at_))]
    return _pieces(closed, whole).unionByName(_pieces(pages, own)).unionByName(_pieces(far, listed))


def _pieces(rows: DataFrame, made: list[tuple[int, Column, Column]]) -> DataFrame:
    pieces = [
        F.struct((F.lit(section).cast("long") * (1 << SECTION_BITS) + place).alias("piece"), content.alias("content"))
        for section, place, content in made
    ]
    return rows.select(*BOOK, F.explode(F.array(*pieces)).alias("p")).select(*BOOK, "p.piece", "p.content")


def write_epubs(chapters: DataFrame, folder: str, volume_bytes: int | None = None) -> DataFrame:
    """Write each archive as one file below ``folder``: ``book_id, volume, path, bytes``.

    A task streams the pieces of its archives in order. A file gets its name when it is whole, so a
    repeated task replaces it with the same bytes.
    """

    def name_of(book: str | None, volume: int) -> str:
        book = "" if book is None else book
        return f"{quote(book, safe='')[:100]}-{hashlib.sha256(book.encode()).hexdigest()[:16]}-{volume}.epub"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        files.create_dir(root)
        part = f".part-{TaskContext.get().taskAttemptId()}"
        at, out, size = None, None, 0

        def closed() -> pa.RecordBatch:
            out.close()
            files.move(f"{root}/{part}", f"{root}/{name_of(*at)}")
            cols = [pa.array([v], t) for v, t in zip((*at, f"{folder}/{name_of(*at)}", size), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in WRITTEN.split(", ")])

        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            for book, volume, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (book, volume) != at:
                    if out:
                        yield closed()
                    at, out, size = (book, volume), files.open_output_stream(f"{root}/{part}"), 0
                data = content.as_buffer()
                out.write(data)
                size += len(data)
        if out:
            yield closed()

    pieces = epub_pieces(chapters, volume_bytes)
    dealt = pieces.repartition(*BOOK).sortWithinPartitions(*BOOK, "piece").select(*BOOK, "content")
    return materialize(dealt.mapInArrow(run, WRITTEN), "written")


def book_epub(chapters: DataFrame, volume_bytes: int | None = None) -> DataFrame:
    """``book_id, volume, epub``: archives as values, for books that a row can hold.

    ``epub_pieces`` and ``write_epubs`` have no such bound.
    """

    def joined(pieces: pd.DataFrame) -> pd.DataFrame:
        first = pieces.sort_values("piece")
        row = {"book_id": first["book_id"].iloc[0], "volume": first["volume"].iloc[0], "epub": b"".join(first["content"])}
        return pd.DataFrame([row], dtype=object)

    return epub_pieces(chapters, volume_bytes).groupBy(*BOOK).applyInPandas(joined, PACKED)
