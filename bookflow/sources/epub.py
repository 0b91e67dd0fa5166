"""EPUB archives: members, spine order, chapters."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.functions.arrays import let
from bookflow.functions.html import extract_attrs, html_body, html_title, resolve_path, strip_tags
from bookflow.functions.text import non_empty
from bookflow.operators.ordering import ordinal
from bookflow.schemas import MEMBERS
from bookflow.session import materialize, scratch_dir
from bookflow.sources.stores import is_opened, store
from bookflow.sources.text_files import decoded

CONTAINER = "META-INF/container.xml"

# Reasons a book is rejected with.
NO_ARCHIVE = "Invalid EPUB: not a readable archive"
NO_CONTAINER = "Invalid EPUB: missing META-INF/container.xml"
NO_OPF_PATH = "Invalid EPUB: missing OPF path"
NO_OPF = "Invalid EPUB: missing OPF file "
NO_CHAPTERS = "Invalid EPUB: no readable XHTML chapters"


# Members that one task reads, by their packed bytes, and bytes of a batch of contents.
TASK_BYTES, BATCH_BYTES = 64 * 1024 * 1024, 8 * 1024 * 1024
# Members this near to each other in an archive are read by one task.
NEAR_BITS = 25
LISTING = (
    "book_id string, name string, path string, member_path string, at long, packed long, method int, crc long, reject string"
)
READ = "book_id string, member_path string, bytes binary, problem string"


def _batches(rows: Iterator[dict], ddl: str, size_of) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about BATCH_BYTES, however large the rows are."""
    kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += size_of(row) + 200
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for batch in batches:
            for book_id, name, content in zip(*(batch.column(i) for i in range(3)), strict=True):
                head = {"book_id": book_id.as_py(), "name": name.as_py()}
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py() or b"")) as archive:
                        # a repeated member name counts once, with its last content
                        for path, info in {i.filename: i for i in archive.infolist()}.items():
                            yield {**head, "member_path": path, "bytes": archive.read(info)}
                except Exception as error:  # noqa: BLE001 - a bad archive is a row, not a failed task
                    yield {**head, "reject": f"{NO_ARCHIVE}: {error}"}

    return _batches(rows(), MEMBERS, lambda r: len(r.get("bytes") or b""))


def epub_members(files: DataFrame) -> DataFrame:
    """``files(book_id, name, content)`` -> one row per archive member, or a reject row.

    For archives that came as values; ``epub_listing`` and ``read_listed`` read files member by member.
    """
    return files.select("book_id", "name", "content").mapInArrow(_unpack, MEMBERS)


def epub_listing(files: DataFrame) -> DataFrame:
    """``files(book_id, name, path)`` -> where each member is, or a reject row.

    A task reads the directory at an archive's end, none of its members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for book_id, name, path in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    head = {"book_id": book_id, "name": name, "path": path}
                    try:
                        files_, place = store(path)
                        with files_.open_input_file(place) as file, zipfile.ZipFile(file) as archive:
                            for member, i in {i.filename: i for i in archive.infolist()}.items():
                                if i.flag_bits & 1:
                                    raise zipfile.BadZipFile(f"{member} is encrypted")
                                at = {"at": i.header_offset, "packed": i.compress_size, "method": i.compress_type}
                                yield {**head, "member_path": member, **at, "crc": i.CRC}
                    except Exception as error:  # noqa: BLE001
                        yield {**head, "reject": f"{NO_ARCHIVE}: {error}"}

        return _batches(rows(), LISTING, lambda r: 100)

    return files.select("book_id", "name", "path").mapInArrow(run, LISTING)


def _member(file, at: int, packed: int, method: int, crc: int) -> bytes:
    """The content of the member whose record starts at ``at``."""
    file.seek(at)
    head = file.read(30)
    name, extra = struct.unpack("<HH", head[26:30])
    file.seek(at + 30 + name + extra)
    data = file.read(packed)
    if method == zipfile.ZIP_DEFLATED:
        data = zlib.decompress(data, -15)
    elif method != zipfile.ZIP_STORED:
        raise zipfile.BadZipFile(f"packing method {method}")
    if zlib.crc32(data) != crc:
        raise zipfile.BadZipFile("bad checksum")
    return data


def read_listed(listed: DataFrame) -> DataFrame:
    """READ: the contents of some rows of a listing, or the ``problem`` that one has.

    Members are dealt over tasks by their place, so an archive of any size is read by many, and only
    what is asked for is read.
    """
    rows = materialize(listed.select("book_id", "path", "member_path", "at", "packed", "method", "crc"), "listed")
    total = rows.agg(F.sum("packed")).first()[0] or 0
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            open_path, file = None, None
            for batch in batches:
                for r in batch.to_pylist():
                    row = {"book_id": r["book_id"], "member_path": r["member_path"]}
                    try:
                        if r["path"] != open_path:
                            files_, place = store(r["path"])
                            open_path, file = r["path"], files_.open_input_file(place)
                        yield {**row, "bytes": _member(file, r["at"], r["packed"], r["method"], r["crc"])}
                    except Exception as error:  # noqa: BLE001
                        yield {**row, "problem": f"{NO_ARCHIVE}: {r['member_path']}: {error}"}

        return _batches(found(), READ, lambda r: len(r.get("bytes") or b""))

    dealt = rows.repartition(tasks, "book_id", F.shiftright("at", NEAR_BITS)).sortWithinPartitions("path", "at")
    return dealt.mapInArrow(run, READ)


@dataclass(frozen=True)
class Archives:
    """Archives of which only the members that are asked for are read."""

    listing: DataFrame  # LISTING: one row for each member or rejected archive
    inline: DataFrame  # MEMBERS: contents of archives that came as values

    def read(self, wanted: DataFrame) -> DataFrame:
        """READ of the wanted ``book_id, member_path`` that there are; ``wanted`` has each once."""
        keys = ["book_id", "member_path"]
        stored = read_listed(self.listing.where("at is not null").join(wanted.select(*keys), keys))
        none = F.lit(None).cast("string").alias("problem")
        return stored.unionByName(self.inline.join(wanted.select(*keys), keys).select(*keys, "bytes", none))


def open_archives(files: DataFrame, root: str | None = None) -> Archives:
    """``files(book_id, name, content, path)``: a row with a ``path`` that tasks can open is read by
    member from there, else its ``content`` is unpacked and written once, below ``root``."""
    root = root or scratch_dir(files.sparkSession)
    opened = F.col("path").isNotNull() & is_opened(F.col("path"))
    inline = materialize(epub_members(files.where(~opened | F.col("path").isNull())), "members", root)
    # without its content, so that the scan of the files does not read it
    listing = epub_listing(files.where(opened).select("book_id", "name", "path"))
    unpacked = inline.select("book_id", "name", "member_path", "reject")
    return Archives(materialize(listing.unionByName(unpacked, allowMissingColumns=True), "listing", root), inline)


def read_epub_members(files: DataFrame) -> DataFrame:
    """``book_id, member_path, bytes`` of every member of the archives that can be read."""
    archives = open_archives(files)
    every = archives.listing.where(F.col("reject").isNull()).select("book_id", "member_path")
    return archives.read(every).where("problem is null").select("book_id", "member_path", "bytes")


def _utf8(c: Column) -> Column:
    return F.make_valid_utf8(c.cast("string"))


def package_files(archives: Archives, root: str | None = None) -> DataFrame:
    """``book_id, opf_path, opf, files, reason`` per archive; ``reason`` says why it is invalid.

    The container is read for the path of the package file, then that file; nothing else is.
    """
    root = root or scratch_dir(archives.listing.sparkSession)
    heads = archives.listing.groupBy("book_id").agg(
        F.count("member_path").cast("int").alias("files"), F.max("reject").alias("reject")
    )
    containers = archives.read(archives.listing.where(F.col("member_path") == CONTAINER)).select(
        "book_id", _utf8(F.col("bytes")).alias("container"), "problem"
    )
    path = F.regexp_extract("container", r"(?i)<rootfile\b[^>]*full-path=([\"'])(.*?)\1", 2)
    placed = heads.join(containers, "book_id", "left").withColumn(
        "opf_path", non_empty(F.replace(path, F.lit("\\"), F.lit("/")))
    )
    placed = materialize(placed, "placed", root)
    wanted = placed.where(F.col("opf_path").isNotNull()).select("book_id", F.col("opf_path").alias("member_path"))
    opf = archives.read(wanted).select("book_id", _utf8(F.col("bytes")).alias("opf"), F.col("problem").alias("opf_problem"))
    broken = F.coalesce("reject", "problem", "opf_problem")
    reason = (
        F.when(broken.isNotNull(), broken)
        .when(F.col("container").isNull(), NO_CONTAINER)
        .when(F.col("opf_path").isNull(), NO_OPF_PATH)
        .when(F.col("opf").isNull(), F.concat(F.lit(NO_OPF), "opf_path"))
    )
    found = placed.join(opf, "book_id", "left").select("book_id", "opf_path", "opf", "files", reason.alias("reason"))
    # few rows, but each a whole package file
    return materialize(found.repartition("book_id"), "packages", root)


def package_title(opf: Column) -> Column:
    raw = F.regexp_extract(opf, r"(?is)<dc:title[^>]*>(.*?)</dc:title>", 1)
    return F.coalesce(non_empty(strip_tags(raw)), F.lit("Untitled Novel"))


def _tags(opf: Column, name: str) -> Column:
    return F.regexp_extract_all(opf, F.lit(rf"(?is)<{name}\b([^>]*?)/?>"), F.lit(1))


def _parsed(tags: DataFrame, attrs: dict[str, str], kept: Callable[[Column], Column]) -> DataFrame:
    """Replace ``raw`` by some attributes, by the names they get, of the tags that are kept.

    A package is one value and few files hold all of them, so the tags are dealt first.
    """
    found = let(extract_attrs(F.col("raw")), lambda a: F.struct(*[a[name].alias(as_) for as_, name in attrs.items()]))
    # tags are dropped inside the row: a filter would be pushed down and parse them again
    one = F.explode(F.filter(F.array(found), kept)).alias("t")
    rest = [c for c in tags.columns if c != "raw"]
    return tags.repartition("book_id", "n").select(*rest, one).select(*rest, *[f"t.{c}" for c in attrs])


def epub_spine(packages: DataFrame) -> DataFrame:
    """``book_id, pos, href``: readable pages in spine order, else in manifest order.

    Manifest and spine meet in an equi join. ``pos`` counts the pages before any of them turns
    out to be missing from the archive. The tags of a package are dealt over the tasks before their
    attributes are parsed.
    """
    opf_dir = F.regexp_extract("opf_path", "(?s)^(.*/)", 1)
    items = _parsed(
        packages.select(
            "book_id", opf_dir.alias("dir"), F.posexplode(_tags(F.col("opf"), "item")).alias("n", "raw")
        ),
        {"id": "id", "href": "href", "media": "media-type"},
        lambda t: (F.coalesce(t["id"], F.lit("")) != "") & (F.coalesce(t["href"], F.lit("")) != ""),
    )
    manifest = (
        items.groupBy("book_id", "id")
        .agg(
            F.min("n").alias("first_n"),
            F.max(F.struct("n", "dir", "href", "media")).alias("last"),
        )
        .filter(F.rlike(F.coalesce("last.media", F.lit("")), F.lit("(?i)x?html")))
        .select(
            "book_id", "id", "first_n", resolve_path(F.col("last.dir"), F.col("last.href")).alias("href")
        )
    )
    refs = _parsed(
        packages.select("book_id", F.posexplode(_tags(F.col("opf"), "itemref")).alias("n", "raw")),
        {"id": "idref"},
        lambda t: t["id"] != "",
    )
    in_spine = refs.join(manifest, ["book_id", "id"]).select("book_id", F.col("n").alias("at"), "href")
    fallback = manifest.join(in_spine.select("book_id").distinct(), "book_id", "left_anti").select(
        "book_id", F.col("first_n").alias("at"), "href"
    )
    both = materialize(in_spine.unionByName(fallback), "spine")
    return ordinal(both, ["book_id"], "at", "pos").select("book_id", F.col("pos").cast("int").alias("pos"), "href")


def epub_chapters(archives: Archives, spine: DataFrame) -> DataFrame:
    """``book_id, chapter_index, title, text, source_path, problem`` of pages with readable text.

    Only pages of the spine are read. A row with a ``problem`` stands for a page that cannot be.
    """
    wanted = spine.select("book_id", F.col("href").alias("member_path")).distinct()
    read = archives.read(wanted).withColumnRenamed("member_path", "href")
    opened = spine.join(read, ["book_id", "href"]).select(
        "book_id", "pos", "href", decoded(F.col("bytes"))["text"].alias("html"), "problem"
    )
    numbered = F.concat(F.lit("Chapter "), (F.col("pos") + 1).cast("string"))
    page = F.struct(
        html_title(F.col("html"), numbered).alias("title"), html_body(F.col("html")).alias("text"), F.col("problem")
    )
    # blank pages are dropped inside the row: a filter would be pushed down and parse them twice
    readable = F.explode(F.filter(F.array(page), lambda p: (p["text"] != "") | p["problem"].isNotNull()))
    parsed = opened.select("book_id", "pos", F.col("href").alias("source_path"), readable.alias("p")).select(
        "book_id", "pos", "p.title", "p.text", "source_path", "p.problem"
    )
    numbered_pages = ordinal(materialize(parsed, "pages"), ["book_id"], "pos", "chapter_index")
    return numbered_pages.select(
        "book_id", F.col("chapter_index").cast("int").alias("chapter_index"), "title", "text", "source_path", "problem"
    )
