"""Text books: binary files with an unknown charset."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.functions.html import base_name, ext_name

# Charsets in order of preference with the codec that stands for each; on equal
# scores the earlier one wins. latin1 means windows-1252.
CHARSETS = (
    ("utf-8", "utf-8"),
    ("utf-16le", "utf-16-le"),
    ("shift_jis", "cp932"),
    ("euc-jp", "euc_jp"),
    ("gb18030", "gb18030"),
    ("big5", "big5hkscs"),
    ("latin1", "latin-1"),
)
BOMS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"))
_CODECS = dict(CHARSETS)
# The characters that a score counts, and what each of them adds (in ``_score``).
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
_CJK = re.compile("[぀-ヿ㐀-鿿]")
# windows-1252 differs from latin-1 in 0x80-0x9F; its five unused bytes stay C1 controls
_WINDOWS = {
    b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)
}

# Characters of a batch of texts that leaves a Python worker.
BATCH_BYTES = 8 * 1024 * 1024
DECODED = "encoding string, score double, text string"


def _decoded(data: bytes, label: str) -> str:
    text = data.decode(_CODECS[label], errors="replace")
    if label == "latin1":
        return text.translate(_WINDOWS)
    return text[1:] if label.startswith("utf") and text.startswith("﻿") else text


def _score(text: str) -> float:
    cjk = min(len(_CJK.findall(text)), 200)
    return text.count("�") * 1000 + len(_CONTROL.findall(text)) * 60 - cjk * 0.5


def detect(data: bytes) -> tuple[str, float, str]:
    """``(charset, score, text)`` of the best reading of ``data``.

    A byte order mark decides, then well-formed UTF-8 without NUL; only other bytes are scored.
    """
    for mark, label in BOMS:
        if data.startswith(mark):
            text = _decoded(data, label)
            return label, _score(text), text
    if data.isascii():
        text = data.decode("ascii")
        if not _CONTROL.search(text):
            # every ASCII-based reading is the same and clean: the first one wins
            return "utf-8", 0.0, text
    if not data.count(0):
        try:  # several bytes that are well-formed UTF-8 are not so by chance
            text = data.decode("utf-8")
            return "utf-8", _score(text), text
        except UnicodeDecodeError:
            pass
    wide_penalty = 10000 if data.count(0) < 0.05 * len(data) or not data else 0

    def rated(label: str) -> tuple[float, str, str]:
        text = _decoded(data, label)
        return _score(text) + (wide_penalty if label == "utf-16le" else 0), label, text

    best = min((rated(label) for label, _ in CHARSETS), key=lambda r: r[0])
    return best[1], best[0], best[2]


def decode_udf() -> Callable[[Column], Column]:
    """Arrow UDF ``binary -> struct<encoding, score, text>``: the JVM's decoder knows no legacy
    charsets and fails on malformed input. One value at a time is decoded, and texts leave in batches
    of about BATCH_BYTES."""

    def batch(rows: list[tuple[str, float, str]]) -> pa.Array:
        kinds = (pa.string(), pa.float64(), pa.string())
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        return pa.StructArray.from_arrays(columns, ["encoding", "score", "text"])

    @F.arrow_udf(DECODED)
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for contents in batches:
            rows, size = [], 0
            for content in contents:
                rows.append(detect(content.as_py() or b""))
                size += len(rows[-1][2])
                if size > BATCH_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)

    return decode


def decoded(content: Column) -> dict[str, Column]:
    """``encoding, score, text`` of bytes, as ``detect`` reads them.

    Well-formed UTF-8 without a mark and without NUL is read where it is; only other bytes go to Python.
    """
    text = content.cast("string")
    marked = F.startswith(content, F.lit(bytearray(BOMS[0][0])))
    clean = F.coalesce(~marked & ~F.contains(content, F.lit(bytearray(1))) & F.is_valid_utf8(text), F.lit(False))

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    cjk = F.least(count(_CJK.pattern), F.lit(200))
    score = count("\ufffd") * 1000 + count(_CONTROL.pattern) * 60 - cjk * F.lit(0.5)
    other = decode_udf()(F.when(~clean, content))
    return {
        "encoding": F.when(clean, "utf-8").otherwise(other["encoding"]),
        "score": F.when(clean, score.cast("double")).otherwise(other["score"]),
        "text": F.when(clean, text).otherwise(other["text"]),
    }


def decode_books(files: DataFrame) -> DataFrame:
    """``files(book_id, name, content)`` -> ``book_id, name, encoding, score, text``."""
    return files.select("book_id", "name", *[c.alias(n) for n, c in decoded(F.col("content")).items()])


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """``book_id, name, ext, content, path`` of every file below ``path``; the path is the id."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    )
    return name_files(files)


def name_files(files: DataFrame) -> DataFrame:
    named = files.select(F.col("path").alias("book_id"), base_name(F.col("path")).alias("name"), "content", "path")
    return named.select("book_id", "name", ext_name(F.col("name")).alias("ext"), "content", "path")


def read_text_books(spark: SparkSession, path: str) -> DataFrame:
    files = scan_files(spark, path)
    return decode_books(files.filter(F.col("ext").isin(".txt", "")))
