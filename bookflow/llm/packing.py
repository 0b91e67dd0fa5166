"""Best-fit packing: a length histogram is planned, documents then take the planned slots.

The driver sees one count per length (at most ``size`` of them), never a document. The plan says
"ranks a..a+n of length L sit at offset o of sequences s..s+n", and a piece finds its slot by its
rank among the pieces of its length.
"""

from __future__ import annotations

import re
import zlib
from codecs import charmap_decode
from struct import pack as packed
from unicodedata import is_normalized

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookflow.llm.common import ROWS, Batches, memos, only_memo
from bookflow.session import materialize

SIZE = 2048
#: Pieces of one length that share a task while ranks are given out, on average at most.
BUCKET_ROWS = 1 << 16
#: Word forms that a worker remembers, some 80 MB.
MEMO_WORDS = 400_000
#: Bytes of ids that a worker holds before it hands them on, beside those of one document.
HELD_BYTES = 1 << 22
#: The tokenizer's pattern, for ASCII in lower case.
ASCII_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: ASCII that is neither letter nor digit nor white space, and starts no special token.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != ord("<"))
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
#: Bytes as the tokenizer's model spells them: those without a glyph are moved up from 256 on.
BYTE_LEVEL = "".join(chr(b if b in _SHOWN else 256 + _HIDDEN.index(b)) for b in range(256))
#: Letters that the tokenizer does nothing to but to lower their case, up to Cyrillic, where these no
#: longer change. The lower case of a capital sigma depends on its place in Python but not in the tokenizer.
LETTERS = re.compile(
    "[%s]+"
    % "".join(
        c
        for c in map(chr, range(0x530))
        if c.isalpha() and c.lower().isalpha() and c != "\u03a3" and is_normalized("NFC", c)
    )
)

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Words(dict):
    """White-space separated chunks and their ids as little-endian bytes.

    The tokenizer never joins characters across white space, so ids of a text are those of its
    chunks in order. A chunk is cut on where the tokenizer's own pattern cuts it, so that its parts are
    remembered once for all chunks that hold them. What the model can take as it stands goes to it without
    the tokenizer's other steps, which cost more than the model.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = self.tokenizer.model.tokenize

    @staticmethod
    def of(path: str) -> _Words:
        """One memo per worker process, which outlives its tasks."""
        words = memos().get("packing")
        if words is None or words.path != path:
            words = _Words(path)
        only_memo("packing", words)
        return words

    def __missing__(self, word: bytes) -> bytes:
        ids = self._model(word) if word.isalpha() and word.islower() else self._parts(word)
        if len(self) < MEMO_WORDS:
            self[word] = ids
        return ids

    def _model(self, part: bytes) -> bytes:
        ids = [token.id for token in self.pieces(charmap_decode(part, "strict", BYTE_LEVEL)[0])]
        return packed(f"<{len(ids)}I", *ids)

    def _parts(self, word: bytes) -> bytes:
        if word.isascii() and b"<" not in word:  # which may start a special token
            if word.isalpha():
                return self[word.lower()]
            parts = ASCII_PARTS.findall(word.lower())
            return self._model(word.lower()) if len(parts) == 1 else b"".join(map(self.__getitem__, parts))
        stem = word.rstrip(MARKS)
        if found := LETTERS.fullmatch(stem.decode()):
            ids = self._model(found[0].lower().encode())
            return ids if len(stem) == len(word) else ids + self[word[len(stem) :]]
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()


def tokenize(
    docs: DataFrame,
    tokenizer: str | None = None,
    size: int = SIZE,
    end_id: int = 0,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A null or empty text is the end id alone. Only documents longer than ``size`` are cut.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    end = int(end_id).to_bytes(4, "little")
    step = 4 * size

    def batch_of(out: list[list]) -> pa.RecordBatch:
        cols = [
            pa.array(out[0], pa.int64()),
            pa.array(out[1], pa.int32()),
            *[pa.array(c, pa.int64()) for c in out[2:5]],
        ]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            ids = pa.Array.from_buffers(pa.int32(), sum(out[3]), [None, pa.py_buffer(b"".join(out[5]))])
            ends = pa.array(np.cumsum([0, *out[3]]), pa.int32())
            cols, names = [*cols, pa.ListArray.from_arrays(ends, ids)], [*names, "ids"]
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Batches) -> Batches:
        words = _Words.of(path)
        for rows in (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS)):
            out: list[list] = [[], [], [], [], [], []]
            held = 0
            for doc, text in zip(rows.column(0), rows.column(1), strict=True):
                ids = b"".join(map(words.__getitem__, (text.as_py() or "").encode().split())) + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    row = (doc.as_py(), piece, at // 4, len(part) // 4, zlib.crc32(part))
                    for col, v in zip(out, row, strict=False):
                        col.append(v)
                    if with_ids:
                        out[5].append(part)
                        held += len(part)
                        if held >= HELD_BYTES:
                            yield batch_of(out)
                            out, held = [[], [], [], [], [], []], 0
            if out[0]:
                yield batch_of(out)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, pieces, first sequence, offset) entries.

    Sequences with equal free space are handled as one run, so the work depends on the number of
    lengths, not on the number of documents.
    """
    free: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
    entries, opened = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left, space = 0, histogram[length], length
        while left:
            while space <= size and not free[space]:
                space += 1
            if space > size:
                fit = size // length
                full, rest = divmod(left, fit)
                for n, copies, first in ((full, fit, opened), (1, rest, opened + full)):
                    if n and copies:
                        for j in range(copies):
                            entries.append((length, rank, n, first, j * length))
                            rank += n
                        free[size - copies * length].append((first, n))
                opened += full + (rest > 0)
                break
            first, n = free[space].pop()
            used = min(n, left)
            if used < n:
                free[space].append((first + used, n - used))
            entries.append((length, rank, used, first, size - space))
            free[space - length].append((first, used))
            rank, left = rank + used, left - used
            if space - length >= length:  # what is left there now fits best
                space -= length
    return entries


def ranked(pieces: DataFrame, rows: int) -> DataFrame:
    """Add ``rank``: the 0-based position of a piece among those of its length.

    A common length is dealt over buckets; bucket counts give the offsets.
    """
    n = max(1, -(-rows // BUCKET_ROWS))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("length", "bucket")
        .agg(F.count("*").alias("n"))
        .select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    within = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return (
        dealt.withColumn("at", F.row_number().over(within) - 1)
        .join(offsets, ["length", "bucket"])
        .withColumn("rank", F.col("base") + F.col("at"))
        .drop("bucket", "base", "at")
    )


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    size: int = SIZE,
    end_id: int = 0,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack all documents into few sequences of at most ``size`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset. Null texts count
    as empty, repeated rows are packed each for itself, ties in length go by doc_id, an empty table
    gives no rows; other columns of ``docs`` are left out. The plan is broadcast: it has a few
    entries per length, whatever the number of documents. Ids are not ranked along: they join their
    slots once these are known.
    """
    spark = docs.sparkSession
    tokens = tokenize(docs, tokenizer, size, end_id, with_ids, id_col, text_col)
    names = tokens.columns
    if with_ids:  # documents may repeat or have no id: written pieces are numbered
        tokens = tokens.withColumn("number", F.monotonically_increasing_id())
    written = materialize(tokens, "pieces")
    pieces = written.drop("ids")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.createDataFrame(
        plan(counts, size), "length long, first long, n long, sequence long, offset long"
    ).select(F.col("length").alias("slot_length"), "first", "n", "sequence", "offset")
    placed = ranked(pieces, sum(counts.values())).join(
        F.broadcast(slots),
        (F.col("length") == F.col("slot_length"))
        & (F.col("rank") >= F.col("first"))
        & (F.col("rank") < F.col("first") + F.col("n")),
    )
    placed = placed.withColumn("sequence_id", F.col("sequence") + F.col("rank") - F.col("first"))
    if with_ids:
        placed = placed.join(written.select("number", "ids"), "number")
    return placed.select(*names, "sequence_id", "offset")
