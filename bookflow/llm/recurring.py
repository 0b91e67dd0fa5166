"""Which windows of a document occur earlier: the steps that byte and word windows share.

A window's anchor is its k-gram with the least hash, so equal windows have equal anchors at equal
places. Only anchors whose k-gram recurs are followed up, with the text around them: anchors with
equal surroundings are settled by a minimum per surroundings (a partial aggregation, whatever the
number of copies), those with unequal ones by comparing their windows within the k-gram's group. A
k-gram with very many unequal surroundings is settled window by window instead, by hash aggregation,
so that no group has to fit a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.llm.common import Batches, release, runs
from bookflow.session import materialize

BASE = 0xD6E8FEB86659FD93
#: Symbols that are worked on at once; bounds a worker's memory.
CHUNK = 1 << 20
#: Distinct surroundings of one k-gram that are compared in one task.
GROUP = 4096

CONTEXT = "key long, ctx long, doc long, start int, windows int, back int"
BODIES = "key long, doc long, start int, windows int, back int, n long, body binary, again boolean"
RANGES = "doc long, first int, last int"


#: Texts -> (their contents, the symbols of all, the number of each one's symbols).
Symbols = Callable[[list], tuple[list, np.ndarray, np.ndarray]]
#: (contents, start, number of symbols) -> that piece.
Piece = Callable[[object, int, int], bytes]


def chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Cut rows into ranges of at most CHUNK symbols, or of one row."""
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > CHUNK:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def grams(symbols: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k-gram; ``k`` is a power of two."""
    out, size = symbols, 1
    while size < k:
        out = out[:-size] * np.uint64(pow(BASE, size, 1 << 64)) + out[size:]
        size *= 2
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def anchors(symbols: np.ndarray, sizes: np.ndarray, window: int, k: int):
    """(row, place, key, first window, number of windows) of every anchor of some joined rows.

    Places and windows are counted from the start of the row. Ties of hashes go to the left.
    """
    none = np.zeros(0, np.int64)
    if len(symbols) < window:
        return none, none, none, none, none
    hashes = grams(symbols, k)
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    width, size = window - k + 1, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = len(symbols) - window + 1
    whole = np.flatnonzero(np.repeat(ends, sizes)[:n] - np.arange(n) >= window)
    at = (least[whole] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(at):
        return none, none, none, none, none
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1])])
    place, first = at[new], whole[new]
    row = np.searchsorted(ends, first, side="right")
    return row, place - starts[row], hashes[place].view(np.int64), first - starts[row], np.diff(np.r_[new, len(at)])



def _keys(docs: DataFrame, symbols: Symbols, window: int, k: int, placed: bool) -> DataFrame:
    """Anchor keys of (doc, text) rows: counted per chunk, or with their places."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_pylist()
            for s, e in chunks([len(t) for t in texts]):
                _, flat, sizes = symbols(texts[s:e])
                row, place, key, _, _ = anchors(flat, sizes, window, k)
                if placed:
                    cols = [pa.array(key), pa.array(ids[s:e][row].astype(np.int64)), pa.array(place.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, ["key", "doc", "place"])
                else:
                    key, n = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    return docs.mapInArrow(run, "key long, doc long, place int" if placed else "key long, n long")


def recurring_places(docs: DataFrame, symbols: Symbols, window: int, k: int) -> DataFrame:
    """(doc, places): the anchors of each document whose k-gram occurs more than once."""
    counts = _keys(docs, symbols, window, k, placed=False).groupBy("key").agg(F.sum("n").alias("n"))
    # a hot k-gram is on the side of the anchors, which AQE splits
    hits = _keys(docs, symbols, window, k, placed=True).join(counts.where("n > 1"), "key")
    places = materialize(hits.groupBy("doc").agg(F.collect_set("place").alias("places")), "places")
    release(docs.sparkSession)
    return places


def context_rows(doc, row, key, first, windows, back, raw: list, piece: Piece, window: int) -> pa.RecordBatch:
    """Rows of CONTEXT; ``back`` is how far the anchor lies behind the first window's start."""
    ctx = np.fromiter(
        (
            xxhash.xxh3_64_intdigest(piece(raw[r], f, n - 1 + window))
            for r, f, n in zip(row.tolist(), first.tolist(), windows.tolist(), strict=True)
        ),
        np.uint64,
        len(row),
    )
    cols = [pa.array(c, pa.int64()) for c in (key, ctx.view(np.int64), doc[row])]
    cols += [pa.array(c, pa.int32()) for c in (first, windows, back)]
    return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in CONTEXT.split(", ")])


def earlier_ranges(
    contexts: DataFrame,
    texts: DataFrame,
    window: int,
    symbols: Symbols,
    piece: Piece,
    compare: Callable[[pa.Table], pa.RecordBatch],
    cut: Callable[[bytes, int], list[bytes]],
    group: int = GROUP,
) -> DataFrame:
    """(doc, ranges): the runs of windows of each document of ``texts`` that occur earlier.

    ``contexts`` names the surroundings by hashes; only unlike ones are read from the texts once more.
    ``compare`` gets the surroundings of whole k-gram groups, sorted by key, doc and start, and
    gives RANGES; ``cut`` gives the contents of all windows of one body. Rows that repeat a document
    give its bodies once each, of which one is compared.
    """
    spark, own = contexts.sparkSession, F.struct("doc", "start")
    firsts = contexts.groupBy("key", "ctx").agg(F.min(F.struct("doc", "start", "windows", "back")).alias("f"))
    firsts = materialize(firsts, "firsts").select("key", "ctx", "f.*")
    release(spark)
    copies = (
        contexts.join(firsts.select("key", "ctx", own.alias("least")), ["key", "ctx"])
        .where(own != F.col("least"))
        .select("doc", F.col("start").alias("first"), (F.col("start") + F.col("windows") - 1).alias("last"))
    )
    kinds = firsts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    repeated = texts.groupBy("doc").agg(F.count("*").alias("rows")).where("rows > 1")
    unlike = firsts.join(kinds, "key").groupBy("doc").agg(
        F.collect_list(F.struct("key", "start", "windows", "back", "n")).alias("marks")
    )
    unlike = unlike.join(repeated.select("doc", F.lit(True).alias("again")), "doc", "left")

    def read(batches: Batches) -> Batches:
        for batch in batches:
            doc, text, marks, again = (batch.column(i) for i in range(4))
            again = again.to_numpy(zero_copy_only=False)
            for s, e in chunks([len(t) for t in text.to_pylist()]):
                raw = symbols(text.slice(s, e - s).to_pylist())[0]
                part = marks.slice(s, e - s)
                row = np.repeat(np.arange(e - s), pc.list_value_length(part).to_numpy())
                flat = part.flatten()
                key, start, windows, back, n = (flat.field(c) for c in ("key", "start", "windows", "back", "n"))
                bodies = [
                    piece(raw[r], f, c - 1 + window)
                    for r, f, c in zip(row.tolist(), start.to_pylist(), windows.to_pylist(), strict=True)
                ]
                cols = [key, pa.array(doc.to_numpy()[s:e][row]), start, windows, back, n, pa.array(bodies, pa.binary())]
                cols.append(pa.array(again[s:e][row]))
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in BODIES.split(", ")])

    marked = texts.join(unlike, "doc").select("doc", "text", "marks", F.coalesce("again", F.lit(False)).alias("again"))
    bodies = materialize(marked.mapInArrow(read, BODIES), "bodies")
    release(spark)
    single = bodies.where("again").groupBy("key", "doc", "start").agg(
        *[F.first(c).alias(c) for c in ("windows", "back", "n", "body")]
    )
    bodies = bodies.where("not again").drop("again").unionByName(single)

    def run(batches: Batches) -> Batches:
        for table in runs(batches, "key"):
            yield compare(table)

    small = bodies.where(F.col("n") <= group).drop("n")
    sorted_small = small.repartition("key").sortWithinPartitions("key", "doc", "start")
    near = sorted_small.mapInArrow(run, RANGES)

    def explode(batches: Batches) -> Batches:
        for batch in batches:
            for r in batch.to_pylist():
                parts = cut(r["body"], window)
                at = range(r["start"], r["start"] + len(parts))
                cols = [
                    pa.array([xxhash.xxh3_128_digest(p) for p in parts], pa.binary()),
                    pa.array([r["doc"]] * len(parts), pa.int64()),
                    pa.array(list(at), pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["h", "doc", "start"])

    large = bodies.where(F.col("n") > group).select("doc", "start", "body").mapInArrow(explode, "h binary, doc long, start int")
    earliest = large.groupBy("h").agg(F.min(own).alias("least"))
    later = large.join(earliest, "h").where(own != F.col("least"))
    hot = later.select("doc", F.col("start").alias("first"), F.col("start").alias("last"))
    found = copies.unionByName(near).unionByName(hot)
    ranges = materialize(found.groupBy("doc").agg(F.collect_set(F.struct("first", "last")).alias("ranges")), "ranges")
    release(spark)
    return ranges


def covered(size: int, ranges: list[dict] | None, window: int) -> np.ndarray:
    """Which of ``size`` symbols a window that starts in one of the ranges covers."""
    edge = np.zeros(size + 1, np.int32)
    for r in ranges or ():
        edge[r["first"]] += 1
        edge[r["last"] + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
