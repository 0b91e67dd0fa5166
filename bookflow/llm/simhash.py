"""SimHash near-duplicates: fingerprints, links by BK-trees, components.

Distinct fingerprints, not documents, are linked. They are cut into blocks so that two within the
radius agree on two whole blocks (pigeonhole); each pair of blocks and its value is one shard, whose
BK-tree is built and searched where the shard's rows meet. A shard with many fingerprints is dealt
into chunks and every pair of chunks is searched, so no task holds more than two chunks. A shard
gives a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.llm.common import Batches, map_rows, runs
from bookflow.llm.components import components
from bookflow.session import materialize

WORDS = 4
RADIUS = 4
SEED = 42
#: Two fingerprints with up to RADIUS differing bits agree on at least BLOCKS - RADIUS blocks.
BLOCKS = 6
#: Fingerprints of one shard that one tree holds.
CHUNK = 2048
#: Bits of a shard's number that name a chunk; beyond so many chunks they hold more.
LOT_BITS = 14


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint as a signed integer; 0 without words."""
    line = b" ".join((text or "").encode().lower().split())
    if not line:
        return 0
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    if len(spaces) < words:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        starts = np.r_[0, spaces[: len(spaces) - words + 1] + 1].tolist()
        ends = np.r_[spaces[words - 1 :], len(line)].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[s:e], SEED) for s, e in zip(starts, ends, strict=True)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    on = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(on, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp) per row. A null text has no words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = pa.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col)), "doc_id long, fp long", run)


class BKTree:
    """Children of a node are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while at != new:
            gap = (self.values[at] ^ value).bit_count()
            at = self.children[at].setdefault(gap, new)

    def near(self, value: int, radius: int) -> list[int]:
        """Values within ``radius``; only edges that may lead to one are followed."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            gap = (self.values[at] ^ value).bit_count()
            if gap <= radius:
                found.append(self.values[at])
            kids = self.children[at]
            if len(kids) <= 2 * radius:
                todo += [c for d, c in kids.items() if abs(d - gap) <= radius]
            else:
                todo += [kids[d] for d in range(gap - radius, gap + radius + 1) if d in kids]
        return found


class Forest:
    """Union-find whose root is the smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != x:
            up[x], x = top, y
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))


def _shard_links(fps: list[int], half: list[int], pair: bool, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links inside a shard, or between its two halves."""
    mask, tree, forest = (1 << 64) - 1, BKTree(), Forest()
    for fp, h in zip(fps, half, strict=True):
        if not pair or h == 0:
            tree.add(fp & mask) if pair else _grow(tree, forest, fp & mask, radius)
    if pair:
        for fp, h in zip(fps, half, strict=True):
            if h:
                for other in tree.near(fp & mask, radius):
                    forest.join(fp & mask, other)
    return [(x, r) for x in list(forest.up) if (r := forest.root(x)) != x]


def _grow(tree: BKTree, forest: Forest, value: int, radius: int) -> None:
    for other in tree.near(value, radius):
        forest.join(value, other)
    tree.add(value)


def block_keys(fp: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> Column:
    """Array of shard keys: every choice of ``blocks - radius`` blocks with their bits."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [
        F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))
        for a, b in zip(cuts, cuts[1:], strict=False)
    ]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(n).cast("long")
        for i in chosen:
            key = F.shiftleft(key, cuts[i + 1] - cuts[i]).bitwiseOR(parts[i])
        keys.append(key)
    return F.array(*keys)


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """(a, b) links that connect all distinct fingerprints ``fp`` within ``radius`` of each other.

    ``blocks - radius`` blocks may have some 30 bits together, beside the numbers of two chunks.
    """
    dealt = fps.select("fp", F.explode(block_keys(F.col("fp"), radius, blocks)).alias("key"))
    full = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    lot = F.pmod(F.xxhash64("fp"), "chunks").cast("long")
    chunks = F.least(F.ceil(F.col("n") / chunk), F.lit((1 << LOT_BITS) - 1))
    chunked = dealt.join(full, "key").withColumn("chunks", chunks).withColumn("lot", lot)
    # lot i meets lot j in the pair (i, j); inside a single lot the pair is (i, i)
    paired = chunked.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    shards = paired.select(
        F.shiftleft(F.shiftleft("key", LOT_BITS).bitwiseOR(F.least("lot", "other")), LOT_BITS)
        .bitwiseOR(F.greatest("lot", "other"))
        .alias("shard"),
        (F.col("lot") > F.col("other")).cast("int").alias("half"),
        (F.col("lot") != F.col("other")).alias("pair"),
        "fp",
    )

    def run(batches: Batches) -> Batches:
        for table in runs(batches, "shard"):
            ids = table.column("shard").to_numpy()
            at = np.r_[0, np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids)].tolist()
            fp, half, pair = (table.column(c).to_pylist() for c in ("fp", "half", "pair"))
            out = []
            for s, e in zip(at, at[1:], strict=False):
                if e - s > 1:
                    out += _shard_links(fp[s:e], half[s:e], pair[s], radius)
            both = np.array(out, np.uint64).reshape(-1, 2).astype("<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    sorted_shards = shards.repartition("shard").sortWithinPartitions("shard", "half", "fp")
    return sorted_shards.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    radius: int = RADIUS,
    words: int = WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
) -> DataFrame:
    """(doc_id, fingerprint, component_id, linked) for every row of ``docs``.

    ``fingerprint`` is 16 hex digits; ``component_id`` the smallest doc_id reachable over links of at
    most ``radius`` differing bits, the document's own included; ``linked`` says whether another row
    shares it. Documents without words (null, empty, white space) have fingerprint zero, which links
    like any other. Repeated rows stay; a null doc_id is never a component's id unless all are null.
    Columns other than the two named are left out. No rows: no rows.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    distinct = materialize(distinct, "distinct")
    roots = components(links(distinct.select("fp"), radius, chunk=chunk))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", "n", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("members"))
    classes = rooted.join(least, "root").select("fp", "component_id", (F.col("members") > 1).alias("linked"))
    # a hot fingerprint is on the side of the documents, which AQE splits
    return prints.join(classes, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        "linked",
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, whose id is doc_id, but for near-duplicates: of each component the smallest doc_id stays.

    Rows that repeat that doc_id are reduced to one; of rows without an id, all stay (nothing says
    which document they are). All columns are kept.
    """
    found = near_duplicates(docs, **options)
    drop = found.where("doc_id is not null and component_id <> doc_id").select("doc_id")
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    drop, repeated = materialize(drop.distinct(), "drop"), materialize(repeated, "repeated")
    kept = docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once).select(*docs.columns)
