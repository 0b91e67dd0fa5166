"""Nearest neighbours by inner product with a forest of hash prefixes.

Every vector has one long hash string of random hyperplane signs per tree; a tree is the sorted array
of its strings. A query descends each tree to its longest matching prefix, then all trees ascend
together, one bit at a time, and every vector below the prefixes reached is a candidate until there
are enough. Candidates are ranked by the true inner product.

Vectors are dealt into shards of bounded size, each with a forest of its own; queries visit them in
blocks, and the shards' best are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 20
EVERY = 20
TREES = 20
BITS = 64
#: Share of a shard's vectors that a query ranks, at least; recall is measured in the tests.
CANDIDATES = 0.5
SHARD_ROWS = 8192
BLOCK_ROWS = 4096
SEED = 11


def clean(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part: no null, zero or non-finite vectors."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where(v.isNotNull() & F.col("id").isNotNull()).where(finite & F.exists(v, lambda x: x != 0))


class Forest:
    """Sorted arrays of hash strings over some vectors."""

    def __init__(self, vectors: np.ndarray, largest: float, trees: int = TREES, seed: int = SEED) -> None:
        self.vectors = vectors
        planes = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, trees * BITS))
        # one more component gives all vectors the same length, so the largest product is the least angle
        rest = np.sqrt(np.maximum(largest**2 - (vectors**2).sum(axis=1), 0))
        self.planes, self.trees = planes, trees
        keys = self._keys(np.c_[vectors, rest])
        self.order = np.argsort(keys, axis=0, kind="stable")
        self.sorted = np.take_along_axis(keys, self.order, axis=0)

    def _keys(self, lifted: np.ndarray) -> np.ndarray:
        bits = np.packbits(lifted @ self.planes > 0, axis=1)
        return bits.reshape(len(lifted), self.trees, BITS // 8).view(">u8")[:, :, 0].astype(np.uint64)

    def candidates(self, queries: np.ndarray, wanted: int) -> list[np.ndarray]:
        """For each query the rows below the longest common prefix length that gives ``wanted`` rows."""
        keys = self._keys(np.c_[queries, np.zeros(len(queries))])
        low = np.zeros((BITS + 1, self.trees, len(queries)), np.int64)
        high = np.full_like(low, len(self.vectors))
        deepest = 0
        for depth in range(1, BITS + 1):
            mask = np.uint64(((1 << depth) - 1) << (BITS - depth))
            for t in range(self.trees):
                prefix, tree = keys[:, t] & mask, self.sorted[:, t]
                low[depth, t] = np.searchsorted(tree, prefix)
                high[depth, t] = np.searchsorted(tree, prefix | ~mask, side="right")
            deepest = depth
            if (high[depth] == low[depth]).all():  # no tree matches any query so far down
                break
        spread = (high - low).sum(axis=1)
        found = []
        for q in range(len(queries)):
            hit = np.zeros(len(self.vectors), bool)
            # ascend: rows of all trees together must suffice before their union can
            depth = deepest
            while depth and spread[depth, q] < wanted:
                depth -= 1
            while True:
                for t in range(self.trees):
                    hit[self.order[low[depth, t, q] : high[depth, t, q], t]] = True
                if depth == 0 or hit.sum() >= wanted:
                    break
                depth -= 1
            found.append(np.flatnonzero(hit))
        return found


def best(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, own: int, rows: np.ndarray, k: int):
    """The k best of ``rows``, nearest first, ties by id."""
    rows = rows[ids[rows] != own]
    rough = vectors[rows] @ query
    if len(rows) > k:
        edge = np.partition(rough, len(rows) - k)[len(rows) - k]
        rows = rows[rough >= edge - 1e-9 * max(1.0, abs(edge))]
    exact = (vectors[rows] * query).sum(axis=1)  # the same order of additions for every row
    top = np.lexsort((ids[rows], -exact))[:k]
    return ids[rows][top], exact[top]


def search(
    vectors: DataFrame,
    every: int = EVERY,
    k: int = K,
    candidates: float = CANDIDATES,
    trees: int = TREES,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row whose id ``every`` divides.

    Candidates are all rows but those with the query's id, of the same number of components. Null,
    zero and non-finite vectors and rows without an id take no part; a repeated query row counts
    once, repeated candidates each; other columns are left out; an empty table gives no rows.
    """
    rows = clean(vectors, id_col, vector_col)
    n, asked, largest = rows.agg(
        F.count("*"),
        F.count_if(F.col("id") % every == 0),
        F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))),
    ).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked // BLOCK_ROWS))
    number = lambda m: F.sequence(F.lit(0), F.lit(m - 1))
    size = F.size("v").alias("size")
    dealt = rows.select(
        size, F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.explode(number(blocks)).alias("block"), "id", "v"
    )
    queries = rows.where(F.col("id") % every == 0).dropDuplicates(["id", "v"]).withColumn("q", F.xxhash64("id", "v"))
    sent = queries.select(
        size, F.explode(number(shards)).alias("shard"), F.pmod("q", F.lit(blocks)).cast("int").alias("block"), "id", "q", "v"
    )
    schema = "q long, query_id long, vec_id long, score double"

    def visit(own: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if own.num_rows and asking.num_rows:
            order = np.argsort(own["id"].to_numpy(), kind="stable")
            ids = own["id"].to_numpy()[order]
            vs = np.stack(own["v"].to_numpy())[order]
            qs, qids, marks = np.stack(asking["v"].to_numpy()), asking["id"].to_numpy(), asking["q"].to_numpy()
            wanted = min(len(ids), max(int(np.ceil(candidates * len(ids))), k + 1))
            found = Forest(vs, largest, trees).candidates(qs, wanted)
            for i, rows_ in enumerate(found):
                near, score = best(ids, vs, qs[i], qids[i], rows_, k)
                for col, part in zip(out, (np.full(len(near), marks[i]), np.full(len(near), qids[i]), near, score), strict=True):
                    col.append(part)
        cols = [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, (int, int, int, float), strict=True)]
        return pa.table(dict(zip(("q", "query_id", "vec_id", "score"), cols, strict=True)))

    keys = ("size", "shard", "block")
    merged = dealt.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(visit, schema)
    rank = F.row_number().over(W.partitionBy("q", "query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
