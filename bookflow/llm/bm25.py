"""Exact BM25 top-k from an inverted index, with block-max WAND in every shard.

A shard is a run of documents that one task read: its postings are sorted and cut into blocks, each
with the largest term frequency and the least length in it, which bound its scores whatever the global
statistics turn out to be. A search reads the postings of the query terms only, skips blocks that
cannot reach the shard's k-th best score, and merges the shards' best; as document counts, frequencies
and the mean length are global, the merged list is exact.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookflow.llm.common import Batches, borders, runs
from bookflow.session import materialize

K1, B = 1.2, 0.75
K = 20
BLOCK = 64
SHARD_ROWS = 8192
#: Queries that travel to the shards at once.
QUERY_ROWS = 500
#: Scores count to so many decimals; ties go to the smaller document.
DECIMALS = 6

INDEX = "shard long, term string, block int, docs array<int>, freqs array<int>, max_freq int, min_length int, ids array<long>"
words = re.compile(r"[^\W_]+").findall


def tokens(text: str | None) -> list[str]:
    return words((text or "").lower())


def _shard(number: int, ids: list[int], texts: list[str | None]) -> pa.RecordBatch:
    """The index rows of one shard; the row without a term has its documents and their lengths."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    vocabulary: dict[str, int] = {}
    parts = [[vocabulary.setdefault(w, len(vocabulary)) for w in tokens(texts[i])] for i in order]
    lengths = np.array([len(p) for p in parts], np.int64)
    flat = np.fromiter((w for p in parts for w in p), np.int64, int(lengths.sum()))
    key, freq = np.unique(flat * len(ids) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
    term, doc = key // len(ids), key % len(ids)
    starts = borders(term)
    within = np.arange(len(term)) - np.repeat(starts[:-1], np.diff(starts)) if len(term) else term
    cuts = np.flatnonzero(within % BLOCK == 0)
    ends = np.r_[cuts, len(term)].astype(np.int32)
    names = pa.array(list(vocabulary), pa.string())
    n = len(cuts)
    top = np.maximum.reduceat(freq, cuts) if n else freq
    least = np.minimum.reduceat(lengths[doc], cuts) if n else freq
    blank = pa.nulls(n, pa.list_(pa.int64()))
    rows = [
        pa.array(np.full(n + 1, number)),
        pa.concat_arrays([names.take(pa.array(term[cuts])), pa.nulls(1, pa.string())]),
        pa.array(np.r_[within[cuts] // BLOCK, 0].astype(np.int32)),
        pa.ListArray.from_arrays(np.r_[ends, len(term) + len(ids)].astype(np.int32), np.r_[doc, np.arange(len(ids))].astype(np.int32)),
        pa.ListArray.from_arrays(np.r_[ends, len(term) + len(ids)].astype(np.int32), np.r_[freq, lengths].astype(np.int32)),
        pa.array(np.r_[top, 0].astype(np.int32)),
        pa.array(np.r_[least, 0].astype(np.int32)),
        pa.concat_arrays([blank, pa.array([[ids[i] for i in order]], pa.list_(pa.int64()))]),
    ]
    return pa.RecordBatch.from_arrays(rows, [c.split()[0] for c in INDEX.split(", ")])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index every row that has an id, where it is read: nothing is shuffled.

    A null or empty text is a document without words. Repeated rows are documents of their own.
    """

    def run(batches: Batches) -> Batches:
        made = 0
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD_ROWS):
                part = batch.slice(at, SHARD_ROWS)
                rows = _shard(
                    TaskContext.get().partitionId() << 24 | made, part.column(0).to_pylist(), part.column(1).to_pylist()
                )
                made += 1
                for first in range(0, rows.num_rows, 1 << 16):
                    yield rows.slice(first, 1 << 16)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    return materialize(rows.mapInArrow(run, INDEX), "index")


@dataclass
class Cursor:
    """A place in one term's postings in one shard."""

    weight: float  # of the term in the query, idf included
    docs: np.ndarray
    freqs: np.ndarray
    lasts: list[int]  # last document of each block
    tops: list[float]  # bound of each block's scores
    top: float = 0.0
    at: int = 0
    doc: int = 0

    def __post_init__(self) -> None:
        self.top = max(self.tops)
        self.doc = int(self.docs[0])

    def seek(self, doc: int) -> None:
        """Go to the first posting of ``doc`` or later."""
        if self.doc < doc:
            self.at += int(np.searchsorted(self.docs[self.at :], doc))
            self.doc = int(self.docs[self.at]) if self.at < len(self.docs) else END

    def block(self, doc: int) -> int:
        """The block that would hold ``doc``, without reading it."""
        lo, hi = 0, len(self.lasts)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.lasts[mid] < doc else (lo, mid)
        return lo


END = 1 << 40
SLACK = 10.0**-DECIMALS


def saturated(freq, length, mean: float):
    """BM25's part of frequency and length."""
    return freq * (K1 + 1) / (freq + K1 * (1 - B + B * length / mean))


def block_max_wand(cursors: list[Cursor], lengths: np.ndarray, mean: float, k: int) -> list[tuple[float, int]]:
    """The ``k`` best (score, document) of a shard; documents are met in order, so ties keep the first."""
    best: list[tuple[float, int]] = []
    bar = 0.0

    while True:
        cursors = sorted((c for c in cursors if c.doc < END), key=lambda c: c.doc)
        bound, pivot = 0.0, -1
        for i, c in enumerate(cursors):
            bound += c.top
            if bound + SLACK > bar:
                pivot = i
                break
        if pivot < 0:
            return best
        doc = cursors[pivot].doc
        while pivot + 1 < len(cursors) and cursors[pivot + 1].doc == doc:
            pivot += 1
        ahead = cursors[: pivot + 1]
        blocks = [c.block(doc) for c in ahead]
        bound = sum(c.tops[b] for c, b in zip(ahead, blocks, strict=True) if b < len(c.tops))
        if bound + SLACK > bar:
            if cursors[0].doc == doc:
                score = 0.0
                for c in sorted(ahead, key=lambda c: c.weight):
                    score += c.weight * float(saturated(int(c.freqs[c.at]), int(lengths[doc]), mean))
                score = round(score, DECIMALS)
                if len(best) < k:
                    heapq.heappush(best, (score, -doc))
                elif score > best[0][0]:
                    heapq.heapreplace(best, (score, -doc))
                if len(best) == k:
                    bar = best[0][0]
                target = doc + 1
                for c in ahead:
                    c.seek(target)
            else:
                for c in ahead:
                    c.seek(doc)
        else:
            target = cursors[pivot + 1].doc if pivot + 1 < len(cursors) else END
            for c, b in zip(ahead, blocks, strict=True):
                if b < len(c.lasts):
                    target = min(target, c.lasts[b] + 1)
            for c in ahead:
                c.seek(target)


def search(
    index: DataFrame, queries: DataFrame, k: int = K, id_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """(query_id, rank, doc_id, score): the ``k`` best documents of every query, best first.

    Documents without any of a query's words are no results, so a query may have fewer than ``k``, and
    one without words has none. Equal scores (to DECIMALS) rank by doc_id. Queries without an id are
    left out, queries of one id are joined into one text. They travel in blocks of QUERY_ROWS.
    """
    spark = index.sparkSession
    whole = index.where("term is null").agg(F.sum(F.size("docs")), F.sum(F.aggregate("freqs", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    n_docs, mean = whole[0] or 0, (whole[1] or 0) / max(whole[0] or 0, 1) or 1.0
    asked = queries.select(F.col(id_col).cast("long").alias("q"), F.col(text_col).alias("text")).where("q is not null")
    found = spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    block: dict[int, Counter] = {}
    for row in asked.orderBy("q", "text").toLocalIterator():
        if row["q"] not in block and len(block) == QUERY_ROWS:
            found = found.union(_search_block(index, block, n_docs, mean, k))
            block = {}
        block.setdefault(row["q"], Counter()).update(tokens(row["text"]))
    return found.union(_search_block(index, block, n_docs, mean, k)) if block else found


def _search_block(index: DataFrame, block: dict[int, Counter], n_docs: int, mean: float, k: int) -> DataFrame:
    spark = index.sparkSession
    terms = spark.createDataFrame([(t,) for t in sorted({t for c in block.values() for t in c})], "term string")
    named = index.join(F.broadcast(terms), "term", "left_semi")
    seen = {r["term"]: r["n"] for r in named.groupBy("term").agg(F.sum(F.size("docs")).alias("n")).collect()}
    idf = {t: float(np.log1p((n_docs - n + 0.5) / (n + 0.5))) for t, n in seen.items()}

    def visit(shard: pa.Table) -> pa.RecordBatch:
        rows = shard.to_pylist()
        ids, lengths = next((r["ids"], np.array(r["freqs"])) for r in rows if r["term"] is None)
        lists: dict[str, list[dict]] = {}
        for r in rows:
            if r["term"] is not None:
                lists.setdefault(r["term"], []).append(r)
        out: list[tuple] = []
        for q, counts in block.items():
            cursors = []
            for term in sorted(counts):
                if term in lists:
                    parts, weight = lists[term], counts[term] * idf[term]
                    cursors.append(
                        Cursor(
                            weight,
                            np.concatenate([p["docs"] for p in parts]),
                            np.concatenate([p["freqs"] for p in parts]),
                            [p["docs"][-1] for p in parts],
                            [weight * saturated(p["max_freq"], p["min_length"], mean) for p in parts],
                        )
                    )
            out += [(q, ids[-d], s) for s, d in block_max_wand(cursors, lengths, mean, k)]
        q, doc, score = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(q, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.float64())], ["query_id", "doc_id", "score"]
        )

    def run(batches: Batches) -> Batches:
        for table in runs(batches, "shard"):
            at = borders(table["shard"].to_numpy()).tolist()
            for s, e in zip(at, at[1:], strict=False):
                yield visit(table.slice(s, e - s))

    needed = named.unionByName(index.where("term is null").select(named.columns))
    dealt = needed.repartition("shard").sortWithinPartitions("shard", "term", "block")
    top = dealt.mapInArrow(run, "query_id long, doc_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return top.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


#: The same list in SQL; ``{every}`` picks the queries.
SQL = """
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS term FROM documents
), tf AS (SELECT doc_id, term, count(*) AS f FROM d GROUP BY ALL),
len AS (
  SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS n FROM documents
), stat AS (SELECT count(*) AS docs, avg(n) AS mean FROM len),
q AS (
  SELECT item_id AS query_id, term, count(*) AS qf FROM (
    SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term
    FROM benchmark WHERE item_id % 20 = 0
  ) GROUP BY ALL
), df AS (SELECT term, count(*) AS n FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term),
scored AS (
  SELECT query_id, doc_id, round(sum(
    qf * ln(1 + (docs - df.n + 0.5) / (df.n + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len.n / mean))), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len USING (doc_id) CROSS JOIN stat
  GROUP BY query_id, doc_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
