"""Exact ranked lexical search: compressed postings per shard, Block-Max MaxScore, shard heaps merged.

A shard is a run of documents that one task read, some million words, however they came in batches.
Its posting lists are cut into blocks of compressed gaps and frequencies; beside each block stand its
last document, largest frequency and least length, which bound its scores whatever the global
statistics turn out to be. A search takes a query's lists by their bounds: those whose bounds together
stay below the score to beat are not essential, so only documents of the others are candidates. A
candidate is dropped as soon as its score so far and the bounds left, with the maximum of the block
that it would be in, cannot reach that score; only blocks that still hold candidates are decompressed.
Queries travel to the shards with the terms that they ask for, as rows, in blocks of many queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookflow.llm.common import Batches, borders, runs
from bookflow.operators.matching import fits
from bookflow.session import materialize

K = 20
BLOCK = 128
#: Terms and documents after which a shard is closed.
SHARD_TERMS, SHARD_DOCS = 1 << 21, 1 << 16
#: Documents of a shard that are scored before the score to beat is looked at again.
WINDOW = 1024
#: Queries that visit a shard together.
QUERY_BLOCK = 4096
#: A table of asked terms within these bounds is sent to every task.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8 << 20
#: Bits of a shard's number.
SHARD_BITS = 41

INDEX = (
    "shard long, term binary, n_docs long, body binary, cuts array<int>, lasts array<int>, tops array<int>, "
    "least array<int>, ids array<long>, lengths array<int>"
)
ASKED = "item long, term binary, repeats long"
FOUND = "item_id long, doc_id long, score long"

#: ASCII letters (in lower case) and digits and every byte of other characters stay.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def varbytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the top bit set on all but a value's last byte; with each value's end."""
    size = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        size += values >> bits > 0
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for j in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > j)
        out[(ends - size)[some] + j] = values[some] >> 7 * j & 127 | (size[some] > j + 1) << 7
    return out, ends


def unpacked(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    starts = np.r_[0, ends[:-1] + 1]
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, starts)


def _list_array(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values, kind))


def shard_rows(number: int, ids: list[int], texts: list[list[int]], vocabulary: list[bytes]) -> pa.RecordBatch:
    """The index rows of one shard: one for each term and, last, one of its documents and their lengths."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    lengths = np.array([len(texts[i]) for i in order], np.int64)
    flat = np.fromiter((w for i in order for w in texts[i]), np.int64, int(lengths.sum()))
    key, freq = np.unique(flat * len(ids) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
    term, doc = key // len(ids), key % len(ids)
    starts = borders(term)
    n = len(vocabulary)
    sizes = np.diff(starts)
    within = np.arange(len(term)) - np.repeat(starts[:-1], sizes) if n else term
    first = within % BLOCK == 0
    cuts = np.flatnonzero(first)
    gaps = np.where(first, doc, doc - np.r_[0, doc[:-1]]) if n else doc
    data, ends = varbytes(np.column_stack([gaps, freq]).reshape(-1))
    block_ends = np.r_[cuts[1:], len(term)] if n else cuts
    byte_ends = ends[2 * block_ends - 1] if n else ends
    blocks = -(-sizes // BLOCK) if n else sizes[:0]
    last_block = np.cumsum(blocks)
    body_ends = byte_ends[last_block - 1] if n else ends
    body_starts = np.r_[0, body_ends[:-1]] if n else ends
    bodies = pa.Array.from_buffers(
        pa.binary(), n, [None, pa.py_buffer(np.r_[0, body_ends].astype(np.int32)), pa.py_buffer(data)]
    )
    tops = np.maximum.reduceat(freq, cuts) if n else freq
    least = np.minimum.reduceat(lengths[doc], cuts) if n else freq
    blank = [pa.nulls(1, t) for t in (pa.binary(), pa.list_(pa.int32()))]
    per_block = (byte_ends - np.repeat(body_starts, blocks), doc[block_ends - 1] if n else doc, tops, least)
    rows = [
        pa.array(np.full(n + 1, number)),
        pa.concat_arrays([pa.array(vocabulary, pa.binary()), blank[0]]),
        pa.array(np.r_[sizes[:n], len(ids)]),
        pa.concat_arrays([bodies, blank[0]]),
        *[pa.concat_arrays([_list_array(c.astype(np.int32), last_block, pa.int32()), blank[1]]) for c in per_block],
        pa.concat_arrays([pa.nulls(n, pa.list_(pa.int64())), pa.array([[ids[i] for i in order]], pa.list_(pa.int64()))]),
        pa.concat_arrays([pa.nulls(n, pa.list_(pa.int32())), pa.array([lengths.astype(np.int32)], pa.list_(pa.int32()))]),
    ]
    return pa.RecordBatch.from_arrays(rows, [c.split()[0] for c in INDEX.split(", ")])


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_terms: int = SHARD_TERMS
) -> DataFrame:
    """Index every row that has an id, where it is read: nothing is shuffled.

    A null or empty text is a document without terms. Repeated rows are documents of their own, very
    long texts are indexed whole (one may be a shard by itself). Other columns are left out.
    """

    def run(batches: Batches) -> Batches:
        made, size = 0, 0
        ids: list[int] = []
        texts: list[list[int]] = []
        vocabulary: dict[bytes, int] = {}

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal made, size, ids, texts, vocabulary
            rows = shard_rows(TaskContext.get().partitionId() << 20 | made, ids, texts, list(vocabulary))
            made, size, ids, texts, vocabulary = made + 1, 0, [], [], {}
            for at in range(0, rows.num_rows, 1 << 16):
                yield rows.slice(at, 1 << 16)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                number = vocabulary.setdefault
                ids.append(doc)
                texts.append([number(w, len(vocabulary)) for w in terms(text.as_py())])
                size += len(texts[-1])
                if size >= shard_terms or len(ids) == SHARD_DOCS:
                    yield from closed()
        if ids:
            yield from closed()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return materialize(rows.where("id is not null").mapInArrow(run, INDEX), "maxscore_index")


class Postings:
    """One term's list in one shard; its blocks are decompressed when they are first needed."""

    def __init__(self, row: dict, norms: np.ndarray, norm_of) -> None:
        self.weight: int = row["weight"]
        self.size: int = row["n_docs"]
        self.body = np.frombuffer(row["body"], np.uint8)
        self.cuts = np.array(row["cuts"])
        self.lasts = np.array(row["lasts"])
        self.norms = norms
        self.tops = self.weight * saturated(np.array(row["tops"], np.int64), norm_of(np.array(row["least"], np.int64)))
        self.top = int(self.tops.max())
        self.ready = np.zeros(len(self.cuts), bool)
        self.docs = np.zeros(self.size, np.int64)
        self.scores = np.zeros(self.size, np.int64)

    def decompress(self, blocks: np.ndarray) -> None:
        todo = blocks[~self.ready[blocks]]
        if not len(todo):
            return
        self.ready[todo] = True
        starts = np.r_[0, self.cuts[:-1]][todo]
        data = np.concatenate([self.body[s:e] for s, e in zip(starts.tolist(), self.cuts[todo].tolist(), strict=True)])
        values = unpacked(data)
        at = self.places(todo)
        total = np.cumsum(values[::2])
        sizes = np.minimum(self.size - todo * BLOCK, BLOCK)
        first = np.cumsum(sizes) - sizes
        base = np.where(first > 0, total[first - 1], 0)
        self.docs[at] = total - np.repeat(base, sizes)
        self.scores[at] = self.weight * saturated(values[1::2], self.norms[self.docs[at]])

    def places(self, blocks: np.ndarray) -> np.ndarray:
        """Positions of the postings of ``blocks``."""
        at = (blocks[:, None] * BLOCK + np.arange(BLOCK)).reshape(-1)
        return at[at < self.size]

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the postings with low <= document < high."""
        s, e = np.searchsorted(self.lasts, (low, high))
        e = min(int(e) + 1, len(self.lasts))
        self.decompress(np.arange(s, e))
        part = slice(int(s) * BLOCK, min(e * BLOCK, self.size))
        docs = self.docs[part]
        a, b = np.searchsorted(docs, (low, high))
        return docs[a:b], self.scores[part][a:b]


def saturated(freq: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * freq // (1000 * freq + 12 * norm)


class Heap:
    """The ``k`` best (score, document id) of a query so far; equal scores rank by id."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.scores = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)

    @property
    def bar(self) -> int:
        """What a document has to reach; an equal score may rank higher by its id."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.r_[self.scores, scores], np.r_[self.ids, ids]
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def block_max_maxscore(lists: list[tuple[Postings, int]], ids: np.ndarray, heap: Heap) -> None:
    """Add a shard's documents to ``heap`` that can enter it. ``lists``: postings and how often they count."""
    lists = sorted(lists, key=lambda x: x[0].top * x[1])
    sums = np.cumsum([p.top * n for p, n in lists])
    for low in range(0, len(ids), WINDOW):
        high = min(low + WINDOW, len(ids))
        bar = heap.bar
        essential = int(np.searchsorted(sums, bar))  # the lists before it stay below the bar even together
        score = np.zeros(high - low, np.int64)
        for p, n in lists[essential:]:
            docs, scores = p.between(low, high)
            score[docs - low] += n * scores
        found = np.flatnonzero(score)
        for i in range(essential - 1, -1, -1):
            p, n = lists[i]
            found = found[score[found] + sums[i] >= bar]
            if not len(found):
                break
            block = np.searchsorted(p.lasts, found + low)
            inside = block < len(p.lasts)
            most = np.where(inside, n * p.tops[np.minimum(block, len(p.lasts) - 1)], 0)
            stays = score[found] + most + (sums[i - 1] if i else 0) >= bar
            found, block = found[stays], block[stays & inside]
            if not len(block):
                continue
            block = np.unique(block)
            p.decompress(block)
            at = p.places(block)
            docs = p.docs[at]
            hit = np.minimum(np.searchsorted(docs, found + low), len(docs) - 1)
            score[found] += np.where(docs[hit] == found + low, n * p.scores[at][hit], 0)
        found = found[score[found] >= bar]
        if len(found):
            heap.add(score[found], ids[found + low])


def asked_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """ASKED: how often every query names each of its terms; rows of one id are one query."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            item, term = [], []
            for q, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = terms(text)
                item += [q] * len(found)
                term += found
            cols = [pa.array(item, pa.int64()), pa.array(term, pa.binary()), pa.array([1] * len(item), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in ASKED.split(", ")])

    rows = queries.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    split = rows.where("id is not null").mapInArrow(run, ASKED)
    return materialize(split.groupBy("item", "term").agg(F.sum("repeats").alias("repeats")), "asked")


def search(
    index: DataFrame, queries: DataFrame, k: int = K, id_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents with a score above 0 of every query.

    Best first, equal scores by doc_id; repeated documents are listed as often as they are there. A
    query without terms, or with none that a document holds, has no rows. Queries without an id are
    left out. An empty index or no queries: no rows. Texts are read whole.
    """
    documents = index.where("term is null")
    of = documents.select(
        F.size(F.filter("lengths", lambda n: n > 0)).alias("n"),
        F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n).alias("l"),
    )
    whole = of.agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    n_docs, n_terms = whole["n"] or 0, max(whole["l"] or 0, 1)

    asked = asked_terms(queries, id_col, text_col)
    blocks = max(1, -(-asked.select("item").distinct().count() // QUERY_BLOCK))
    wanted = asked.groupBy(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), "term").agg(
        F.collect_list(F.struct("item", "repeats")).alias("items")
    )
    small = fits(asked, ["term"], BROADCAST_ROWS, BROADCAST_BYTES)
    once = asked.select("term").distinct()
    held = index.where("term is not null").select("term", "n_docs").join(F.broadcast(once) if small else once, "term")
    share = (2 * n_docs + 2) / (2 * F.col("df") + 1)
    weights = held.groupBy("term").agg(F.sum("n_docs").alias("df")).select(
        "term", F.floor(1000 * F.log(share)).cast("long").alias("weight")
    )
    wanted = materialize(wanted.join(weights, "term").select("block", "term", "weight", "items"), "wanted")
    lists = index.where("term is not null").join(F.broadcast(wanted) if small else wanted, "term")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    columns = ["block", "shard", "term", "n_docs", "weight", "body", "cuts", "lasts", "tops", "least", "items", "ids", "lengths"]
    whole_shards = documents.select(
        every.alias("block"), *[F.lit(None).cast(lists.schema[c].dataType).alias(c) for c in ("weight", "items")],
        *[c for c in columns if c not in ("block", "weight", "items")],
    )
    rows = lists.select(*columns).unionByName(whole_shards)
    rows = rows.withColumn("visit", F.shiftleft("block", SHARD_BITS).bitwiseOR(F.col("shard")))

    def norm_of(lengths: np.ndarray) -> np.ndarray:
        return 75 + 25 * lengths * n_docs // n_terms

    def visit(shard: list[dict], heaps: dict[int, Heap]) -> None:
        documents = next(r for r in shard if r["term"] is None)
        ids = np.array(documents["ids"], np.int64)
        norms = norm_of(np.array(documents["lengths"], np.int64))
        asks: dict[int, list[tuple[Postings, int]]] = {}
        for r in shard:
            if r["term"] is not None:
                postings = Postings(r, norms, norm_of)
                for a in r["items"]:
                    asks.setdefault(a["item"], []).append((postings, a["repeats"]))
        for item in sorted(asks):
            block_max_maxscore(asks[item], ids, heaps.setdefault(item, Heap(k)))

    def best(heaps: dict[int, Heap]) -> pa.RecordBatch:
        items = np.repeat(np.array(list(heaps), np.int64), [len(h.ids) for h in heaps.values()])
        ids = np.concatenate([np.zeros(0, np.int64), *(h.ids for h in heaps.values())])
        scores = np.concatenate([np.zeros(0, np.int64), *(h.scores for h in heaps.values())])
        return pa.RecordBatch.from_arrays([pa.array(items), pa.array(ids), pa.array(scores)], [c.split()[0] for c in FOUND.split(", ")])

    def run(batches: Batches) -> Batches:
        heaps: dict[int, Heap] = {}
        block = None
        for table in runs(batches, "visit"):
            at = borders(table["visit"].to_numpy()).tolist()
            for s, e in zip(at, at[1:], strict=False):
                shard = table.slice(s, e - s).to_pylist()
                if shard[0]["block"] != block:
                    if heaps:
                        yield best(heaps)
                    heaps, block = {}, shard[0]["block"]
                visit(shard, heaps)
        if heaps:
            yield best(heaps)

    found = rows.repartition("visit").sortWithinPartitions("visit", "term").mapInArrow(run, FOUND)
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_TERMS = r"""regexp_extract_all(
    translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

#: The same list in SQL, for documents whose ids differ.
SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_TERMS.format("text")} AS terms FROM documents WHERE doc_id IS NOT NULL),
stat AS (SELECT count(*) FILTER (len(terms) > 0) AS big_n, CAST(sum(len(terms)) AS BIGINT) AS big_l FROM d),
norm AS (SELECT doc_id, 75 + (25 * len(terms) * big_n) // big_l AS m FROM d, stat),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY ALL),
q AS (
  SELECT item_id, term, count(*) AS repeats
  FROM (SELECT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM tf, stat WHERE term IN (SELECT term FROM q) GROUP BY term
), scored AS (
  SELECT item_id, doc_id, CAST(sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN norm USING (doc_id) GROUP BY ALL
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
