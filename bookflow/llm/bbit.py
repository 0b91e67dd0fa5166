"""MinHash near-duplicates: b-bit signatures, band candidates, links confirmed on full shingle sets.

Documents with equal shingle sets are one class; only classes are compared. A class has 160 minima: five
at a time they make the band keys, and their low four bits, packed into ten longs, are the signature.
Two signatures agree where all four bits do, which is counted by bit operations; agreement by chance is
taken off, which estimates the similarity. The estimate only drops pairs that are far below the
threshold; who passes is confirmed by intersecting the whole sets.

A bucket's classes are compared with its first class by signature; buckets whose classes are then not
all connected are searched for more candidates. Either step gives trees of candidates, never all pairs of
a bucket. What candidates connect is a cluster: its whole texts meet in shards of bounded size, where
every candidate pair that is not connected yet is confirmed by its sets. A large bucket or cluster is
dealt into lots, and every pair of lots is a shard, so no candidate is dropped.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.llm.common import Batches, borders, release, runs
from bookflow.llm.components import components
from bookflow.session import materialize

WORDS = 3
#: Documents link at this many hundredths of the shingles of both.
PERCENT = 85
BANDS, BAND_ROWS, BITS = 32, 5, 4
HASHES = BANDS * BAND_ROWS
#: The estimate may drop a pair that is just at the threshold with this probability.
MISS = 1e-9
#: Classes and shingles of a lot.
CHUNK, CHUNK_SHINGLES = 2048, 1 << 20
#: Shingles whose hashes are taken at once, and bytes of text.
SHINGLES, TEXT_BYTES = 1 << 13, 1 << 20
MEMO_WORDS = 200_000

PRINT = "doc long, n long, set binary, signature array<long>, bands array<long>"
LINK = "a long, b long"

_rng = np.random.default_rng(2011)
FACTORS = _rng.integers(1 << 31, 1 << 32, HASHES, np.uint64).astype(np.uint32) | np.uint32(1)
MASKS = _rng.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)
SPREAD = _rng.integers(1 << 62, 1 << 63, (BANDS, BAND_ROWS), np.uint64) | np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(self) < MEMO_WORDS:
            self[word] = found
        return found


_hashes = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; fewer words are one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    found = np.fromiter((_hashes[w] for w in words), np.uint64, len(words))
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9FB21C651E98DF25) + found[i : len(words) - size + 1 + i]
    return np.unique(_mixed(out + np.uint64(size)))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(set, hash function) minima; a set may be longer than what is hashed at once."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), HASHES), 0xFFFFFFFF, np.uint32)
    flat = (np.concatenate([np.zeros(0, np.uint64), *sets]) >> np.uint64(32)).astype(np.uint32)
    of = np.repeat(np.arange(len(sets)), sizes)
    for at in range(0, len(flat), SHINGLES):
        part, row = flat[at : at + SHINGLES], of[at : at + SHINGLES]
        starts = borders(row)[:-1]
        hashed = (part[None] ^ MASKS[:, None]) * FACTORS[:, None]
        rows = row[starts]
        out[rows] = np.minimum(out[rows], np.minimum.reduceat(hashed, starts, axis=1).T)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """(set, band) keys of all bits of a band's minima."""
    return _mixed((least.reshape(-1, BANDS, BAND_ROWS) * SPREAD).sum(axis=2, dtype=np.uint64) + SPREAD[:, 0])


def packed(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, packed into 64-bit words."""
    each = 64 // BITS
    low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(least), -1, each)
    return np.bitwise_or.reduce(low << (np.arange(each, dtype=np.uint64) * np.uint64(BITS)), axis=2)


#: One bit for each of a word's groups of BITS bits.
_ONES = sum(1 << i for i in range(0, 64, BITS))


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many minima of the rows of ``a`` (m, words) and ``b`` (n, words) agree in their low bits: (m, n)."""
    unlike = np.zeros((len(a), len(b)), np.int64)
    for i in range(a.shape[1]):
        x = a[:, i, None] ^ b[None, :, i]
        for shift in (1, 2):
            x |= x >> np.uint64(shift)
        unlike += np.bitwise_count(x & np.uint64(_ONES))
    return HASHES - unlike


def agreeing_columns(a: Column, b: Column) -> Column:
    """The same count for two signature columns."""

    def unlike(x: Column) -> Column:
        for shift in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        return F.bit_count(x.bitwiseAND(F.lit(_ONES).cast("long")))

    words = HASHES * BITS // 64
    return F.lit(HASHES) - sum((unlike(a[i].bitwiseXOR(b[i])) for i in range(words)), F.lit(0))


def estimated(agree: float) -> float:
    """The similarity behind a count of agreeing minima; 1 in 2^BITS unequal ones agree by chance."""
    chance = 0.5**BITS
    return (agree / HASHES - chance) / (1 - chance)


def least_estimate(percent: int = PERCENT, miss: float = MISS) -> float:
    """The estimate below which a pair of this similarity falls with a probability of at most ``miss``."""
    chance = 0.5**BITS
    p = chance + (1 - chance) * percent / 100
    below = 0.0
    for m in range(HASHES + 1):
        below += math.comb(HASHES, m) * p**m * (1 - p) ** (HASHES - m)
        if below > miss:
            return estimated(m)
    return 1.0


def prints(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """(doc, code, n, set, signature, bands): sizes, a 128-bit hash of the whole set and its minima."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(2)])
            cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(sizes) // TEXT_BYTES)) + 1, len(sizes)]
            for s, e in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                if s == e:
                    continue
                part = batch.slice(s, e - s)
                sets = [shingles(t, words) for t in part.column(2).to_pylist()]
                least = minima(sets)
                cols = [part.column(0), part.column(1), pa.array([len(x) for x in sets], pa.int64())]
                cols.append(pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()))
                cols += [pa.array(list(x.view(np.int64)), pa.list_(pa.int64())) for x in (packed(least), band_keys(least))]
                yield pa.RecordBatch.from_arrays(cols, ["doc", "code", *[c.split()[0] for c in PRINT.split(", ")][1:]])

    rows = source(docs, id_col, text_col)
    return rows.mapInArrow(run, PRINT.replace("doc long", "doc long, code long"))


def source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, code, text): ``code`` is a hash of the text, so that it can be found again."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("code"), text.cast("binary").alias("text"))


def classes_of(found: DataFrame) -> DataFrame:
    """One row for each different set that is not empty: (c, set, n, doc, code, signature, bands).

    ``c`` is a number of the class; ``doc`` and ``code`` name one text that has the set.
    """
    kept = found.where("n > 0").groupBy("set").agg(
        F.min(F.struct("doc", "code")).alias("text"), *[F.first(x).alias(x) for x in ("n", "signature", "bands")]
    )
    kept = materialize(kept, "sets")
    for seed in itertools.count():
        numbered = kept.withColumn("c", F.xxhash64("set", F.lit(seed)))
        if numbered.groupBy("c").count().where("count > 1").isEmpty():
            return numbered.select("c", "set", "n", "text.*", "signature", "bands")


def _lots(rows: DataFrame, group: str, most_rows: int, most_shingles: int) -> DataFrame:
    """``rows`` (group, c, n, ...) dealt into shards of bounded size: (shard, part, ...).

    A group is cut into lots by a hash of c; every pair of lots is a shard, whose rows are part 1 and
    2, and so is every lot alone, as part 0. So each pair of a group's rows meets in one shard.
    """
    few = F.greatest(F.ceil(F.count("*") / most_rows), F.ceil(F.sum("n") / most_shingles))
    sizes = rows.groupBy(group).agg(few.alias("lots"))
    paired = rows.join(sizes, group).withColumn("lot", F.pmod(F.xxhash64("c"), "lots"))
    paired = paired.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)))
    part = F.when(F.col("lot") == F.col("other"), 0).when(F.col("lot") < F.col("other"), 1).otherwise(2)
    # should two shards get one number, their rows are compared without need and that is all
    shard = F.xxhash64(group, F.least("lot", "other"), F.greatest("lot", "other"))
    return paired.withColumns({"shard": shard, "part": part})


def _signatures(table: pa.Table) -> np.ndarray:
    flat = np.concatenate([x.flatten().to_numpy() for x in table["signature"].chunks])
    return flat.reshape(table.num_rows, -1).view(np.uint64)


def _forest(labels: np.ndarray, part: np.ndarray, candidates, linked) -> list[tuple[int, int]]:
    """Links that connect what ``linked`` connects, row by row; rows of one label need none.

    ``candidates(x, y)`` says for rows x (some) and y (all that they may link with) which are worth a
    look, ``linked(i, js)`` which rows of js row i links with. Changes ``labels``.
    """
    out = []
    where = [np.flatnonzero(part == p) for p in range(3)]
    for x, y in ((where[0], where[0]), (where[1], where[2])):
        for at in range(0, len(x), 64):
            if not len(y) or (labels[y] == labels[y[0]]).all() and (labels[x] == labels[y[0]]).all():
                break
            rows = x[at : at + 64]
            good = candidates(rows, y)
            for i, may in zip(rows.tolist(), good, strict=True):
                js = y[may & (labels[y] != labels[i])]
                js = js[linked(i, js)] if len(js) else js
                if len(js):
                    others, first = np.unique(labels[js], return_index=True)
                    out += [(i, int(j)) for j in js[first]]
                    labels[np.isin(labels, others)] = labels[i]
    return out


def _near(n: np.ndarray, signature: np.ndarray, cut: float, percent: int):
    """Which pairs of rows may be links, by their sizes and the estimate."""

    def candidates(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        least, most = np.minimum(n[x][:, None], n[y]), np.maximum(n[x][:, None], n[y])
        return (100 * least >= percent * most) & (estimated(agreeing(signature[x], signature[y])) >= cut)

    return candidates


def _by_shard(visit, columns: str):
    """A function over sorted batches that calls ``visit`` with every shard's table; it gives row pairs."""

    def run(batches: Batches) -> Batches:
        for table in runs(batches, "shard"):
            at = borders(table["shard"].to_numpy()).tolist()
            c, out = table["c"].to_numpy(), []
            for s, e in zip(at, at[1:], strict=False):
                if e - s > 1:
                    out += [(c[s + i], c[s + j]) for i, j in visit(table.slice(s, e - s))]
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], columns.split())

    return run


def searched(members: DataFrame, chunk: int, cut: float, percent: int) -> DataFrame:
    """(a, b): candidates that connect the ``root`` of a bucket's classes (key, c, root, n, signature).

    A spanning forest of each shard's candidates, never all pairs.
    """

    def visit(table: pa.Table) -> list[tuple[int, int]]:
        root, n, part = (table[x].to_numpy() for x in ("root", "n", "part"))
        near = _near(n, _signatures(table), cut, percent)
        return _forest(root.copy(), part, near, lambda i, js: slice(None))

    shards = _lots(members, "key", chunk, 1 << 62).select("shard", "part", "c", "root", "n", "signature")
    dealt = shards.repartition("shard").sortWithinPartitions("shard", "c")
    return dealt.mapInArrow(_by_shard(visit, "a b"), LINK).distinct()


def confirmed(
    clustered: DataFrame, texts: DataFrame, words: int, percent: int, chunk: int, cut: float
) -> DataFrame:
    """(a, b): links that connect the classes (cluster, c, n, doc, code, signature) of each cluster.

    Their whole texts meet in shards of bounded size, where sets that pass the estimate and are not
    connected yet are intersected: one row's set with all of its candidates' at once.
    """

    def visit(table: pa.Table) -> list[tuple[int, int]]:
        sets = [shingles(t.as_py(), words) for t in table["text"]]
        n = np.array([len(s) for s in sets])
        values, flat = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(n) - n
        own = [flat[s : s + k] for s, k in zip(starts.tolist(), n.tolist(), strict=True)]
        mark = np.zeros(len(values), bool)

        def linked(i: int, js: np.ndarray) -> np.ndarray:
            mark[own[i]] = True
            held = mark[np.concatenate([own[j] for j in js.tolist()])]
            mark[own[i]] = False
            both = np.add.reduceat(held, np.cumsum(n[js]) - n[js], dtype=np.int64)
            return 100 * both >= percent * (n[i] + n[js] - both)

        near = _near(n, _signatures(table), cut, percent)
        return _forest(table["c"].to_numpy().copy(), table["part"].to_numpy(), near, linked)

    shards = _lots(clustered, "cluster", chunk, CHUNK_SHINGLES)
    own = shards.select("shard", "part", "c", "signature", F.col("code").alias("key"), F.col("doc").alias("of"))
    own = materialize(own, "shards")
    met = texts.join(own, (texts["code"] == own["key"]) & texts["doc"].eqNullSafe(own["of"]))
    dealt = met.select("shard", "part", "c", "signature", "text").repartition("shard").sortWithinPartitions("shard", "c")
    return materialize(dealt.mapInArrow(_by_shard(visit, "a b"), LINK).where("a <> b").distinct(), "links")


def links_of(classes: DataFrame, texts: DataFrame, words: int, percent: int, chunk: int = CHUNK) -> DataFrame:
    """(node, root) of the components of all links between classes."""
    cut = least_estimate(percent)
    dealt = classes.select("c", F.explode("bands").alias("key"))
    heads = dealt.groupBy("key").agg(F.min("c").alias("head"), F.count("*").alias("many")).where("many > 1")
    shared = materialize(dealt.join(heads, "key").select("key", "c", "head"), "shared")
    signs = classes.select("c", "n", "signature")
    stars = shared.where("c <> head").select(F.col("head").alias("a"), F.col("c").alias("b")).distinct()
    of_a, of_b = (signs.select(*[F.col(x).alias(f"{x}_{s}") for x in signs.columns]) for s in "ab")
    near = (
        stars.join(of_a, F.col("a") == F.col("c_a"))
        .join(of_b, F.col("b") == F.col("c_b"))
        .where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        .where(estimated(agreeing_columns(F.col("signature_a"), F.col("signature_b"))) >= cut)
        .select("a", "b")
    )
    near = materialize(near, "stars")
    roots = materialize(components(near), "roots")
    members = shared.join(roots, F.col("c") == F.col("node"), "left").select("key", "c", F.coalesce("root", "c").alias("root"))
    open_keys = members.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    more = materialize(searched(members.join(open_keys, "key").join(signs, "c"), chunk, cut, percent), "found")
    release(classes.sparkSession)
    clusters = components(near.unionByName(more)).select(F.col("node").alias("c"), F.col("root").alias("cluster"))
    clustered = materialize(clusters.join(classes.select("c", "n", "doc", "code", "signature"), "c"), "clusters")
    links = confirmed(clustered, texts, words, percent, chunk, cut)
    release(classes.sparkSession)
    return components(links)


def near_duplicates(
    docs: DataFrame,
    percent: int = PERCENT,
    words: int = WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    A document's set is that of its ``words``-word shingles, A-Z in lower case; with fewer words it is
    the whole sequence. Documents link if their sets share ``percent`` hundredths of their union.
    Documents without words (null, empty, white space) link with nothing, not even with each other.
    Texts are read whole. Repeated rows stay, with the same result; a null doc_id is never a
    component's id unless all are null. ``kept`` compares null ids as equal. Other columns are left
    out. No rows: no rows.

    The shingles of a set are 64-bit hashes, a class is a 128-bit hash of them. Of pairs that are just
    at the threshold the bands miss less than one in 10^8 and the estimate one in 10^9; none else.
    """
    found = materialize(prints(docs, id_col, text_col, words), "prints")
    classes = materialize(classes_of(found), "classes")
    roots = links_of(classes, source(docs, id_col, text_col), words, percent, chunk)
    rooted = classes.select("c", "set", "doc").join(roots, F.col("c") == F.col("node"), "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "c"))
    least = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = rooted.join(least, "root").select("set", "component_id")
    # a hot set is on the side of the documents, which AQE splits
    whole = found.where("n > 0").join(named, "set").select("doc", "n", "component_id")
    whole = whole.unionByName(found.where("n = 0").select("doc", "n", F.col("doc").alias("component_id")))
    return whole.select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("doc").eqNullSafe(F.col("component_id")).alias("kept"),
    )


#: The same rows in SQL, for documents whose ids differ.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 3 THEN list_value(array_to_string(w, ' '))
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM w WHERE len(w) > 0
), shingle AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets),
pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) + any_value(b.n) AS whole
  FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY ALL
), link AS MATERIALIZED (
  SELECT a, b FROM pair WHERE 100 * shared >= 85 * (whole - shared)
  UNION ALL SELECT b, a FROM pair WHERE 100 * shared >= 85 * (whole - shared)
), reach(doc_id, r) AS (
  SELECT DISTINCT a, a FROM link UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r
), least AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(len(sets.s), 0) AS n_shingles, coalesce(least.r, w.doc_id) AS component_id,
  coalesce(least.r, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN sets USING (doc_id) LEFT JOIN least USING (doc_id)
"""
