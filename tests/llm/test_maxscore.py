import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from bookflow.llm import maxscore
from bookflow.llm import queries as Q

from tests.llm.conftest import SF

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, queries, k=20):
    """docs: (id, text) rows, queries: (id, text) rows -> (item, rank, doc, score) rows."""
    found = [(i, Counter(plain_terms(t))) for i, t in docs if i is not None]
    n_docs = sum(bool(c) for _, c in found)
    n_terms = sum(sum(c.values()) for _, c in found) or 1
    df = Counter(t for _, c in found for t in c)
    asked = {}
    for q, text in queries:
        if q is not None:
            asked.setdefault(q, Counter()).update(plain_terms(text))
    rows = []
    for q, counts in asked.items():
        scores = []
        for i, c in found:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(
                n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t, n in counts.items()
                if c[t]
            )
            if score > 0:
                scores.append((-score, i))
        rows += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(rows)


def rows(df):
    return sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def test_query(spark, docs):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = plain_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in benchmark.collect()])
    assert rows(Q.QUERIES["op13_maxscore_search"](spark, SF)) == want
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert sorted(con.execute(Q.ORACLES["op13_maxscore_search"]).fetchall()) == want


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40, 300])))) for i in range(n)]
    queries = [(q, " ".join(rng.choices(words, k=rng.randint(0, 15)))) for q in range(30)]
    return docs, queries


@pytest.mark.parametrize("shard_terms, block, k", [(maxscore.SHARD_TERMS, 4096, 20), (500, 4, 3), (1, 7, 1)])
def test_random(spark, monkeypatch, shard_terms, block, k):
    """Many shards and blocks of few queries; ties are frequent."""
    monkeypatch.setattr(maxscore, "QUERY_BLOCK", block)
    docs, queries = corpus(shard_terms, 300)
    index = maxscore.build_index(spark.createDataFrame(docs, "doc_id long, text string"), shard_terms=shard_terms)
    asked = spark.createDataFrame(queries, "item_id long, text string")
    assert rows(maxscore.search(index, asked, k)) == plain_search(docs, queries, k)
    monkeypatch.setattr(maxscore, "BROADCAST_ROWS", 0)
    assert rows(maxscore.search(index, asked, k)) == plain_search(docs, queries, k)


def test_shards_do_not_follow_batches(spark):
    docs, _ = corpus(3, 400)
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    counts = []
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        index = maxscore.build_index(frame, shard_terms=5000)
        counts.append((index.count(), index.select("shard").distinct().count()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert counts[0] == counts[1] and counts[0][1] > 1


def test_varbytes():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1, 2**28, 2**31 - 1])
    data, ends = maxscore.varbytes(values)
    assert maxscore.unpacked(data).tolist() == values.tolist()
    assert ends[-1] == len(data) == 1 * 3 + 2 * 2 + 3 * 2 + 4 * 2 + 5 * 2


def test_blocks_stay_compressed():
    """A rare term decides the query, so most blocks of a frequent one are never decompressed."""
    rng = random.Random(1)
    texts = [[0] + [1] * (20 if i < 40 else 0) + [2 + rng.randrange(50) for _ in range(30)] for i in range(6000)]
    rows = maxscore.shard_rows(0, list(range(6000)), texts, [b"%d" % i for i in range(52)]).to_pylist()
    n_terms = sum(map(len, texts))

    def norm_of(lengths):
        return 75 + 25 * lengths * 6000 // n_terms

    norms = norm_of(np.array(rows[-1]["lengths"], np.int64))
    lists = []
    for r, df in ((rows[0], 6000), (rows[1], 40)):
        lists.append((maxscore.Postings(r | {"weight": math.floor(1000 * math.log(12002 / (2 * df + 1)))}, norms, norm_of), 1))
    heap = maxscore.Heap(20)
    maxscore.block_max_maxscore(lists, np.arange(6000), heap)
    assert len(heap.ids) == 20 and max(heap.ids) < 40
    assert len(lists[0][0].ready) == 47 and lists[0][0].ready.sum() <= 8


def test_odd(spark, odd, no_docs):
    queries = [
        (1, "the quick brown FOX"),
        (1, "fox"),
        (2, None),
        (3, "Ünïcödé 😀 élan lorem"),
        (None, "lost"),
        (4, "nowhere"),
        (5, "lorem " * 500),
    ]
    asked = spark.createDataFrame([(*q, "x", "y", "z") for q in queries], "item_id long, text string, term string, item string, block string")
    want = plain_search([(r["doc_id"], r["text"]) for r in odd.collect()], queries)
    assert rows(maxscore.search(maxscore.build_index(odd), asked)) == want
    assert [r for r in want if r[0] == 1] and not [r for r in want if r[0] in (2, 4)]
    assert rows(maxscore.search(maxscore.build_index(no_docs), asked)) == []
    assert rows(maxscore.search(maxscore.build_index(odd), asked.limit(0))) == []
