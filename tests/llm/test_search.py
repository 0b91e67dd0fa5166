import math
import random
from collections import Counter

import numpy as np
import pytest

from bookflow.llm import bm25, neighbours
from bookflow.llm import queries as Q

from tests.llm.conftest import SF


def plain_bm25(texts, asked, k):
    docs = {i: bm25.tokens(t) for i, t in texts}
    mean = sum(map(len, docs.values())) / len(docs)
    counts = {i: Counter(w) for i, w in docs.items()}
    df = Counter(t for c in counts.values() for t in c)
    out = []
    for q, text in asked:
        scores = []
        for i, c in counts.items():
            s = sum(
                n * math.log1p((len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * bm25.saturated(c[t], len(docs[i]), mean)
                for t, n in Counter(bm25.tokens(text)).items()
                if t in c
            )
            if any(t in c for t in bm25.tokens(text)):
                scores.append((-round(s, 6), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_bm25_against_all_scores(spark, monkeypatch, seed):
    """Small shards and blocks, common words, many ties."""
    monkeypatch.setattr(bm25, "QUERY_ROWS", 3)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    texts = [(i, " ".join(rng.choices(words, weights=range(1, 41), k=rng.randint(0, 25)))) for i in range(700)]
    asked = [(i, " ".join(rng.choices(words, k=rng.randint(0, 6)))) for i in range(8)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = bm25.search(bm25.build_index(docs), spark.createDataFrame(asked, "item_id long, text string"), k=7).collect()
    assert sorted(map(tuple, got)) == sorted(plain_bm25(texts, asked, 7))


def test_wand_skips_but_is_exact(monkeypatch):
    rng = np.random.default_rng(1)
    lengths = rng.integers(5, 200, 5000)
    cursors, total = [], np.zeros(5000)
    for weight, share in ((0.1, 0.9), (2.0, 0.05), (4.0, 0.02)):
        docs = np.flatnonzero(rng.random(5000) < share)
        freqs = rng.integers(1, 9, len(docs))
        total[docs] += weight * bm25.saturated(freqs, lengths[docs], 100.0)
        cuts = range(0, len(docs), 64)
        tops = [
            weight * bm25.saturated(freqs[c : c + 64].max(), lengths[docs[c : c + 64]].min(), 100.0) for c in cuts
        ]
        cursors.append(bm25.Cursor(weight, docs, freqs, [int(docs[c : c + 64][-1]) for c in cuts], tops))
    calls = []
    plain = bm25.saturated
    monkeypatch.setattr(bm25, "saturated", lambda *a: calls.append(1) or plain(*a))
    found = sorted(bm25.block_max_wand(cursors, lengths, 100.0, 10), reverse=True)
    want = sorted(((round(float(s), 6), -d) for d, s in enumerate(total)), reverse=True)[:10]
    assert found == want
    assert len(calls) < 2500  # of 4,900 postings


def test_bm25_odd(spark, odd, no_docs):
    index = bm25.build_index(odd)
    asked = spark.createDataFrame([(1, "lazy fox"), (2, None), (3, "ABSENT"), (None, "fox"), (4, "élan")], "item_id long, text string")
    got = [tuple(r)[:3] for r in bm25.search(index, asked).collect()]
    assert sorted(got) == [(1, 1, 1), (1, 2, 2), (1, 3, 2), (4, 1, 7)]
    assert bm25.search(bm25.build_index(no_docs), asked).collect() == []
    assert bm25.search(index, asked.where("false")).collect() == []


def test_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in vectors.collect()}
    ids, matrix = np.array(list(rows)), np.stack(list(rows.values()))
    got = {}
    for r in Q.QUERIES["op10_nearest_neighbours"](spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in rows if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(s == pytest.approx(float(rows[q] @ rows[v]), abs=1e-12) for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        score = matrix @ rows[q]
        score[ids == q] = -np.inf
        hits += len({v for _, v, _ in found} & set(ids[np.lexsort((ids, -score))[:20]]))
    assert hits >= 0.9 * 20 * len(got)


def test_neighbours_small(spark):
    """All candidates if fewer than k; several shards and blocks; ties, and vectors that take no part."""
    bad = [(100, None), (120, [0.0, 0.0]), (140, [1.0, None]), (160, [float("nan"), 1.0]), (180, [float("inf"), 0.0])]
    good = [(i, [1.0, float(i % 3)]) for i in range(15)] + [(20, [2.0, 1.0]), (40, [1.0, 1.0, 1.0]), (3, [1.0, 0.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>")
    got = neighbours.search(df.withColumn("score", df["vec_id"]), candidates=1.0, shard_rows=4).collect()
    assert {r["query_id"] for r in got} == {0, 20}
    for q, v in ((0, [1.0, 0.0]), (20, [2.0, 1.0])):
        want = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == 2)
        assert [(r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [
            (i, -s) for s, i in want
        ]
    assert neighbours.search(df.where("false")).collect() == []


def test_forest_prefixes():
    """Candidates are what a scan of the prefixes gives, at the longest common length that suffices."""
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((300, 8)), rng.standard_normal((5, 8))
    largest = float(np.sqrt((x**2).sum(axis=1)).max())
    forest = neighbours.Forest(x, largest, trees=3)
    rest = np.sqrt(np.maximum(largest**2 - (x**2).sum(axis=1), 0))
    own, asked = forest._keys(np.c_[x, rest]), forest._keys(np.c_[q, np.zeros(5)])
    for wanted in (1, 20, 300):
        for i, got in enumerate(forest.candidates(q, wanted)):
            for depth in range(64, -1, -1):
                hit = np.zeros(300, bool)
                for t in range(3):
                    hit |= np.array([(int(a) ^ int(asked[i, t])) >> (64 - depth) == 0 for a in own[:, t]])
                if hit.sum() >= wanted:
                    break
            assert list(got) == list(np.flatnonzero(hit))


def test_query_reads_all_benchmark_multiples(spark):
    got = Q.QUERIES["op4_exact_top_k"](spark, SF).collect()
    assert {r["query_id"] for r in got} == {0, 20}
