import random
import re
from itertools import combinations

import numpy as np
import pytest

from bookflow.llm import bbit
from bookflow.llm import queries as Q

from tests.llm.conftest import SF


def plain_set(text, k=3):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def plain_rows(docs, percent=85):
    """docs: (id, text) with different ids -> {id: (size, component, kept)}."""
    sets = [(i, plain_set(t)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = top(i), top(j)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), top(i), top(i) == i) for i, s in sets}


def shown(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_query(spark, docs):
    assert shown(Q.QUERIES["op12_bbit_minhash"](spark, SF)) == plain_rows([(r["doc_id"], r["text"]) for r in docs.collect()])


def families(seed, n):
    """Chains of texts, each a few words from the one before, around the threshold."""
    rng = random.Random(seed)
    docs = []
    for _ in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 30, 120, 400]))]
        for _ in range(rng.randint(1, 25)):
            words = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = f"w{rng.randrange(3000)}"
            docs.append(" ".join(words))
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("chunk", [2048, 3])
def test_families(spark, chunk):
    docs = families(chunk, 25)
    want = plain_rows(docs)
    got = bbit.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), chunk=chunk)
    assert shown(got) == want
    assert len({c for _, c, _ in want.values()}) < len(docs)


def test_group_of_unlike_members(spark):
    """All members share a bucket with a middle that is not theirs to link: only neighbours link."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    docs = []
    for i in range(60):
        words = list(base)
        for at in range(i, i + 5):
            words[at * 4 % 300] = f"x{at}"
        docs.append((i, " ".join(words)))
    assert shown(bbit.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == plain_rows(docs)


def test_estimate():
    """Estimates follow the exact similarity; signatures in columns and arrays agree by definition."""
    rng = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.85, 0.95):
        gaps = []
        for _ in range(30):
            both = rng.integers(0, 1 << 63, 400, np.uint64)
            n = round(400 * (1 - share) / share / 2)
            a, b = (np.unique(np.r_[both, rng.integers(0, 1 << 63, n, np.uint64)]) for _ in range(2))
            signs = bbit.packed(bbit.minima([a, b]))
            low = bbit.minima([a, b]) & 15
            agree = int(bbit.agreeing(signs[:1], signs[1:])[0, 0])
            assert agree == (low[0] == low[1]).sum()
            gaps.append(bbit.estimated(agree) - 400 / (400 + 2 * n))
        assert abs(np.mean(gaps)) < 0.03 and np.std(gaps) < 0.08
    assert 0.6 < bbit.least_estimate() < 0.75


def test_columns(spark):
    rng = np.random.default_rng(8)
    signs = rng.integers(-(1 << 63), (1 << 63) - 1, (2, 10), np.int64)
    signs[1, :5] = signs[0, :5]
    frame = spark.createDataFrame([tuple(x.tolist() for x in signs)], "a array<long>, b array<long>")
    got = frame.select(bbit.agreeing_columns(frame["a"], frame["b"])).first()[0]
    words = signs.view(np.uint64)
    assert got == bbit.agreeing(words[:1], words[1:])[0, 0]


def test_long_sets():
    """Minima of a set that is hashed in pieces are those of its pieces."""
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for n in (5, 3 * bbit.SHINGLES + 7, 0, 40)]
    alone = [bbit.minima([s])[0].tolist() for s in sets]
    assert bbit.minima(sets).tolist() == alone


def test_odd(spark, odd, no_docs):
    got = sorted((tuple(r) for r in bbit.near_duplicates(odd).collect()), key=str)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = plain_rows([r for r in dict(rows).items() if r[0] is not None])
    lost = len(plain_set(dict(rows)[None]))
    assert got == sorted([(i, *(want[i] if i is not None else (lost, None, True))) for i, _ in rows], key=str)
    assert want[2][1] == 1 and {want[i][1] for i in (3, 4, 5)} == {3, 4, 5}
    assert bbit.near_duplicates(no_docs).collect() == []
