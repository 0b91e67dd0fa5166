import random
import re
from itertools import combinations

import pytest
import xxhash

from bookflow.llm import queries as Q
from bookflow.llm import simhash
from bookflow.llm.components import components

from tests.llm.conftest import SF


def plain_print(text, k=4):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [words[i : i + k] for i in range(len(words) - k + 1)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    """prints: (id, fingerprint) pairs -> id: smallest id reachable."""
    root = {i: i for i, _ in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in combinations(prints, 2):
        if (a ^ b).bit_count() <= radius:
            x, y = top(i), top(j)
            root[max(x, y)] = min(x, y)
    return {i: top(i) for i, _ in prints}


def test_query(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = [(i, plain_print(t)) for i, t in texts.items()]
    want = plain_components(prints, 4)
    got = {r["doc_id"]: r for r in Q.QUERIES["op7_simhash_near_dedup"](spark, SF).collect()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints}
    assert {i: r["component_id"] for i, r in got.items()} == want


@pytest.mark.parametrize("chunk", [2, 7, 2048])
def test_links_of_close_prints(spark, chunk):
    """Families of close fingerprints, in shards that are dealt over several chunks."""
    rng = random.Random(chunk)
    prints = {0, (1 << 64) - 1}
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(25):
            near = base
            for bit in rng.sample(range(64), rng.randint(0, 7)):
                near ^= 1 << bit
            prints.add(near)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), chunk=chunk)
    roots = {r["node"]: r["root"] for r in components(found).collect()}
    want = plain_components([(s, s & (1 << 64) - 1) for s in signed], 4)
    assert {s: roots.get(s, s) for s in signed} == want


def test_chain(spark):
    n = 300
    rows = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, 50)]
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert roots == {i: 0 for i in range(n + 1)} | {1000 + i: 1000 for i in range(50)}


def test_odd(odd, no_docs):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 11
    got = {r["doc_id"]: r for r in rows}
    assert {got[i]["fingerprint"] for i in (3, 4, 5)} == {"0" * 16}
    assert {got[i]["component_id"] for i in (3, 4, 5)} == {3}
    assert got[2]["component_id"] == 1 and got[2]["linked"]
    assert got[None]["component_id"] is None
    assert sorted((r["doc_id"] or -1) for r in simhash.keep_one(odd).collect()) == [-1, 1, 3, 6, 7, 8, 9]
    assert simhash.keep_one(odd).columns == odd.columns
    assert simhash.near_duplicates(no_docs).collect() == []
    assert simhash.keep_one(no_docs).collect() == []
