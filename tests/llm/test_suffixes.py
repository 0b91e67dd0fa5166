import hashlib
import random

import numpy as np
import pytest

from bookflow.llm import queries as Q
from bookflow.llm import suffixes

from tests.llm.conftest import LONG, SF


def plain(texts, size):
    """texts: {id: bytes} -> {id: removed mask}."""
    seen, out = set(), {}
    for i in sorted(texts):
        raw = texts[i]
        gone = np.zeros(len(raw), bool)
        for at in range(len(raw) - size + 1):
            w = raw[at : at + size]
            if w in seen:
                gone[at : at + size] = True
            seen.add(w)
        out[i] = gone
    return out


def check(rows, texts, size):
    assert len(rows) == len(texts)
    want = plain(texts, size)
    for r in rows:
        raw, gone = texts[r["doc_id"]], want[r["doc_id"]]
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(raw), gone.sum(), spans)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_query(spark, docs):
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    check(Q.QUERIES["op6_suffix_array_dedup"](spark, SF).collect(), texts, 100)


@pytest.mark.parametrize("group", [3, 4096])
def test_random(spark, group):
    """Short windows over few letters, periodic texts, and groups that are settled window by window."""
    rng = random.Random(group)
    texts = {}
    for i in range(60):
        parts = [texts[rng.randrange(i)][rng.randint(0, 30) :][: rng.randint(0, 60)] for _ in range(2) if i]
        parts.append("".join(rng.choices("abé", k=rng.randint(0, 50))))
        rng.shuffle(parts)
        texts[i] = "".join(parts)
    texts[60], texts[61], texts[62] = "ab" * 40, "a" * 90, texts[5]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = suffixes.remove_repeats(df, window=12, gram=4, group=group).collect()
    check(rows, {i: t.encode() for i, t in texts.items()}, 12)


@pytest.mark.parametrize("group", [2, 4096])
def test_repeated_rows(spark, group):
    """A document in several rows is no earlier text of its own; its passage recurs in other surroundings."""
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choices("abcdefgh", k=n))
    passage = letters(300)
    texts = {i: letters(150) + passage + letters(150) for i in (1, 2, 3)}
    rows = [(1, texts[1])] * 3 + [(2, texts[2])] + [(3, texts[3])] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffixes.remove_repeats(df, group=group).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 1, 2, 3, 3]
    assert {r["doc_id"]: r["n_removed"] for r in got}[1] == 0
    once = {tuple(r): r for r in got}
    check(list(once.values()), {i: t.encode() for i, t in texts.items()}, 100)


def test_sort():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 2, 400).astype(np.uint8)
    s = suffixes.Suffixes(data, 20)
    segment = np.sort(rng.integers(0, 6, 300))
    items = rng.integers(0, 380, 300)
    got = s.sort(items, segment)
    want = sorted(range(300), key=lambda i: (segment[i], data[items[i] : items[i] + 20].tobytes(), i))
    assert got.tolist() == want


def test_collisions_are_verified(monkeypatch):
    monkeypatch.setattr(suffixes.Suffixes, "common", lambda self, a, b: np.full(len(a), self.limit))
    s = suffixes.Suffixes(np.frombuffer(b"abcabdabc", np.uint8), 3)
    assert suffixes.repeats(s, np.array([0, 3, 6]), np.zeros(3, int)).tolist() == [False, False, True]


def test_odd(spark, odd, no_docs):
    rows = suffixes.remove_repeats(odd, with_text=True).collect()
    assert len(rows) == 11
    got = {r["doc_id"]: r for r in rows}
    assert got[None]["n_removed"] == 0 and got[3]["n_bytes"] == 0
    assert got[6]["n_bytes"] == len(LONG) and bytes(got[6]["kept"]).decode() == LONG[:27]
    assert suffixes.remove_repeats(no_docs).collect() == []
