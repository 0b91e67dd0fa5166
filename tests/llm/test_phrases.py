import hashlib
import random
import re

import pytest

from bookflow.llm import phrases
from bookflow.llm import queries as Q

from tests.llm.conftest import LONG, SF


def plain(texts, size):
    """texts: {id: text} -> {id: (words, removed flags)}."""
    seen, out = set(), {}
    for i in sorted(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[i] or "")
        gone = [False] * len(words)
        for at in range(len(words) - size + 1):
            w = tuple(words[at : at + size])
            if w in seen:
                gone[at : at + size] = [True] * size
            seen.add(w)
        out[i] = words, gone
    return out


def check(rows, texts):
    assert len(rows) == len(texts)
    want = plain(texts, phrases.WINDOW)
    for r in rows:
        words, gone = want[r["doc_id"]]
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        assert (r["n_words"], r["n_removed"]) == (len(words), sum(gone))
        assert r["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def test_query(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    check(Q.QUERIES["op8_phrase_automata_dedup"](spark, SF).collect(), texts)


@pytest.mark.parametrize("group", [2, 4096])
def test_random(spark, group):
    """Copied pieces, periodic texts, few words, and groups that are settled window by window."""
    rng = random.Random(group)
    texts = {}
    for i in range(80):
        parts = []
        if i:
            old = texts[rng.randrange(i)].split()
            at = rng.randint(0, 20)
            parts = [" ".join(old[at : at + rng.randint(0, 60)]) for _ in range(2)]
        parts.append(" \n".join(rng.choices(["a", "é", "the", " x"], k=rng.randint(0, 40))))
        rng.shuffle(parts)
        texts[i] = " ".join(parts)
    texts[80], texts[81], texts[82] = "ab " * 70, "ab\tcd " * 60, None
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(phrases.remove_passages(df, group=group).collect(), texts)


@pytest.mark.parametrize("group", [2, 4096])
def test_repeated_rows(spark, group):
    """A document in several rows is no earlier text of its own; its passage recurs in other surroundings."""
    rng = random.Random(9)
    words = lambda n: " ".join(rng.choices(["red", "blue", "sea", "hill", "oak", "fox"], k=n))
    passage = words(60)
    texts = {i: f"{words(30)} {passage} {words(30)}" for i in (1, 2, 3)}
    rows = [(1, texts[1])] * 3 + [(2, texts[2])] + [(3, texts[3])] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = phrases.remove_passages(df, group=group).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 1, 2, 3, 3]
    assert {r["doc_id"]: r["n_removed"] for r in got}[1] == 0
    once = {tuple(r): r for r in got}
    check(list(once.values()), texts)


def test_occurrences():
    machine = phrases.automaton({b"a b", b"b a"})
    assert phrases.occurrences(machine, b"a b a b aa b a".split()).tolist() == [0, 1, 2, 5]
    assert phrases.automaton(set()) is None


def test_odd(odd, no_docs):
    rows = phrases.remove_passages(odd, with_text=True).collect()
    assert len(rows) == 11
    got = {r["doc_id"]: r for r in rows}
    assert got[None]["n_removed"] == 0 and got[3]["n_words"] == 0
    assert got[6]["n_words"] == len(LONG.split()) and got[6]["kept"] == " ".join(LONG.split()[:5])
    assert phrases.remove_passages(no_docs).collect() == []
