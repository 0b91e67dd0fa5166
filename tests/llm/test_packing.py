import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark import cloudpickle
from tokenizers import Tokenizer

import corpus_pipeline
from bookflow.llm import common, packing
from bookflow.llm import queries as Q

from tests.llm.conftest import SF


def check(rows, texts, size):
    """Every token of every text is in exactly one gapless place."""
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = np.array([*encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want = [
            (i, at, len(ids[at : at + size]), zlib.crc32(ids[at : at + size].tobytes()))
            for i, at in enumerate(range(0, len(ids), size))
        ]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[doc]) == want
    for places in by_seq.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size


def test_query(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = Q.QUERIES["op9_best_fit_packing"](spark, SF).collect()
    check(rows, texts, 2048)
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= -(-total // 2048) * 1.02 + 1


def test_small_size_and_buckets(docs, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 50)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    check(packing.pack(docs, size=64).collect(), texts, 64)


def test_odd(odd, no_docs):
    rows = packing.pack(odd, with_ids=True).collect()
    assert sorted((r["doc_id"] or -1) for r in rows if r["piece"] == 0) == [-1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9]
    assert all(len(r["ids"]) == r["length"] for r in rows)
    assert {r["doc_id"] for r in rows if r["ids"] == [0]} == {3, 4, 5}
    assert packing.pack(no_docs).collect() == []


def test_pipeline_keeps_ids(spark, odd):
    """The last stage's rows hold the tokens of their texts; repeated rows and rows without an id too."""
    rows = corpus_pipeline.pack(spark, odd, SF).collect()
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    got, ids = defaultdict(list), defaultdict(list)
    for r in sorted(rows, key=lambda r: r["start"]):
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        got[r["doc_id"]].append(r["start"])
        ids[r["doc_id"]] += r["ids"]
    assert sorted(got[2]) == [0, 0] and got[None] == [0]
    for r in odd.collect():
        want = [*encode(r["text"] or "", add_special_tokens=False).ids, 0]
        assert ids[r["doc_id"]] == want * (2 if r["doc_id"] == 2 else 1)


def test_held_ids_are_handed_on(spark, odd, monkeypatch):
    """Pieces of one text may leave a worker in several batches."""
    want = sorted(map(str, packing.tokenize(odd, size=64, with_ids=True).collect()))
    monkeypatch.setattr(packing, "HELD_BYTES", 1000)
    monkeypatch.setattr(packing, "ROWS", 3)
    assert sorted(map(str, packing.tokenize(odd, size=64, with_ids=True).collect())) == want


def test_memos_of_other_operators_go():
    """Each task of a worker process gets its functions by value, with globals of its own."""
    packing_task, toxicity_task = (cloudpickle.loads(cloudpickle.dumps(common.only_memo)) for _ in range(2))
    words, ids = {b"word": b"1234"}, {"word": 1}
    packing_task("packing", words)
    packing_task("packing", words)
    assert words
    toxicity_task("toxicity", ids)
    assert ids and not words


class Counted:
    """A tokenizer that counts the calls of its ``encode``."""

    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, 0

    def encode(self, *args, **kwargs):
        self.calls += 1
        return self.tokenizer.encode(*args, **kwargs)


def test_words_are_cut_like_the_tokenizer_cuts_them(monkeypatch):
    words = packing._Words(public_tokenizers.path("word_bpe_49k.json"))
    words.tokenizer = counted = Counted(words.tokenizer)

    def same(text):
        want = np.array(counted.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return want == b"".join(map(words.__getitem__, text.encode().split()))

    plain = "Don't STOP!!'s x_y(z) 3,14 &&& rock'n'roll we'll \x00\x1f\x7f a|b Éclair&&& straße, (ÜBER) ЖЁЛТЫЙ... señor*** "
    assert same(plain.replace("(ÜBER)", "ÜBER)"))
    assert counted.calls == 0  # all of it is taken without the whole tokenizer
    odd = "<|endoftext|> a<|endoftext|>b. é<|startoftext|> <br> (ÜBER) ΣΑΣ ΟΔΟΣ, İ. İé e\u0301t\u0301. é\u0301, x\u0338 =\u0338 ²½ é² ǅ ʹ 語。 😀!"
    assert all(map(same, [odd, *odd.split()]))
    for c in map(chr, [*range(1, 0x600), *range(0x1E00, 0x2100)]):
        assert all(map(same, (c, f"a{c}", f"{c}a", f"É{c}.", f"é{c}é", f"Ab'{c}", f"{c}'s"))), hex(ord(c))
    monkeypatch.setattr(packing, "MEMO_WORDS", 0)
    words.clear()
    assert same(plain + odd) and not words


def naive(lengths, size):
    """Best-fit decreasing, one item at a time."""
    space = []
    for length in sorted(lengths, reverse=True):
        fits = [(s, i) for i, s in enumerate(space) if s >= length]
        if fits:
            space[min(fits)[1]] -= length
        else:
            space.append(size - length)
    return len(space)


@pytest.mark.parametrize("seed", range(20))
def test_plan(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 37, 100])
    lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 300))]
    hist = defaultdict(int)
    for n in lengths:
        hist[n] += 1
    place = defaultdict(list)
    for length, first, n, seq, offset in packing.plan(hist, size):
        assert first >= 0
        for i in range(n):
            place[seq + i].append((offset, length))
    assert sorted(n for p in place.values() for _, n in p) == sorted(lengths)
    assert sorted(place) == list(range(len(place)))
    for p in place.values():
        assert [o for o, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:i]) for i in range(len(p))]
        assert sum(n for _, n in p) <= size
    assert len(place) == naive(lengths, size)
