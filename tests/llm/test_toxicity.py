import random
import zlib

import numpy as np
import pytest

from bookflow.llm import queries as Q
from bookflow.llm import toxicity

SF1 = "/root/testdata/sf0.1"
MILD = ["table", "river", "green", "walk", "stone", "paper", "cloud", "bread"]
HARSH = ["vile", "vileness", "rotten", "rottenest"]


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF1}/labels.parquet").collect()}
    rows = Q.QUERIES["op3_toxicity"](spark, SF1).collect()
    assert len(rows) == spark.read.parquet(f"{SF1}/documents.parquet").count()
    assert all(r["held_out"] == held(r["doc_id"]) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    marked = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    hits = [p for y, p in marked if y]
    assert np.mean(hits) > 0.65  # 240 toxic documents to learn from; 0.98 on tables five times as large
    assert np.mean([p for y, p in marked if not y]) < 0.02


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(600):
        toxic = int(rng.random() < 0.4)
        words = rng.choices(MILD, k=rng.randint(5, 40)) + toxic * rng.choices(HARSH, k=4)
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame([*labels, (0, None), (None, 1), labels[0]], "doc_id long, toxic int"),
    )


def plain_counts(docs, labels):
    toxic, ordinary, contexts = {}, {}, {}
    marked = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}
    for r in docs.collect():
        fold = zlib.crc32(str(r["doc_id"]).encode()) % 5
        if fold in (2, 3, 4):
            words = r["text"].split()
            for before, word in zip([None, *words], words):
                side = toxic if marked[r["doc_id"]] else ordinary
                side[word] = side.get(word, 0) + 1
                contexts.setdefault(word, set()).add(before)
    return toxic, ordinary, contexts


def test_counts_and_probabilities(small):
    """Tables agree with counts by hand, and each class's probabilities of a stem's words add up."""
    docs, labels = small
    model = toxicity.train(docs, labels)
    toxic, ordinary, contexts = plain_counts(docs, labels)
    for word in {*MILD, *HARSH}:
        (i,), _ = toxicity.word_ids([word])
        at = toxicity.slot(np.array([i]))[0]
        assert list(model.words[:, at]) == [toxic.get(word, 0), ordinary.get(word, 0), len(contexts.get(word, ()))]
    ids, _ = toxicity.word_ids([" ".join(["vile", "river", "viletta"])])
    ratio = model.ratio(ids)
    assert ratio[0] > 2 > ratio[1] and ratio[2] > 1  # a word never seen goes by its stem


def test_scores(small, odd, no_docs):
    docs, labels = small
    model = toxicity.train(docs, labels)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}
    rows = toxicity.score(docs, model).collect()
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows if r["held_out"]]) > 0.97
    kept = {r["doc_id"] for r in toxicity.keep_clean(docs, model).collect()}
    assert kept == {r["doc_id"] for r in rows if not r["predicted"]}
    got = toxicity.score(odd, model).collect()
    assert len(got) == 11 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    assert toxicity.score(no_docs, model).collect() == []


def test_one_class(small, no_docs):
    docs, labels = small
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert {r["predicted"] for r in toxicity.score(docs, none).collect()} == {0}
    every = toxicity.train(docs, labels.where("toxic = 1"))
    assert {r["predicted"] for r in toxicity.score(docs, every).collect()} == {1}
    assert toxicity.train(no_docs, labels).score(["x"]) < 0.5
