import zlib

import numpy as np

from bookflow.llm import language
from bookflow.llm import queries as Q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = Q.QUERIES["op5_language_id"](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(truth) and len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_presence_is_a_gram_kernel():
    """Without collisions the kernel is the number of shared 1-, 2- and 3-grams."""
    texts = ["abcab", "xxabc", "ZZ", ""]
    grams = [{t.lower()[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts]
    held = language.presence(texts).astype(int)
    assert (held @ held.T).tolist() == [[len(a & b) for b in grams] for a in grams]


def test_fit_equals_plain_ridge():
    """With every text a landmark, the matrix gives kernel ridge regression on all of them."""
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcde" if i % 2 else "defgh"), 30)) for i in range(40)]
    langs = ["x" if i % 2 else "y" for i in range(40)]
    model = language.fit(texts, langs, landmarks=40, ridge=0.01)
    held = language.presence(texts).astype(float)
    held /= np.sqrt(held.sum(axis=1, keepdims=True))
    kernel = held @ held.T
    target = np.where(np.array(langs)[:, None] == np.array(["x", "y"]), 1.0, -1.0)
    want = kernel @ np.linalg.solve(kernel + 0.01 * 40 * np.eye(40), target)
    assert np.allclose(model.decide(texts), want, atol=1e-3)


def test_odd(spark, odd, no_docs):
    model = language.fit(["der die das und", "the and of that"] * 3, ["de", "en"] * 3)
    rows = language.predict(odd, model).collect()
    assert len(rows) == 11
    got = {r["doc_id"]: r for r in rows}
    assert {got[i]["lang_pred"] for i in (3, 4, 5)} == {"und"}
    assert got[6]["lang_pred"] in ("de", "en")
    assert language.predict(no_docs, model).collect() == []
    nothing = language.train(no_docs)
    assert {r["lang_pred"] for r in language.predict(odd, nothing).collect()} == {"und"}
