"""The pipeline from end to end, against what its stages say one by one."""

import zlib
from collections import defaultdict

import corpus_pipeline
from bookflow.llm import mixing, secrets, simhash, toxicity

#: Large enough for the toxicity model to reject documents.
SF = "/root/testdata/sf0.01"


def test_run(spark):
    """Every stage works on all that its predecessor kept, and its decisions take effect."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    first = docs.columns
    predicted = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "secrets", "mixing", "packing"]

    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == first and 0 < sum(predicted.values()) < len(predicted)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, p in predicted.items() if not p}

    single = stages["near_dedup"](spark, clean, SF)
    groups = defaultdict(list)
    for r in simhash.near_duplicates(clean).collect():
        groups[r["component_id"]].append(r["doc_id"])
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(min(g) for g in groups.values())

    safe = stages["secrets"](spark, single, SF)
    model = secrets.train(secrets.labelled(single))
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan(single, model).collect()}
    rows = safe.collect()
    assert safe.columns == first and {r["doc_id"] for r in rows} == set(before)
    for r in rows:
        assert (r["text"] == before[r["doc_id"]]) == (not spans[r["doc_id"]])
        assert r["n_chars"] == len(r["text"])

    mixed = stages["mixing"](spark, safe, SF)
    chosen = {r["doc_id"] for r in mixing.mix(safe).where("__sampled").collect()}
    assert mixed.columns == first and {r["doc_id"] for r in mixed.collect()} == chosen

    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in packed} == chosen
    taken = defaultdict(list)
    for r in packed:
        assert len(r["ids"]) == r["length"] <= 2048
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"])) == r["ids_crc32"]
        taken[r["sequence_id"]].append((r["offset"], r["length"]))
    for slots in taken.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 2048


def test_odd(spark, odd, no_docs):
    """Null, empty and repeated rows, a long text, clashing columns; and no rows at all."""
    for rows in (odd, no_docs):
        kept = rows
        for name, stage in corpus_pipeline.STAGES:
            ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
            out = stage(spark, kept, SF)
            if name != "packing":
                assert out.columns == rows.columns
            assert {r["doc_id"] for r in out.select("doc_id").collect()} <= ids
            kept = out
        if rows is no_docs:
            assert kept.count() == 0
