from collections import defaultdict

import numpy as np
import pytest

from bookflow.llm import mixing
from bookflow.llm import queries as Q

from tests.llm.conftest import SF


def plain_rake(cells, targets):
    """cells {(s, l, t): tokens}; targets: one {value: share} per margin."""
    w = {k: 1.0 for k in cells}
    for _ in range(500):
        for axis, target in enumerate(targets):
            mass = defaultdict(float)
            for k, n in cells.items():
                mass[k[axis]] += n * w[k]
            for k in w:
                w[k] *= target.get(k[axis], 0) / mass[k[axis]] if mass[k[axis]] else 0
    return w


def power_targets(cells):
    out = []
    for axis, name in enumerate(("source", "lang", "topic")):
        mass = defaultdict(float)
        for k, n in cells.items():
            mass[k[axis]] += n
        shares = {v: n ** mixing.POWERS[name] for v, n in mass.items() if n}
        out.append({v: n / sum(shares.values()) for v, n in shares.items()})
    return out


def plain_filled(wanted, room, total):
    """Wanted amounts scaled to ``total`` within the room of each value."""
    low, high = 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(room[v], mid * wanted[v]) for v in room) < total else (low, mid)
    return {v: min(room[v], high * wanted[v]) for v in room}


def plain_calibration(cells, targets, budget):
    """Cells that would be drawn with a probability over 1 are taken; the rest is raked again."""
    cells, whole = {k: n for k, n in cells.items() if n}, set()
    chances = {k: budget * w for k, w in plain_rake(cells, targets).items()}
    while new := {k for k, p in chances.items() if p > 1 - 1e-9 and k not in whole}:
        whole |= new
        rest = {k: n for k, n in cells.items() if k not in whole}
        left = []
        for axis, target in enumerate(targets):
            had, room = defaultdict(float), defaultdict(float)
            for k, n in cells.items():
                (had if k in whole else room)[k[axis]] += n
            wanted = {v: max(0.0, budget * share - had[v]) for v, share in target.items()}
            left.append(plain_filled(wanted, room, budget - sum(cells[k] for k in whole)))
        chances = plain_rake(rest, left) | dict.fromkeys(whole, 1.0)
    return chances


def test_query(spark):
    rows = Q.QUERIES["op1_mix_sources"](spark, SF).collect()
    cells = defaultdict(int)
    for r in rows:
        cells[r["source"], r["lang"], r["topic"]] += r["n_tokens"]
    weights = plain_rake(cells, power_targets(cells))
    for r in rows:
        assert r["weight"] == pytest.approx(weights[r["source"], r["lang"], r["topic"]], rel=1e-5)
    total = sum(r["n_tokens"] for r in rows)
    assert sum(r["n_tokens"] * r["probability"] for r in rows) == pytest.approx(total / 2, rel=1e-4)
    assert all(0 <= r["probability"] <= 1 for r in rows)
    assert all(r["probability"] > 0 for r in rows if r["weight"])


def test_text_measures(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = mixing.mix(docs).select("text", "__tokens", "__topic").collect()
    for r in mixed:
        assert r["__tokens"] == len(r["text"].split())


def test_targets_are_met(spark):
    rng = np.random.default_rng(3)
    rows = [
        (s, lang, t, int(rng.integers(1, 10_000)))
        for s in map(str, range(40))
        for lang in ("en", "fr", "de")
        for t in ("a", "b")
        if rng.random() < 0.9
    ]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {"lang": {"en": 0.2, "fr": 0.8}, "topic": {"a": 0.6, "b": 0.4}}
    got = mixing.rake(cells, targets).collect()
    for name, want in targets.items():
        mass = defaultdict(float)
        for r in got:
            mass[r[name]] += r["tokens"] * r["weight"]
        for value, share in want.items():
            assert mass[value] == pytest.approx(share, abs=1e-6)
    assert all(r["weight"] == 0 for r in got if r["lang"] == "de")
    whole = mixing.calibrate(spark.createDataFrame(got), 1.0).collect()
    assert all(r["probability"] == (1.0 if r["weight"] else 0.0) for r in whole)


def test_calibration_equals_plain(spark):
    rng = np.random.default_rng(5)
    rows = [
        (f"s{s}", lang, t, int(rng.lognormal(6, 1.5)) + 1) for s in range(12) for lang in ("en", "fr", "de") for t in ("a", "b", "c")
    ]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    counts = {r[:3]: r[3] for r in rows}
    budget = sum(counts.values()) / 2
    mixed = mixing.calibrate(mixing.rake(cells))
    plain = plain_calibration(counts, power_targets(counts), budget)
    got = {(r["source"], r["lang"], r["topic"]): r["probability"] for r in mixed.collect()}
    assert sum(p > 1 - 1e-9 for p in got.values()) > 5
    for key, p in got.items():
        assert p == pytest.approx(plain[key], abs=2e-3)
    assert sum(counts[k] * p for k, p in got.items()) == pytest.approx(budget)
    for r in mixing.reached(mixed).collect():
        assert r["expected"] == pytest.approx(min(r["target"], r["tokens"] / budget), abs=1e-3)


def test_margins_after_whole_cells(spark):
    # rare pairs weigh most: (x, fr) is taken whole, and the other cells make up for what it lacks
    rows = [("x", "en", "a", 5000), ("x", "fr", "a", 10), ("y", "en", "a", 2000), ("y", "fr", "a", 9000), ("y", "fr", "b", 40)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {"source": {"x": 0.2, "y": 0.8}, "lang": {"en": 0.3, "fr": 0.7}, "topic": {"a": 0.5, "b": 0.5}}
    mixed = mixing.calibrate(mixing.rake(cells, targets), 0.4, targets)
    assert all(0 <= r["probability"] <= 1 for r in mixed.collect())
    got = {(r["margin"], r["value"]): (r["target"], r["expected"]) for r in mixing.reached(mixed, 0.4, targets).collect()}
    total = 16050 * 0.4
    # all 40 tokens of b are taken, and a gets the share that b cannot fill
    assert got["topic", "b"] == (0.5, pytest.approx(40 / total))
    assert got["topic", "a"] == (0.5, pytest.approx(1 - 40 / total))
    plain = plain_calibration({r[:3]: r[3] for r in rows}, [targets[n] for n in ("source", "lang", "topic")], total)
    for r in mixed.collect():
        assert r["probability"] == pytest.approx(plain[r["source"], r["lang"], r["topic"]], abs=1e-3)


def test_sampled_shares(spark):
    docs = spark.createDataFrame(
        [(i, "w " * (1 + i % 7), "fr" if i % 10 == 0 else "en", "rare" if i % 23 == 0 else "big", 5) for i in range(40_000)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    targets = {"source": {"rare": 0.05, "big": 0.95}, "lang": {"fr": 0.18, "en": 0.82}}
    taken = mixing.mix(docs, targets).where("__sampled").select("source", "lang", "__tokens").collect()
    total = sum(r["__tokens"] for r in taken)
    for name, want in targets.items():
        for value, share in want.items():
            assert sum(r["__tokens"] for r in taken if r[name] == value) / total == pytest.approx(share, abs=0.01)


def test_draws(spark):
    docs = spark.createDataFrame(
        [(i, "a b c", ("en", "fr")[i % 2], f"s{i % 3}", 5) for i in range(20_000)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    mixed = mixing.mix(docs, share=0.3)
    assert mixed.where("__sampled").count() == pytest.approx(6000, rel=0.05)
    again = mixing.mix(docs.repartition(7), share=0.3)
    assert mixed.where("__sampled").exceptAll(again.where("__sampled")).isEmpty()


def test_odd(odd, no_docs):
    mixed = mixing.mix(odd)
    assert mixed.count() == 11 and mixed.columns[: len(odd.columns)] == odd.columns
    assert mixing.mix(no_docs).collect() == []
    assert mixing.mix(no_docs.selectExpr("doc_id", "text", "lang", "source")).count() == 0
