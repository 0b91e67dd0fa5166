"""Operators against brute force on random small inputs, and plans against each other."""

import random
import re

import pytest
from pyspark.sql import functions as F

from bookflow.functions.arrays import value_counts
from bookflow.operators import glossary as G
from bookflow.operators import retrieval as R
from bookflow.operators.ordering import joined_parts, ordinal, running_total, tree_hash
from bookflow.operators.segments import pack_segments
from bookflow.operators.summaries import previous_summaries
from bookflow.operators.work import dedupe_work, latest_status
from bookflow.schemas import ATTEMPTS, CONTEXT_BANK, GLOSSARY

random.seed(7)


def words(n, alphabet="abcd", longest=6):
    return ["".join(random.choices(alphabet, k=random.randint(1, longest))) for _ in range(n)]


def test_packing_keeps_paragraphs_and_stays_within_the_limit(spark):
    texts = ["\n".join(words(random.randint(0, 30), "ab 漢", 25)) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for row in pack_segments(df, 20).collect():
        paragraphs = [p.strip() for p in texts[row.i].split("\n") if p.strip()]
        assert all(0 < len(p) <= 20 for p in row.pieces)
        # nothing lost, nothing reordered
        assert "".join("".join(row.pieces).split("\n")) == "".join(paragraphs)
        # greedy: the next piece's first paragraph never fitted into the piece before
        for left, right in zip(row.pieces, row.pieces[1:]):
            first = right.split("\n\n")[0]
            hard_cut = any(len(p) > 20 and (left in p or first in p) for p in paragraphs)
            assert hard_cut or len(left) + 2 + len(first) > 20


@pytest.mark.parametrize("bits", [1, 3, 14])
def test_positions_and_sums_of_a_hot_key(spark, bits):
    rows = [("hot" if i % 3 else f"k{i % 5}", i * i % 1009, i % 7) for i in range(1009)]
    rows = list({(k, o): (k, o, v) for k, o, v in rows}.values())
    df = spark.createDataFrame(rows, "k string, o long, v long")
    for got, weight in ((ordinal(df, ["k"], "o", "n", bits), 0),
                        (running_total(df, ["k"], "o", F.col("v"), "n", bits), 1)):
        for r in got.collect():
            before = [x for x in rows if x[0] == r.k and x[1] < r.o]
            assert r.n == (sum(x[2] for x in before) if weight else len(before))


def test_parts_join_to_the_whole(spark):
    df = spark.createDataFrame([("a", i, f"t{i}") for i in range(5)], "k string, o int, t string")
    parts = joined_parts(df, ["k"], "o", "t", "--").orderBy("o").collect()
    assert "".join(p.t for p in parts) == "--".join(f"t{i}" for i in range(5))


def test_tree_hash_depends_on_order_and_content_only(spark):
    def digest(rows, parts):
        df = spark.createDataFrame(rows, "k string, o int, h string").repartition(parts)
        return tree_hash(df, ["k"], "o", F.col("h"), "d", fan_out=4).first().d

    rows = [("a", i, f"h{i}") for i in range(50)]
    assert digest(rows, 1) == digest(rows[::-1], 5)
    swapped = [("a", {3: 4, 4: 3}.get(i, i), f"h{i}") for i in range(50)]
    assert digest(rows, 1) != digest(swapped, 1)


def test_value_counts(spark):
    arrays = [[random.choice("abc") for _ in range(random.randint(0, 9))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(arrays)), "i int, a array<string>")
    for least in (1, 3):
        for r in df.select("i", value_counts(F.col("a"), least).alias("c")).collect():
            a = arrays[r.i]
            want = {(v, a.count(v), a.index(v)) for v in set(a) if a.count(v) >= least}
            assert {tuple(x) for x in r.c} == want


def _glossary(spark):
    terms = []
    for i in range(40):
        alias = words(1, "abcd漢", 9) if i % 3 == 0 else []
        terms.append(("p", i, f"t{i}", words(1, "abcd漢", 9)[0], "x", alias, "", "term", "contains"))
    return terms, spark.createDataFrame(terms, GLOSSARY)


def test_matching_plans_equal_brute_force(spark):
    terms, glossary = _glossary(spark)
    texts = ["".join(words(20, "abcd漢 ", 9)) for _ in range(60)] + ["", "a"]
    segs = spark.createDataFrame(
        [(i, "p", t) for i, t in enumerate(texts)], "k int, project_id string, text string"
    )
    want = {
        (i, t[1]) for i, text in enumerate(texts) for t in terms
        if any(n in text for n in [t[3], *t[5]])
    }
    for small in (True, False):
        found = G.match_terms(segs, glossary, ["k"], small=small)
        rows = [(r.k, r.term_idx) for r in found.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
        for limit in (0, 1, 3):
            for r in G.attach_terms(segs, glossary, ["k"], limit, small=small).collect():
                mine = sorted(t for k, t in want if k == r.k)[:limit]
                assert [m.term_idx for m in r.matched] == mine


def test_scoring_plans_equal_brute_force(spark):
    items = [(f"T{i}" if i % 2 else "", " ".join(words(12, "abc", 5)) + " " + "ab" * (i % 3 * 12))
             for i in range(25)]
    bank = spark.createDataFrame(
        [("p", i, str(i), t, x) for i, (t, x) in enumerate(items)], CONTEXT_BANK
    )
    texts = [" ".join(words(10, "abcé", 5)) + (" " + "ab" * 14 if i % 4 == 0 else "") for i in range(40)]
    texts.append("..")
    segs = spark.createDataFrame(
        [(i, "p", t) for i, t in enumerate(texts)], "k int, project_id string, text string"
    )
    want = {}
    for k, text in enumerate(texts):
        tokens = set(re.findall(r"[a-z0-9_]{2,}", text.lower()))
        for i, (t, x) in enumerate(items):
            score = sum(min(6, len(w)) for w in tokens if w in f"{t}\n{x}".lower())
            if score:
                want[k, i] = score
    for small in (True, False):
        scored = R.score_context(segs, bank, ["k"], small=small)
        assert {(r.k, r.item_idx): r.score for r in scored.collect()} == want
    for block in (7, 1000):
        for r in R.attach_context(segs, bank, ["k"], 3, block=block).collect():
            best = sorted(((-s, i) for (k, i), s in want.items() if k == r.k))[:3]
            assert [(x.item_idx, x.score) for x in r.retrieved or []] == [(i, -s) for s, i in best]


def test_previous_summaries_skip_chapters_without_one(spark):
    chapters = [("p", i) for i in range(0, 40)]
    have = [i for i in range(40) if i % 4 in (1, 2)]
    df = spark.createDataFrame(chapters, "project_id string, chapter_index int")
    summaries = spark.createDataFrame(
        [("p", i, f"t{i}", f"s{i}") for i in have],
        "project_id string, chapter_index int, title string, summary string",
    )
    got = {r.chapter_index: r.previous for r in previous_summaries(df, summaries).collect()}
    for i in range(40):
        before = [f"t{j}：s{j}" for j in have if j < i][-3:]
        assert got.get(i, "") == "\n".join(before)


def test_copies_share_one_representative(spark):
    rows = [("j", f"s{i}", i, 1, "same" if i % 3 else f"f{i}") for i in range(90)]
    df = spark.createDataFrame(
        rows, "job_id string, segment_id string, chapter_index int, segment_index int, fingerprint string"
    )
    first, rest = dedupe_work(df)
    assert first.count() == 31 and rest.count() == 59
    assert first.filter("fingerprint = 'same'").first().segment_id == "s1"


def test_latest_status_ignores_arrival_order(spark):
    from datetime import datetime

    rows = [("j", "s", n, st, None, datetime(2024, 1, 1, 0, m)) for n, st, m in
            [(1, "failed", 1), (2, "running", 2), (3, "completed", 2)]]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, ATTEMPTS).repartition(3)
        assert latest_status(df).first().status == "completed"


def test_anchors_are_the_rarest_pieces(spark):
    """A glossary whose terms share their beginning has few candidates beside its matches."""
    from bookflow.operators.matching import anchor_candidates, contains_pairs

    words = [f"{a}{b}{c}q" for a in "abcdefgh" for b in "ijklmn" for c in "opqrstuv"]
    needles = spark.createDataFrame([("p", i, f"the great {w}") for i, w in enumerate(words[:300])], "on string, n int, needle string")
    texts = [("p", i, f"here is the great {words[i]} and the great {words[-i - 1]} too") for i in range(100)]
    texts += [("q", 200, "the great aioq of another project"), ("p", 201, ""), ("p", 202, None)]
    hay = spark.createDataFrame(texts, "on string, k int, text string")
    found = anchor_candidates(hay, ["k"], "text", needles, ["n", "needle"], "needle", ["on"]).count()
    rows = {(r.k, r.n) for r in contains_pairs(hay, ["k"], "text", needles, ["n"], "needle", ["on"]).collect()}
    want = {(k, n) for o, k, t in texts for n, w in enumerate(words[:300]) if o == "p" and f"the great {w}" in (t or "")}
    assert rows == want and len(want) >= 100
    assert found <= 2 * len(want)  # by their first pieces all 300 are candidates of each of 100 texts


@pytest.mark.parametrize("bits", [0, 2, 14])
def test_previous_summaries_cross_buckets(spark, bits):
    """Sparse and dense summaries, empty buckets, many chapters behind the last summary."""
    rng = random.Random(bits)
    chapters = [(b, c) for b, size in (("a", 60), ("b", 25), ("c", 3)) for c in range(size)]
    has = [(b, c) for b, c in chapters if (b == "a" and (c < 9 or c in (30, 31))) or (b == "b" and rng.random() < 0.4)]
    summaries = spark.createDataFrame([(b, c, f"t{c}", f"s{c}") for b, c in has], "project_id string, chapter_index int, title string, summary string")
    asked = spark.createDataFrame(chapters, "project_id string, chapter_index int")
    got = {(r.project_id, r.chapter_index): r.previous for r in previous_summaries(asked, summaries, bits=bits).collect()}
    want = {}
    for b, c in chapters:
        lines = [f"t{x}：s{x}" for y, x in has if y == b and x < c][-3:]
        if lines:
            want[b, c] = "\n".join(lines)
    assert got == want
