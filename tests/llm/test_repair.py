import hashlib
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from bookflow.llm import queries as Q
from bookflow.llm import repair

from tests.llm.conftest import SF

NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_repair(rows):
    """rows: (turn, role, text) of one conversation -> the numbers, audit, repaired lines."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append(
            "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        )
        seen.add((role, text))
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(None)
    def best(i, state, inserts):
        """The least (cost, audit, lines) from row i on."""
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def add(cost, letter, line, then):
            if then is not None:
                ways.append((cost + then[0], letter + then[1], line + then[2]))

        if inserts < 3:
            for role in ("user", "assistant"):
                if role[0] in after[state]:
                    add(3, "I", (f"{role}:",), best(i, role[0], inserts + 1))
        if i < len(rows):
            _, role, text = rows[i]
            add(4, "D", (), best(i + 1, state, 0))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                if role[:1] in after[state]:
                    add(more, "K", (f"{role}:{text}",), best(i + 1, role[0], 0))
                for new in ("user", "assistant"):
                    if new[0] in after[state]:
                        add(3 + more, "R", (f"{new}:{text}",), best(i + 1, new[0], 0))
        return min(ways) if ways else None

    cost, audit, lines = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    kinds = Counter(faults)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{k: kinds[k] for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def plain(original, rows):
    by = {}
    for conv, *row in rows:
        by.setdefault(conv, []).append(tuple(row))
    return {c: plain_repair(by.get(c, [])) for c in {r[0] for r in original}}


def shown(df):
    rows = [r.asDict() for r in df.collect()]
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r.pop("conv_id"): r for r in rows}


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert shown(Q.QUERIES["op11_conversation_repair"](spark, SF)) == plain(rows, plain_damage(rows))


def made(seed, conversations, most):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for _ in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "u", "User"])
            text = rng.choice(["", " \n", "Yes.", "No", "Why?", "a ", "Go!\t", "one", "two", "x" * 50])
            rows.append((c, rng.choice([None, *range(most)]), role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("rows, partitions", [(512, 3), (3, 5), (1, 4)])
def test_random(spark, rows, partitions):
    """Conversations cut into chunks of few rows, over several range partitions."""
    data = made(rows, 60, 14)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = shown(repair.repair(spark.createDataFrame(data, SCHEMA), chunk_rows=rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert got == plain(data, data)


def test_ranks_are_the_order_of_audits():
    """Every node's rank orders the letters that its pointers spell."""
    rng = np.random.default_rng(5)
    sizes = np.array([1, 7, 30, 2, 19])
    n = int(sizes.sum())
    _, letter, to = repair.arcs(rng.integers(0, 4, n), rng.integers(0, 4, n), sizes)
    levels, rank = repair.doubled(letter, to)
    nodes, lengths = repair.spelled(levels, np.arange(n * 16))
    ends = np.cumsum(lengths)
    audits = [bytes(letter[nodes[e - k : e]].tolist()) for e, k in zip(ends, lengths, strict=True)]
    order = sorted(set(audits))
    assert rank[:-1].argsort(kind="stable").tolist() == np.array([order.index(a) for a in audits]).argsort(kind="stable").tolist()


def test_odd(spark):
    """Nulls, ties, repeated rows, a long text, no row left, clashing columns."""
    long = "lorem ipsum " * 100_000 + "."
    data = [
        (1, 0, "user", "Hi."),
        (1, 0, "user", "Hi."),
        (1, 0, "assistant", "Ho."),
        (1, None, None, None),
        (2, None, "system", None),
        (None, 3, "user", "What?"),
        (None, 9, "assistant", long),
        (3, 0, "tool", "One."),
        (4, 0, "", "One."),
    ] + [(5, 0, "user", "same.")] * 3000
    schema = f"{SCHEMA}, conv string, chunk string, n string, seen string, cost string, rank string, at string, body string"
    got = shown(repair.repair(spark.createDataFrame([(*r, *["x"] * 8) for r in data], schema)))
    want = plain([r for r in data if r[0] != 5], [(c, t, r or " ", x or " ") for c, t, r, x in data if c != 5])
    five = got.pop(5)
    assert got == want
    assert five["duplicate"] == 2999 and five["cost"] == 2999 * 4 + 3
    assert five["audit"] == "K" + "D" * 2999 + "I"
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair(repair.damage(empty)).collect() == []
    nothing = shown(repair.repair(empty, spark.createDataFrame([(7, 0, "user", "x")], SCHEMA)))
    assert nothing == plain([(7,)], [])


def test_damage(spark):
    data = made(11, 40, 12)
    got = sorted((tuple(r) for r in repair.damage(spark.createDataFrame(data, SCHEMA)).collect()), key=str)
    assert got == sorted(plain_damage(data), key=str)
