"""Repair of the structure of conversations: the cheapest edits and, of equally cheap ones, the least audit.

A conversation's rows are put in order by a range shuffle and cut into chunks of bounded size. A
chunk's edit graph has a node for each row, grammar state and state after the chunk; a cost DP from
the chunk's end leaves the optimal arcs. Nodes are then ranked by the first 1, 2, 4, ... letters of
their least audit: a node's rank at twice the length is the rank of its own rank and that of the node
which its pointer reaches, and pointers double. An edit's letter and the state fix the role that it
gives, so a node's optimal arcs differ in their letters. A chunk hands on its 4 x 4 costs and ranks
only; these are combined along the conversation, which tells every chunk where its path enters and
leaves, and doubled pointers spell that path. No task holds a conversation: the last step streams its
chunks in order, since one SHA-256 has to read them so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.llm.common import Batches, runs
from bookflow.session import materialize

#: A chunk has at most so many rows and, but for its last row, so many characters.
CHUNK_ROWS, CHUNK_CHARS = 512, 1 << 15
#: Characters that are written at once.
HELD_CHARS = 1 << 23
#: Rows whose graphs are worked on at once.
GRAPH_ROWS = 1 << 14
WHITE = " \t\n\x0b\x0c\r"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Grammar states: nothing yet, after system, after user, after assistant.
STATES = 4
#: The state, and by it the role, that a rerole or an insert leads to.
NEXT = np.array([2, 2, 3, 2])
#: The state after keeping a row whose role's initial is s, u, a or another; -1: not allowed.
KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
ROLE = {2: "user", 3: "assistant"}
DELETE_COST, REROLE_COST, INSERT_COST, TRUNCATED_COST = 4, 3, 3, 3
#: Inserts that end a conversation, by state.
TAIL = (0, 2, 1, 0)
FAR = 1 << 40
#: Letters in ASCII order; 0 is the end of an audit, DEAD a node that does not reach its exit.
LETTERS = np.frombuffer(b"\0DIKR", np.uint8)
DELETE, INSERT, KEEP, REROLE, DEAD = 1, 2, 3, 4, 5

NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
CHUNK = "chunk long, conv string, turns array<long>, roles array<string>, texts array<string>, faults array<byte>"
SUMMARY = (
    "chunk long, conv string, rows long, first_turn long, last_turn long, distinct long, first_role string, "
    "last_role string, illegal long, blank long, duplicate long, truncated long, costs array<long>, ranks array<long>"
)
PLAN = "chunk long, entry int, exit int, tail int, " + ", ".join(f"{c} long" for c in NUMBERS)
PART = "conv string, chunk long, audit string, body string, lines long, " + ", ".join(f"{c} long" for c in NUMBERS)
RESULT = "conv string, " + ", ".join(f"{c} long" for c in NUMBERS) + ", audit string, repaired_sha256 string"


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def damage(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """The four columns of ``turns`` with reproducible faults, by crc32 of ``conv:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 sets role user. Nulls
    of conversation and turn count as one space there; null roles and texts become one space.
    """
    blank = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), blank) for c in (conv_col, turn_col))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), blank) for c in (role_col, text_col))
    return (
        turns.select(
            conv_col,
            turn_col,
            F.when(kind == 4, "user").otherwise(role).alias(role_col),
            F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias(text_col),
            kind.alias("__kind"),
        )
        .where("__kind <> 0")
        .withColumn("__copy", F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .drop("__kind", "__copy")
    )


def _chunks(batches: Batches, rows: int) -> Batches:
    """Rows (conv, turn, role, text, n, seen) in order -> chunks; a row stands for n equal ones."""
    first = TaskContext.get().partitionId() << 32
    made, size, held = 0, 0, 0
    conv, last = None, None
    done: list[tuple] = []
    turns: list = []
    roles: list[str] = []
    texts: list[str] = []
    faults: list[int] = []

    def flush() -> None:
        nonlocal made, size, turns, roles, texts, faults
        if turns:
            done.append((first + made, last, turns, roles, texts, faults))
            made += 1
            size, turns, roles, texts, faults = 0, [], [], [], []

    def batch_of() -> pa.RecordBatch:
        schema = [pa.int64(), pa.string(), *(pa.list_(t) for t in (pa.int64(), pa.string(), pa.string(), pa.int8()))]
        cols = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema, strict=True)]
        return pa.RecordBatch.from_arrays(cols, names(CHUNK))

    for batch in batches:
        columns = (batch.column(i).to_pylist() for i in range(6))
        for conv, turn, role, text, n, seen in zip(*columns, strict=True):
            if conv != last:
                flush()
                last = conv
            whole = text.strip(WHITE)
            once = BLANK if not whole else DUPLICATE if seen else FINE if whole[-1] in ".!?" else TRUNCATED
            again = BLANK if not whole else DUPLICATE
            for i in range(n):
                if len(turns) == rows or size > CHUNK_CHARS:
                    flush()
                turns.append(turn)
                roles.append(role)
                texts.append(text)
                faults.append(again if i else once)
                size += len(text)
                held += len(text) + 64
                if held > HELD_CHARS and len(done) > 1:
                    yield batch_of()
                    done, held = [], size
    flush()
    if done:
        yield batch_of()


def arcs(initial: np.ndarray, fault: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs (chunk, entry, exit) and of every node (row, state, exit) its least letter and where that leads.

    Nodes are numbered in that order; the number after the last is the end. Chunks' rows follow each
    other. What may follow a chunk's last row belongs to the next chunk.
    """
    ends = np.cumsum(sizes)
    n = int(ends[-1])
    end = n * 16
    cost = np.where(np.eye(STATES, dtype=bool), 0, FAR)[None].repeat(len(sizes), 0)
    letter = np.zeros((n, STATES, STATES), np.int64)
    to = np.zeros((n, STATES, STATES), np.int64)
    place = np.arange(STATES)
    node = place[:, None] * STATES + place[None]
    rerole = NEXT[:, None] * STATES + place[None]
    order = np.argsort(-sizes, kind="stable")
    alive = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")
    for t, m in enumerate(alive.tolist()):
        live = order[:m]
        row = ends[live] - 1 - t
        after, f = cost[live], fault[row]
        movable = ((f == FINE) | (f == TRUNCATED))[:, None, None]
        extra = np.where(f == TRUNCATED, TRUNCATED_COST, 0)[:, None, None]
        state = KEPT[:, initial[row]].T
        kept = np.take_along_axis(after, np.maximum(state, 0)[:, :, None], 1) + extra
        keep = np.where((state >= 0)[:, :, None] & movable, kept, FAR)
        move = np.where(movable, after[:, NEXT] + (REROLE_COST + extra), FAR)
        here = np.minimum(np.minimum(after + DELETE_COST, keep), move)
        once = here[:, NEXT]
        best = np.minimum(np.minimum(here, once + INSERT_COST), once[:, NEXT] + 2 * INSERT_COST)
        best = np.minimum(best, FAR)
        choice = [after + DELETE_COST == best, best[:, NEXT] + INSERT_COST == best, keep == best]
        found = np.select([best >= FAR, *choice], [DEAD, DELETE, INSERT, KEEP], REROLE)
        onward = end if t == 0 else (row[:, None, None] + 1) * 16
        kept_node = onward if t == 0 else onward + np.maximum(state, 0)[:, :, None] * STATES + place
        goes = [onward if t == 0 else onward + node, row[:, None, None] * 16 + rerole, kept_node]
        there = onward if t == 0 else onward + rerole
        to[row] = np.select([found == DEAD, found == DELETE, found == INSERT, found == KEEP], [end, *goes], there)
        letter[row] = found
        cost[live] = best
    return cost, letter.ravel(), to.ravel()


def doubled(letter: np.ndarray, to: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Pointers over 1, 2, 4, ... letters and the nodes' ranks by their whole least audits."""
    end = len(letter)
    pointer, rank = np.r_[to, end], np.r_[letter, 0]
    levels = [pointer]
    while (pointer != end).any():
        rank = np.unique(rank * (end + 1) + rank[pointer], return_inverse=True)[1].reshape(-1)
        pointer = pointer[pointer]
        levels.append(pointer)
    return levels, rank


def spelled(levels: list[np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes on the paths from ``starts``, one path after another, and the paths' lengths."""
    end = len(levels[0]) - 1
    at, size = starts.copy(), np.zeros(len(starts), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        there = levels[k][at]
        size += np.where(there != end, 1 << k, 0)
        at = np.where(there != end, there, at)
    size += starts != end
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    nodes = np.repeat(starts, size)
    for k, pointer in enumerate(levels):
        nodes = np.where(place >> k & 1, pointer[nodes], nodes)
    return nodes, size


def _initials(roles: pa.Array) -> np.ndarray:
    kinds = {"s": 0, "u": 1, "a": 2}
    return np.array([kinds.get(r[:1], 3) for r in roles.to_pylist()], np.int64)


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All elements of a list column and the number in each row."""
    sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
    return column.flatten(), sizes


def _pieces(batches: Batches, column: str) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has about GRAPH_ROWS elements in its list column."""
    for batch in batches:
        ends = np.cumsum(_lists(batch.column(column))[1])
        at = 0
        while at < batch.num_rows:
            past = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, past + GRAPH_ROWS, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _summaries(batches: Batches) -> Batches:
    for batch in _pieces(batches, "roles"):
        roles, sizes = _lists(batch.column("roles"))
        initial, fault = _initials(roles), _lists(batch.column("faults"))[0].to_numpy()
        cost, letter, to = arcs(initial, fault, sizes)
        rank = doubled(letter, to)[1]
        starts = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(sizes)), sizes)
        legal = np.isin(initial[:-1] * 4 + initial[1:], (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))
        bad = np.bincount(of[1:][(of[1:] == of[:-1]) & ~legal], minlength=len(sizes))
        faults = [np.bincount(of[fault == k], minlength=len(sizes)) for k in (BLANK, DUPLICATE, TRUNCATED)]
        turns, names_ = batch.column("turns").to_pylist(), roles.to_pylist()
        known = [[t for t in row if t is not None] for row in turns]
        cols = [
            batch.column("chunk"),
            batch.column("conv"),
            pa.array(sizes),
            pa.array([row[0] if row else None for row in known], pa.int64()),
            pa.array([row[-1] if row else None for row in known], pa.int64()),
            pa.array([len(set(row)) for row in known], pa.int64()),
            pa.array([names_[s][:1] for s in starts], pa.string()),
            pa.array([names_[s + n - 1][:1] for s, n in zip(starts, sizes, strict=True)], pa.string()),
            *[pa.array(x) for x in (bad, *faults)],
            pa.array(list(cost.reshape(len(sizes), 16)), pa.list_(pa.int64())),
            pa.array(list(rank[(starts * 16)[:, None] + np.arange(16)]), pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(cols, names(SUMMARY))


def _routes(parts: list[dict]) -> tuple[int, list[tuple[int, int]]]:
    """Least cost of one conversation and where the least cheapest path enters and leaves its chunks."""
    after = [[INSERT_COST * x for x in TAIL]]
    for p in reversed(parts):
        costs, then = p["costs"], after[-1]
        after.append([min(costs[s * 4 + q] + then[q] for q in range(4)) for s in range(4)])
    after.reverse()
    route, s = [], 0
    for p, here, then in zip(parts, after, after[1:], strict=False):
        ways = [(p["ranks"][s * 4 + q], q) for q in range(4) if p["costs"][s * 4 + q] + then[q] == here[s]]
        route.append((s, min(ways)[1]))
        s = route[-1][1]
    return after[0][0], route


def _plans(batches: Batches) -> Batches:
    for table in runs(batches, "conv"):
        out = []
        group: list[dict] = []
        for row in table.to_pylist():
            if group and row["conv"] != group[0]["conv"]:
                out += _plan(group)
                group = []
            group.append(row)
        out += _plan(group)
        cols = list(zip(*out, strict=True))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * len(NUMBERS)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names(PLAN))


def _plan(parts: list[dict]) -> list[tuple]:
    cost, route = _routes(parts)
    known = [p for p in parts if p["distinct"]]
    distinct = sum(p["distinct"] for p in known)
    distinct -= sum(a["last_turn"] == b["first_turn"] for a, b in zip(known, known[1:], strict=False))
    gaps = known[-1]["last_turn"] - known[0]["first_turn"] + 1 - distinct if known else 0
    met = [a["last_role"] + b["first_role"] for a, b in zip(parts, parts[1:], strict=False)]
    illegal = sum(p["illegal"] for p in parts) + sum(x not in ("su", "ua", "au") for x in met)
    numbers = (gaps, *(sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated")), illegal, cost)
    tails = [0] * (len(parts) - 1) + [TAIL[route[-1][1]]]
    return [(p["chunk"], *way, tail, *numbers) for p, way, tail in zip(parts, route, tails, strict=True)]


def _parts(batches: Batches) -> Batches:
    """The audit and the repaired lines of every chunk along its path."""
    for batch in _pieces(batches, "roles"):
        role_list, sizes = _lists(batch.column("roles"))
        fault = _lists(batch.column("faults"))[0].to_numpy()
        _, letter, to = arcs(_initials(role_list), fault, sizes)
        levels, _ = doubled(letter, to)
        starts = (np.cumsum(sizes) - sizes) * 16
        entry, leave = (batch.column(c).to_numpy().astype(np.int64) for c in ("entry", "exit"))
        nodes, lengths = spelled(levels, starts + entry * 4 + leave)
        letters = letter[nodes]
        audit = LETTERS[letters].tobytes().decode("ascii")
        given = NEXT[nodes // 4 % 4].tolist()
        roles, texts = role_list.to_pylist(), _lists(batch.column("texts"))[0].to_pylist()
        row, kind = (nodes // 16).tolist(), letters.tolist()
        audits, bodies, counts = [], [], []
        ends = np.cumsum(lengths).tolist()
        for e, size, q, tail in zip(ends, lengths.tolist(), leave.tolist(), batch.column("tail").to_pylist(), strict=True):
            lines = []
            for j in range(e - size, e):
                if kind[j] == KEEP:
                    lines.append(f"{roles[row[j]]}:{texts[row[j]]}")
                elif kind[j] == REROLE:
                    lines.append(f"{ROLE[given[j]]}:{texts[row[j]]}")
                elif kind[j] == INSERT:
                    lines.append(f"{ROLE[given[j]]}:")
            lines += [f"{ROLE[x]}:" for x in (2, 3)[2 - tail :]]
            audits.append(audit[e - size : e] + "I" * tail)
            bodies.append("\n".join(lines))
            counts.append(len(lines))
        cols = [batch.column("conv"), batch.column("chunk"), pa.array(audits, pa.string()), pa.array(bodies, pa.string())]
        cols += [pa.array(counts, pa.int64()), *(batch.column(c) for c in NUMBERS)]
        yield pa.RecordBatch.from_arrays(cols, names(PART))


def _joined(batches: Batches) -> Batches:
    """Chunks in order -> one row for each conversation; texts are hashed as they pass."""
    conv, numbers, audit, some, sha = None, (), [], False, hashlib.sha256()
    kinds = [pa.string(), *[pa.int64()] * len(NUMBERS), pa.string(), pa.string()]
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["conv"] != conv:
                if conv is not None:
                    out.append((conv, *numbers, "".join(audit), sha.hexdigest()))
                conv, audit, some, sha = row["conv"], [], False, hashlib.sha256()
                numbers = tuple(row[c] for c in NUMBERS)
            audit.append(row["audit"])
            if row["lines"]:
                sha.update((f"\n{row['body']}" if some else row["body"]).encode())
                some = True
        if out:
            cols = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names(RESULT))
    if conv is not None:
        last = (conv, *numbers, "".join(audit), sha.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(last, kinds, strict=True)], names(RESULT))


def repair(
    turns: DataFrame,
    conversations: DataFrame | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """(conversation, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    One row for every conversation of ``conversations`` (default: ``turns``); one without rows in
    ``turns`` has zeros, an empty audit and the hash of nothing. Rows are taken by turn, nulls first;
    rows of one turn by role, then text. Null roles and texts count as one space, all rows without a
    conversation as one conversation. Repeated rows are duplicates but for the first. Texts of any
    length are read whole. Other columns are left out, whatever their names. No rows: no rows.

    Keeping a row whose role's initial fits costs 0, giving it role user or assistant 3, deleting it
    4, an empty row of either role 3; blank and duplicate rows are deleted, a truncated one that stays
    costs 3 more. The initials of the result's roles are ``(s?(ua)+)?``. ``audit`` spells the edits
    (Keep, Rerole, Delete, Insert), ``repaired_sha256`` is of the lines ``role:text``.
    """
    blank = F.lit(" ")
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    own = turns.select(
        F.coalesce(F.col(conv_col).cast("string"), blank).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), blank).alias("role"),
        F.coalesce(F.col(text_col), blank).alias("text"),
    )
    rows = own.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n"))
    body = F.concat_ws(":", F.length("conv").cast("string"), "conv", F.length("role").cast("string"), "role", "text")
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    keyed = materialize(rows.withColumn("body", F.sha2(body, 256)).withColumn("at", at), "turns")
    firsts = keyed.groupBy("body").agg(F.min("at").alias("least"))
    seen = keyed.join(firsts, "body").select("conv", "turn", "role", "text", "n", (F.col("at") > F.col("least")).alias("seen"))
    dealt = seen.repartitionByRange("conv", order[1], "role", F.substring("text", 1, 32))
    chunks = materialize(dealt.sortWithinPartitions(*order).mapInArrow(lambda b: _chunks(b, chunk_rows), CHUNK), "chunks")
    summary = chunks.select("chunk", "conv", "turns", "roles", "faults").mapInArrow(_summaries, SUMMARY)
    plans = summary.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(_plans, PLAN)
    parts = chunks.join(materialize(plans, "plans"), "chunk").mapInArrow(_parts, PART)
    found = parts.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(_joined, RESULT)
    every = (turns if conversations is None else conversations).select(F.col(conv_col).alias("__id")).distinct()
    every = every.withColumn("conv", F.coalesce(F.col("__id").cast("string"), blank))
    whole = every.join(found, "conv", "left")
    return whole.select(
        F.col("__id").alias(conv_col),
        *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in NUMBERS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
