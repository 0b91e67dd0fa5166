"""Context bank: parsing, scoring against texts, the best items per text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookflow import constants as C
from bookflow.functions.arrays import explode_rows
from bookflow.functions.text import js_trim, non_empty, paragraphs, tokens
from bookflow.operators.matching import contains_pairs, fits
from bookflow.operators.ordering import joined_parts, running_totals
from bookflow.session import materialize

# Word runs up to this length are indexed by all their substrings; longer ones by anchors.
SHORT_RUN = 32
MAX_BANK_ROWS = 2000
MAX_BANK_BYTES = 512 * 1024
# Tokens that a scoring task takes out of an Arrow batch at a time.
SLICE_TOKENS = 1 << 17
# Each scoring function of a stage is a Python worker of its own in every task: so many to a stage.
CHAIN = 4


def parse_context_bank(raw: DataFrame) -> DataFrame:
    """``raw(project_id, context_bank)`` -> one item per block between blank lines."""
    blocks = F.filter(
        F.transform(F.split("context_bank", "\n{2,}"), js_trim), lambda b: b != ""
    )
    exploded = raw.select("project_id", F.posexplode(blocks).alias("pos", "block")).withColumn(
        "ls", paragraphs(F.col("block"))
    )
    titled = (F.size("ls") > 1) & (F.length(F.get("ls", F.lit(0))) <= 80)
    number = (F.col("pos") + 1).cast("string")
    body = F.array_join(F.when(titled, F.slice("ls", 2, F.size("ls"))).otherwise(F.col("ls")), "\n")
    return exploded.select(
        "project_id",
        F.col("pos").cast("int").alias("item_idx"),
        F.concat(F.lit("ctx-"), number).alias("id"),
        F.when(titled, F.get("ls", F.lit(0)))
        .otherwise(F.concat(F.lit("资料 "), number))
        .alias("title"),
        body.alias("text"),
    )


def serialize_context_bank(bank: DataFrame) -> DataFrame:
    """``project_id, item_idx, part``: parts that concatenate, in order, to the bank's text."""
    block = F.array_join(F.array(non_empty(F.col("title")), non_empty(F.col("text"))), "\n")
    blocks = bank.select("project_id", "item_idx", block.alias("part")).filter(F.col("part") != "")
    return joined_parts(blocks, ["project_id"], "item_idx", "part", "\n\n")


def _hay() -> Column:
    title, text = (F.coalesce(c, F.lit("")) for c in ("title", "text"))
    return F.lower(F.concat(title, F.lit("\n"), text))


def _runs() -> Column:
    return F.array_distinct(F.regexp_extract_all(_hay(), F.lit(C.TOKEN_PATTERN), F.lit(0)))


def _substrings(run: Column) -> Column:
    """All substrings of two or more characters."""
    return F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.length(run) - 1),
            lambda i: F.transform(
                F.sequence(F.lit(2), F.length(run) - i + 1), lambda n: F.substring(run, i, n)
            ),
        )
    )


def token_index(bank: DataFrame) -> DataFrame:
    """``project_id, token, item_idx`` for every token that occurs in a short word run.

    Tokens consist of word characters only, so an item contains a token exactly when one of its
    word runs does. That turns the containment test into an equi join on the token.
    """
    short = F.filter(_runs(), lambda r: F.length(r) <= SHORT_RUN)
    found = F.array_distinct(F.flatten(F.transform(short, _substrings)))
    return bank.select("project_id", "item_idx", F.explode(found).alias("token"))


def _long_run_index(bank: DataFrame, queries: DataFrame) -> DataFrame:
    runs = bank.select("project_id", "item_idx", F.explode(_runs()).alias("run")).filter(
        F.length("run") > SHORT_RUN
    )
    return contains_pairs(
        runs.select("project_id", "item_idx", F.xxhash64("run").alias("run_id"), "run"),
        ["project_id", "item_idx", "run_id"],
        "run",
        queries.select("project_id", "token").distinct(),
        ["token"],
        "token",
        ["project_id"],
    ).select("project_id", "item_idx", "token")


def scores_udf(bank_runs: dict[str, list[list[str]]], k: int | None) -> Callable[..., Column]:
    """Arrow UDF ``(group, tokens) -> struct<items, scores>``; ``bank_runs`` lists the word runs
    of each item of each group.

    A task indexes the substrings of the runs once. The distinct tokens of some rows are looked up
    once, as integers that their rows share, and a row adds up weights; no more than SLICE_TOKENS
    tokens are Python objects at a time. With ``k`` the best ``k`` come back in rank order, else all
    with a score.
    """

    def scorer(runs: list[list[str]]):
        index: dict[str, list[int]] = {}
        long_runs: list[tuple[int, str]] = []
        for item, words in enumerate(runs):
            parts = set()
            for w in words:
                if len(w) > SHORT_RUN:
                    long_runs.append((item, w))
                else:
                    parts.update(w[i:j] for i in range(len(w) - 1) for j in range(i + 2, len(w) + 1))
            for part in parts:
                index.setdefault(part, []).append(item)
        held = {part: np.array(items, np.int32) for part, items in index.items()}
        del index

        def holders(token: str) -> np.ndarray | None:
            short = held.get(token)
            if not long_runs:
                return short
            more = [item for item, run in long_runs if token in run]
            return short if not more else np.union1d(none if short is None else short, more).astype(np.int32)

        def score(found: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
            if not found:
                return none, none
            weights = np.repeat([w for _, w in found], [len(h) for h, _ in found])
            totals = np.bincount(np.concatenate([h for h, _ in found]), weights, len(runs))
            items = np.flatnonzero(totals)
            if k is not None and len(items) > k:
                low = np.partition(totals[items], -k)[-k]
                items = items[totals[items] >= low]  # with all that tie for the last place
            if k is not None:
                items = items[np.argsort(-totals[items], kind="stable")[:k]]
            return items, totals[items]

        return holders, score

    none = np.array([], np.int32)

    def scored(groups: pa.Array, tokens: pa.Array, scorers: dict) -> pa.Array:
        """One slice of rows."""
        words = tokens.flatten().dictionary_encode()  # a null array has no words
        ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
        codes, distinct = words.indices.to_numpy(zero_copy_only=False), words.dictionary.to_pylist()
        known: dict[str, list] = {}
        rows, start = [], 0
        for group, end in zip(groups.to_pylist(), ends.tolist(), strict=True):
            if group in scorers and end > start:
                holders, score = scorers[group]
                if group not in known:
                    known[group] = [None] * len(distinct)
                seen = known[group]
                found = []
                for code in codes[start:end].tolist():
                    entry = seen[code]
                    if entry is None:
                        held = holders(distinct[code])
                        entry = seen[code] = () if held is None else (held, min(6, len(distinct[code])))
                    if entry:
                        found.append(entry)
                rows.append(score(found))
            else:
                rows.append((none, none))
            start = end
        offsets = pa.array(np.cumsum([0, *(len(r[0]) for r in rows)]), pa.int32())
        items, scores = (np.concatenate([none, *(r[i] for r in rows)]) for i in (0, 1))
        return pa.StructArray.from_arrays(
            [
                pa.ListArray.from_arrays(offsets, pa.array(items.astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(scores.astype(np.int64))),
            ],
            ["items", "scores"],
        )

    @F.arrow_udf("items array<int>, scores array<bigint>")
    def scores(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        scorers = {group: scorer(runs) for group, runs in bank_runs.items()}
        for groups, tokens in batches:
            sizes = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
            start = 0
            while start < len(tokens):
                before = sizes[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(sizes, before + SLICE_TOKENS, side="right")))
                yield scored(groups.slice(start, end - start), tokens.slice(start, end - start), scorers)
                start = end

    return scores


def small_bank(bank: DataFrame) -> bool:
    """Whether the bank may be shipped to every task."""
    return fits(bank, ["title", "text"], MAX_BANK_ROWS, MAX_BANK_BYTES)


def _score_small(
    segs: DataFrame, bank: DataFrame, words: Column, k: int | None, fields: list[str]
) -> DataFrame:
    """``segs`` with ``scored``: an array of structs of the item's ``fields`` and its ``score``, in
    rank order for a ``k``, else in item order. ``words`` are a text's tokens. Nothing is shuffled and
    no pair leaves its row."""
    item = F.struct("item_idx", "title", F.col("text").alias("content"), _runs().alias("runs"))
    lists = bank.groupBy("project_id").agg(F.sort_array(F.collect_list(item)).alias("__items"))
    runs = {
        r["project_id"]: r["runs"]
        for r in lists.select("project_id", F.col("__items.runs").alias("runs")).collect()
    }
    shown = lists.select(
        "project_id",
        F.transform("__items", lambda it: F.struct(*[it[f] for f in fields])).alias("__items"),
    )
    joined = segs.join(F.broadcast(shown), "project_id", "left").withColumn(
        "__s", scores_udf(runs, k)("project_id", words)
    )

    def place(position: Column, score: Column) -> Column:
        it = F.get("__items", position)
        return F.struct(*[it[f] for f in fields], score.alias("score"))

    return joined.select(
        *segs.columns, F.zip_with("__s.items", "__s.scores", place).alias("scored")
    )


def score_context(
    segs: DataFrame, bank: DataFrame, keys: list[str], text: str = "text", small: bool | None = None
) -> DataFrame:
    """``keys, item_idx, score``: per item the sum of min(6, length) over contained tokens.

    A bank of checked size is scored inside each row; a larger one is joined by token. A text's
    items are those of its project, which the keys imply.
    """
    if small_bank(bank) if small is None else small:
        narrow = segs.select(*keys, "project_id", text)
        scored = _score_small(narrow, bank, tokens(F.col(text)), None, ["item_idx"]).select(*keys, "scored")
        return explode_rows(scored, "scored", item="p").select(*keys, "p.*")
    wordy = segs.select(*keys, "project_id", tokens(F.col(text)).alias("tokens"))
    queries = explode_rows(wordy, "tokens", item="token")
    index = token_index(bank)
    long_run = F.exists(_runs(), lambda r: F.length(r) > SHORT_RUN)
    if bank.filter(long_run).limit(1).count():
        index = index.unionByName(_long_run_index(bank, queries)).distinct()
    weight = F.least(F.lit(6), F.length("token")).cast("long")
    return (
        queries.join(index, ["project_id", "token"])
        .groupBy(*keys, "item_idx")
        .agg(F.sum(weight).alias("score"))
    )


def top_context(scored: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """The ``k`` best items of each text with their ``rank``; ties go to the earlier item."""
    order = W.partitionBy(*keys).orderBy(F.desc("score"), "item_idx")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bank_blocks(
    bank: DataFrame, rows: int = MAX_BANK_ROWS, size: int = MAX_BANK_BYTES
) -> list[tuple[Column, int, int]]:
    """Conditions that cut the bank into blocks of at most ``rows`` items and, but for one item, ``size`` bytes.

    With each condition come the items and the bytes of its block.

    Each project is cut along running sums; runs of items of several projects may share a block. Only
    the bounds of the runs come to the driver.
    """
    if fits(bank, ["title", "text"], rows, size):
        return [] if bank.isEmpty() else [(F.lit(True), rows, size)]
    width = F.octet_length(F.coalesce("title", F.lit(""))) + F.octet_length(F.coalesce("text", F.lit("")))
    narrow = bank.select("project_id", "item_idx", width.alias("__w"))
    summed = running_totals(
        narrow, ["project_id"], "item_idx", {"__b": F.col("__w"), "__r": F.lit(1)}
    )
    cut = F.floor(F.col("__b") / size) + F.floor(F.col("__r") / rows)
    runs = summed.groupBy("project_id", cut.alias("cut")).agg(
        F.min("item_idx").alias("low"), F.max("item_idx").alias("high"), F.count("*").alias("n"), F.sum("__w").alias("w")
    )
    cut_at = [
        (F.col("project_id").eqNullSafe(r["project_id"]) & F.col("item_idx").between(r["low"], r["high"]), r["n"], r["w"])
        for r in runs.orderBy("project_id", "low").toLocalIterator()
    ]
    return together(cut_at, rows, size)


def together(parts: list[tuple[Column, int, int]], rows: int, size: int) -> list[tuple[Column, int, int]]:
    """Neighbouring parts of the bank as one, as long as both bounds hold."""
    out: list[tuple[Column, int, int]] = []
    for own, n, w in parts:
        if out and out[-1][1] + n <= rows and out[-1][2] + w <= size:
            before, m, v = out.pop()
            own, n, w = before | own, m + n, v + w
        out.append((own, n, w))
    return out


def best_context(
    segs: DataFrame, bank: DataFrame, k: int, text: str = "text", fields: tuple[str, ...] = ("item_idx",),
    block: int = MAX_BANK_ROWS, size: int = MAX_BANK_BYTES,
) -> DataFrame:
    """Add ``retrieved``: the ``k`` best items (``fields`` and ``score``) in rank order, exactly.

    The bank is cut into blocks of at most ``block`` items and ``size`` bytes; neighbouring blocks that
    MAX_BANK_ROWS and MAX_BANK_BYTES hold are scored by one worker, since every scoring function costs a
    Python process per task. A text is cut into tokens once; each worker's best ``k`` are ranked and
    merged inside the row, so no pair of a text and an item ever leaves it. After CHAIN workers the rows
    are written, so a stage's processes do not grow with the bank.
    """
    kinds = {"item_idx": "int"}
    item = ",".join(f"{f}:{kinds.get(f, 'string')}" for f in fields)
    kind = f"array<struct<{item},score:bigint>>"
    out = segs.withColumns({"__words": tokens(F.col(text)), "retrieved": F.array().cast(kind)})
    blocks = together(bank_blocks(bank, block, size), MAX_BANK_ROWS, MAX_BANK_BYTES)
    for number, (part, _, _) in enumerate(blocks):
        if number and number % CHAIN == 0:
            out = materialize(out, f"best{number}")
        scored = _score_small(out, bank.filter(part), F.col("__words"), k, [*fields])
        best = F.coalesce("scored", F.array())
        if number:
            both = F.transform(
                F.concat("retrieved", best),
                lambda x: F.struct((-x["score"]).alias("o"), x["item_idx"].alias("i"), x.alias("x")),
            )
            best = F.transform(F.slice(F.array_sort(both), 1, k), lambda x: x["x"])
        out = scored.withColumn("retrieved", best).drop("scored")
    return out.drop("__words")


def attach_context(
    segs: DataFrame, bank: DataFrame, keys: list[str], k: int = 5, block: int = MAX_BANK_ROWS
) -> DataFrame:
    """Add ``retrieved``: the ``k`` best items in rank order."""
    return best_context(segs, bank, k, fields=("item_idx", "title", "content"), block=block)


def format_context(retrieved: Column) -> Column:
    """Prompt lines for retrieved items; '' for none."""
    line = F.transform(
        retrieved,
        lambda x: F.concat(
            F.lit("- "),
            F.coalesce(
                non_empty(x["title"]),
                F.concat(F.lit("资料 "), (x["item_idx"] + 1).cast("string")),
            ),
            F.lit("："),
            F.coalesce(x["content"], F.lit("")),
        ),
    )
    return F.coalesce(F.array_join(line, "\n"), F.lit(""))
