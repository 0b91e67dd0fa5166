"""Mixing sources to target weights: raking of token weights, then calibrated sampling.

Documents are reduced to cells (source, language, topic) of token counts. Iterative proportional
fitting finds one factor per source, language and topic so that the weighted tokens of every margin
have their target share. Factors of sources stay in a table, as sources may be many; languages and
topics are few, so one job per sweep brings their cross table, never a cell, to the driver. A cell
cannot give more than all its tokens: cells that would are taken whole, and the others are raked
again to what is left of the margins.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.session import materialize

#: Bound of the distinct languages and of the distinct topics.
MAX_VALUES = 4096
SWEEPS = 200
TOLERANCE = 1e-9
#: When the cells that are not taken whole are raked again: largest sum of a margin's errors as a part of its
#: total, and sweeps at most; the next round goes on from there.
CALIBRATED = 2e-4
ROUND_SWEEPS = 12
#: Sweeps in which errors have to fall by a tenth for raking to go on.
PATIENCE = 4
#: Tolerance of a probability of 1.
WHOLE = 1e-9
#: Share of all tokens that a sample has.
SHARE = 0.5
#: Targets are token counts to these powers where none are given: below 1, small margins gain.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
SEED = 17

#: A document's topic is the first whose pattern is in its text.
TOPICS = (
    ("licence", r"(?i)\blicen[cs]ed?\b|all rights reserved|copyright"),
    ("contact", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]"),
    ("digits", r"[0-9]{4}"),
)
OTHER = "prose"


def topic_of(text: Column) -> Column:
    chain = F.lit(OTHER)
    for name, pattern in reversed(TOPICS):
        chain = F.when(text.rlike(pattern), name).otherwise(chain)
    return chain


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens), written once: what mixing needs of whole texts."""
    return materialize(
        docs.select("doc_id", "source", "lang", topic_of(_text()).alias("topic"), n_tokens(_text()).alias("n_tokens")),
        "measured",
    )


def _array(values: np.ndarray) -> Column:
    return F.split(F.lit(",".join(map(repr, map(float, values)))), ",").cast("array<double>")


def _margin(cells: DataFrame, name: str) -> dict[str, float]:
    rows = cells.groupBy(name).agg(F.sum("tokens").alias("n")).orderBy(name).limit(MAX_VALUES + 1).collect()
    if len(rows) > MAX_VALUES:
        raise ValueError(f"more than {MAX_VALUES} values of {name}")
    return {r[name]: float(r["n"]) for r in rows}


def _shares(totals: dict[str, float], power: float, given: dict[str, float] | None) -> np.ndarray:
    """Target share of each value; values without tokens, or that ``given`` leaves out, have none."""
    wanted = [(given.get(v, 0.0) if given else n**power) if n else 0.0 for v, n in totals.items()]
    return np.array(wanted) / (sum(wanted) or 1.0)


def _source_shares(cells: DataFrame, given: dict[str, float] | None) -> DataFrame:
    """(source, total, target): target shares of the sources that have tokens."""
    sources = cells.groupBy("source").agg(F.sum("tokens").cast("double").alias("total")).where("total > 0")
    if given:
        pairs = cells.sparkSession.createDataFrame(list(given.items()), "source string, target double")
        sources = sources.join(pairs, "source", "left").withColumn("target", F.coalesce("target", F.lit(0.0)))
    else:
        sources = sources.withColumn("target", F.pow("total", F.lit(POWERS["source"])))
    sources = materialize(sources, "sources")
    scale = sources.agg(F.sum("target")).first()[0] or 1.0
    return sources.withColumn("target", F.col("target") / F.lit(float(scale)))


def _place(name: str, values: list[str]) -> Column:
    """Index of the column ``name`` in ``values``."""
    indexes = F.array(*[F.lit(i) for i in range(len(values))])
    return F.element_at(F.map_from_arrays(F.array(*map(F.lit, values)), indexes), F.col(name))


class _Factors:
    """Factors of languages and topics, kept from one raking to the next as its start."""

    def __init__(self, langs: list[str], topics: list[str]):
        self.langs, self.topics = langs, topics
        self.b, self.c = np.ones(len(langs)), np.ones(len(topics))

    def raked(
        self, cells: DataFrame, wanted: DataFrame, want_l: np.ndarray, want_t: np.ndarray, again: bool = False
    ) -> DataFrame:
        """Add ``raked``, such that tokens times ``raked`` meet ``wanted`` (source, target), want_l and want_t.

        Sources are met exactly. ``again`` stops when the other errors are small or fall no more, as they
        do where the cells cannot meet all targets.
        """
        by_source = cells.groupBy("source").agg(
            F.collect_list(
                F.struct(
                    _place("lang", self.langs).alias("l"),
                    _place("topic", self.topics).alias("t"),
                    F.col("tokens").cast("double").alias("n"),
                )
            ).alias("cells")
        )
        by_source = materialize(by_source.join(wanted.select("source", "target"), "source"), "sources")

        def factor() -> Column:
            bs, cs = _array(self.b), _array(self.c)
            mass = F.aggregate(
                "cells", F.lit(0.0), lambda acc, x: acc + x["n"] * F.get(bs, x["l"]) * F.get(cs, x["t"])
            )
            return F.when(mass > 0, F.col("target") / mass).otherwise(0.0)

        errors: list[float] = []
        for _ in range(ROUND_SWEEPS if again else SWEEPS):
            table = np.zeros((len(self.b), len(self.c)))
            cross = by_source.select(factor().alias("a"), F.explode("cells").alias("x"))
            for r in cross.groupBy("x.l", "x.t").agg(F.sum(F.col("a") * F.col("x.n")).alias("n")).collect():
                table[r["l"], r["t"]] = r["n"]
            mass_l = table @ self.c
            off = [np.abs(self.b * mass_l - want_l).sum(), np.abs(self.c * (self.b @ table) - want_t).sum()]
            errors.append(max(off) / max(want_l.sum(), 1e-300))
            if again and (errors[-1] < CALIBRATED or len(errors) > PATIENCE and errors[-1] > 0.9 * errors[-PATIENCE - 1]):
                break
            new_b = np.divide(want_l, mass_l, out=np.zeros_like(self.b), where=mass_l > 0)
            mass_t = new_b @ table
            new_c = np.divide(want_t, mass_t, out=np.zeros_like(self.c), where=mass_t > 0)
            # a common factor may move between the margins: compare the products
            product = np.outer(new_b, new_c)
            moved = np.abs(product - np.outer(self.b, self.c)).max() / max(product.max(), 1e-300)
            self.b, self.c = new_b, new_c
            if not again and moved < TOLERANCE:
                break
        raked = (
            F.col("a")
            * F.get(_array(self.b), _place("lang", self.langs))
            * F.get(_array(self.c), _place("topic", self.topics))
        )
        joined = cells.join(by_source.select("source", factor().alias("a")), "source", "left")
        return joined.withColumn("raked", F.coalesce(raked, F.lit(0.0))).drop("a")


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Add ``weight`` per token to ``cells`` (source, lang, topic, tokens).

    ``targets`` may give shares per margin; missing margins follow POWERS. Weighted token shares meet
    the targets of the margin as far as the cells that exist allow; cells without tokens weigh 0.
    """
    targets = targets or {}
    langs, topics = _margin(cells, "lang"), _margin(cells, "topic")
    if not langs:
        return cells.withColumn("weight", F.lit(0.0))
    raked = _Factors(list(langs), list(topics)).raked(
        cells,
        _source_shares(cells, targets.get("source")),
        _shares(langs, POWERS["lang"], targets.get("lang")),
        _shares(topics, POWERS["topic"], targets.get("topic")),
    )
    return raked.withColumn("weight", F.when(F.col("tokens") > 0, F.col("raked")).otherwise(0.0)).drop("raked")


def _filled(wanted: np.ndarray, room: np.ndarray, total: float) -> np.ndarray:
    """``wanted`` scaled to ``total`` where no value gets more than its room."""
    wanted, out = np.where(room > 0, np.maximum(wanted, 0.0), 0.0), np.zeros_like(room)
    open_ = wanted > 0
    while open_.any():
        scaled = wanted * ((total - out[~open_].sum()) / wanted[open_].sum())
        full = open_ & (scaled >= room)
        if not full.any():
            return np.where(open_, scaled, out)
        out[full], open_ = room[full], open_ & ~full
    return out


def _scale(df: DataFrame, wanted: str, room: str, total: float) -> float:
    """k such that the sum of least(room, k wanted) is ``total``, of rows that want something.

    The sum grows with k: k is narrowed down, 32 values a job.
    """
    some = df.where((F.col(wanted) > 0) & (F.col(room) > 0))
    ratio = F.col(room) / F.col(wanted)
    reach, rooms, least, most = some.agg(F.sum(wanted), F.sum(room), F.min(ratio), F.max(ratio)).first()
    if not reach:
        return 0.0
    low, high = total / reach, float(most)
    if low <= least:  # all of them have room
        return low
    if total >= rooms or low >= high:
        return max(low, high)
    sum_at = lambda k: F.sum(F.least(F.col(room), F.lit(float(k)) * F.col(wanted)))
    for _ in range(4):
        grid = np.geomspace(low, high, 32)
        got = np.array(some.agg(*[sum_at(k).alias(f"k{i}") for i, k in enumerate(grid)]).first(), float)
        i = min(max(int(np.searchsorted(got, total)), 1), 31)
        low, high = float(grid[i - 1]), float(grid[i])
        if not low < high:
            return high
    if got[i] > got[i - 1]:
        return low + (high - low) * min(max((total - got[i - 1]) / (got[i] - got[i - 1]), 0.0), 1.0)
    return low


def calibrate(
    cells: DataFrame, share: float = SHARE, targets: dict[str, dict[str, float]] | None = None
) -> DataFrame:
    """Add ``probability``, such that expected tokens are ``share`` of all and margins meet their targets.

    Probabilities follow the weights. Cells that reach 1 are taken whole; the others are raked again
    to what is left of every margin, until no other cell reaches 1. A value whose tokens do not
    suffice is taken whole, and what it lacks goes to the other values in proportion. Where the cells
    that exist allow no sample that meets all margins, sources come first; ``reached`` tells what is
    met. Without enough weighted tokens every weighted cell is taken whole.
    """
    targets = targets or {}
    total, weighted = cells.agg(
        F.sum("tokens"), F.sum(F.when(F.col("weight") > 0, F.col("tokens")))
    ).first()
    if not weighted:
        return cells.withColumn("probability", F.lit(0.0))
    budget = float(share * total)
    if budget >= weighted:
        return cells.withColumn("probability", F.when(F.col("weight") > 0, 1.0).otherwise(0.0))
    langs, topics = _margin(cells, "lang"), _margin(cells, "topic")
    want_l = budget * _shares(langs, POWERS["lang"], targets.get("lang"))
    want_t = budget * _shares(topics, POWERS["topic"], targets.get("topic"))
    sources = _source_shares(cells, targets.get("source"))
    factors = _Factors(list(langs), list(topics))
    # weighted tokens add up to 1
    state = cells.withColumn("probability", F.lit(budget) * F.col("weight")).withColumn("whole", F.lit(False))
    while True:
        state = materialize(state.withColumn("now", F.col("whole") | (F.col("probability") > 1 - WHOLE)), "calibrated")
        fresh, taken = state.agg(
            F.count_if(F.col("now") & ~F.col("whole")), F.sum(F.when(F.col("now"), F.col("tokens")))
        ).first()
        if not fresh:
            return state.drop("whole", "now")
        left = budget - taken
        state = state.withColumn("whole", F.col("now")).drop("now")
        rest = state.where(~F.col("whole") & (F.col("weight") > 0)).drop("probability")
        kept = state.where("whole").withColumn("probability", F.lit(1.0))
        none = state.where(~F.col("whole") & (F.col("weight") <= 0)).withColumn("probability", F.lit(0.0))

        def taken_and_room(*names: str) -> DataFrame:
            open_tokens = F.when(~F.col("whole") & (F.col("weight") > 0), F.col("tokens"))
            return state.groupBy(*names).agg(
                F.coalesce(F.sum(F.when(F.col("whole"), F.col("tokens"))), F.lit(0)).cast("double").alias("had"),
                F.coalesce(F.sum(open_tokens), F.lit(0)).cast("double").alias("room"),
            )

        cross = taken_and_room("lang", "topic").collect()

        def remaining(name: str, values: list[str], want: np.ndarray) -> np.ndarray:
            had, room = np.zeros(len(values)), np.zeros(len(values))
            at = {v: i for i, v in enumerate(values)}
            for r in cross:
                had[at[r[name]]] += r["had"]
                room[at[r[name]]] += r["room"]
            return _filled(want - had, room, left)

        open_ = sources.join(taken_and_room("source"), "source").where("room > 0").select(
            "source", "room", F.greatest(F.lit(0.0), F.lit(budget) * F.col("target") - F.col("had")).alias("wanted")
        )
        open_ = materialize(open_, "open")
        k = _scale(open_, "wanted", "room", left)
        wanted = open_.withColumn("target", F.least(F.col("room"), F.lit(k) * F.col("wanted")))
        raked = factors.raked(
            rest,
            wanted,
            remaining("lang", factors.langs, want_l),
            remaining("topic", factors.topics, want_t),
            again=True,
        )
        state = kept.unionByName(none).unionByName(raked.withColumnRenamed("raked", "probability"))


def reached(cells: DataFrame, share: float = SHARE, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(margin, value, tokens, target, expected) of calibrated ``cells``: shares of the sample, wanted and expected.

    Where ``expected`` stays below ``target`` while ``tokens`` are more, the other margins forbid it.
    """
    targets = targets or {}
    total = cells.agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0] or 1.0
    rows = None
    for name in ("source", "lang", "topic"):
        some = cells.withColumnRenamed(name, "value").groupBy("value").agg(
            F.sum("tokens").alias("tokens"),
            (F.sum(F.col("tokens") * F.col("probability")) / F.lit(float(total))).alias("expected"),
        )
        if name == "source":
            want = _source_shares(cells, targets.get(name)).select(F.col("source").alias("value"), "target")
        else:
            values = _margin(cells, name)
            pairs = zip(values, map(float, _shares(values, POWERS[name], targets.get(name))))
            want = cells.sparkSession.createDataFrame(list(pairs), "value string, target double")
        part = some.join(want, "value", "left").select(
            F.lit(name).alias("margin"), "value", "tokens", F.coalesce("target", F.lit(0.0)).alias("target"), "expected"
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


def mix(
    docs: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    share: float = SHARE,
    topic_col: str | None = None,
    tokens_col: str | None = None,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with __topic, __tokens, __weight, __probability and __sampled.

    A null source, language or topic is a value of its own (''), a null text has no tokens, an empty
    table gives no rows. The draw is a hash of doc_id and seed, so a retried task draws the same and
    repeated rows are drawn together; a null doc_id draws like any other. ``topic_col`` and
    ``tokens_col`` name columns to use instead of what the text gives; with both no text is read.
    """
    keyed = docs.withColumns(
        {
            "__source": F.coalesce("source", F.lit("")),
            "__lang": F.coalesce("lang", F.lit("")),
            "__topic": F.coalesce(F.col(topic_col).cast("string"), F.lit("")) if topic_col else topic_of(_text()),
            "__tokens": F.coalesce(F.col(tokens_col), F.lit(0)).cast("long") if tokens_col else n_tokens(_text()),
        }
    )
    cells = keyed.groupBy(*[F.col(f"__{n}").alias(n) for n in ("source", "lang", "topic")]).agg(
        F.sum("__tokens").alias("tokens")
    )
    cells = materialize(cells, "cells")
    weighted = materialize(rake(cells, targets), "weights")
    known = materialize(calibrate(weighted, share, targets), "probabilities").select(
        *[F.col(n).alias(f"__{n}") for n in ("source", "lang", "topic", "weight", "probability")]
    )
    # a few cells are broadcast by their size on disk; many are joined by key, hot keys split by AQE
    placed = keyed.join(known, ["__source", "__lang", "__topic"])
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") / float(1 << 53)
    return placed.withColumn("__sampled", draw < F.col("__probability")).select(
        *docs.columns, "__topic", "__tokens", "__weight", "__probability", "__sampled"
    )
