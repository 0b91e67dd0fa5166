"""Secret scan in DataFrame functions only: three base patterns, and character Markov models.

Two first-order Markov chains over the characters of key-like strings, one for random strings and
one for ordinary identifiers, are trained from labelled samples. A long run of such characters that
no base pattern covers is a secret if its log-likelihood ratio exceeds the prior odds. The tables are
68 x 68 at most, so they travel as a constant array in the plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Kinds in the order that breaks ties of position; "random" is what the models add.
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Runs that the models look at.
RUN = r"[A-Za-z0-9+/_=-]{16,}"
#: Odds of ordinary against random among such runs.
PRIOR_ODDS = 10_000
PSEUDO = 0.5
#: Weight of a chain's single characters behind its pairs.
BACKOFF = 10.0
#: Part of the random chain that is uniform: samples of one kind of key stand for all kinds.
UNIFORM = 0.2
PLACEHOLDER = "[SECRET]"

SPAN = "struct<start:int,kind:int,end:int,value:string>"


def _at(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Array of spans of the pattern's matches, leftmost and non-overlapping, in code points.

    Functions give the matches but not their places; the pieces between them do: a match starts
    where the pieces and matches before it end.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    lengths = F.zip_with(
        F.transform(F.split(text, pattern, -1), lambda gap: F.length(gap)),
        F.arrays_zip(hits.alias("hit"), values.alias("value")),
        lambda gap, m: F.struct(gap.alias("gap"), F.length(m["hit"]).alias("size"), m["value"].alias("value")),
    )
    empty = F.lit(None).cast(f"array<{SPAN}>")
    walked = F.aggregate(
        F.filter(lengths, lambda m: m["size"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.coalesce(empty, F.array().cast(f"array<{SPAN}>")).alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + m["gap"] + m["size"]).alias("at"),
            F.concat(
                acc["spans"],
                F.array(
                    F.struct(
                        (acc["at"] + m["gap"]).alias("start"),
                        F.lit(kind).alias("kind"),
                        (acc["at"] + m["gap"] + m["size"]).alias("end"),
                        m["value"].alias("value"),
                    )
                ),
            ).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds in one array."""
    assign = F.filter(_at(text, ASSIGN, 0, group=2), lambda s: F.length(s["value"]) >= ASSIGN_MIN)
    return F.concat(assign, _at(text, ACCESS, 1), _at(text, HEX, 2))


def _free_of(spans: Column, base: Column) -> Column:
    """Those of ``spans`` that overlap none of ``base``."""
    return F.filter(
        spans, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    )


def _steps(value: Column) -> Column:
    """Array of the transitions of a string: row * width + column of the table."""
    places = F.transform(
        F.filter(F.split(value, ""), lambda c: c != ""),
        lambda c: F.call_function("locate", c, F.lit(ALPHABET)) - 1,
    )
    # a one-element array keeps ``places`` from being worked out once per use
    return F.flatten(
        F.transform(
            F.array(places),
            lambda p: F.zip_with(
                F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))),
                F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))),
                lambda a, b: a * len(ALPHABET) + b,
            ),
        )
    )


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios of all transitions."""

    ratios: tuple[float, ...]
    odds: float = PRIOR_ODDS

    def is_random(self, value: Column) -> Column:
        table = F.split(F.lit(",".join(f"{r:.4f}" for r in self.ratios)), ",").cast("array<double>")
        total = F.aggregate(_steps(value), F.lit(0.0), lambda acc, s: acc + F.get(table, s))
        return total > math.log(self.odds)


def train(samples: DataFrame) -> Model:
    """Fit both chains on ``samples`` (value string, secret boolean).

    Characters outside the alphabet and null values or labels are left out. All samples count; at
    most two numbers per pair of characters reach the driver. A chain without samples
    is uniform.
    """
    pairs = (
        samples.where("value is not null and secret is not null")
        .select("secret", F.explode(_steps(F.regexp_replace("value", r"[^A-Za-z0-9+/_.=-]", ""))).alias("step"))
        .groupBy("step")
        .agg(F.count_if(F.col("secret")).alias("random"), F.count_if(~F.col("secret")).alias("ordinary"))
        .collect()
    )
    width = len(ALPHABET)
    counts = np.zeros((2, width, width))
    for r in pairs:
        counts[:, r["step"] // width, r["step"] % width] = r["random"], r["ordinary"]
    chains = []
    for own, uniform in zip(counts, (UNIFORM, 0.0), strict=True):
        single = own.sum(axis=0) + PSEUDO
        backoff = single / single.sum()
        p = (own + BACKOFF * backoff) / (own.sum(axis=1, keepdims=True) + BACKOFF)
        chains.append((1 - uniform) * p + uniform / width)
    ratios = np.log(chains[0] / chains[1]).ravel().tolist()
    return Model(tuple(ratios))


def labelled(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Samples out of whole texts: values that a base pattern caught, and the runs that none covers."""
    spans = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        base_spans(F.col("text")).alias("base"), _at(F.col("text"), RUN, 3).alias("runs")
    )
    known = F.transform("base", lambda s: F.struct(s["value"].alias("value"), F.lit(True).alias("secret")))
    other = F.transform(
        _free_of(F.col("runs"), F.col("base")),
        lambda s: F.struct(s["value"].alias("value"), F.lit(False).alias("secret")),
    )
    return spans.select(F.explode(F.concat(known, other)).alias("s")).select("s.value", "s.secret")


def _found(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """``docs`` with the columns __base and __spans, sorted; null texts count as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    runs = docs.withColumns({"__base": F.array_sort(base_spans(text)), "__runs": _at(text, RUN, 3)})
    added = F.filter(_free_of(F.col("__runs"), F.col("__base")), lambda s: model.is_random(s["value"]))
    return runs.withColumn("__spans", F.array_sort(F.concat(F.col("__base"), added))).drop("__runs")


def _listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, their digest, and all spans.

    Nothing is shuffled: a document's spans come from its own text. Null and empty texts have no
    spans (the digest of an empty string); repeated rows give repeated results.
    """
    found = _found(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, "text")
    count = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])],
        F.sha2(_listed("__base"), 256).alias("base_sha256"),
        _listed("__spans").alias("spans"),
    )


def redact(
    docs: DataFrame,
    model: Model,
    text_col: str = "text",
    placeholder: str = PLACEHOLDER,
    length_col: str | None = None,
) -> DataFrame:
    """``docs`` with every span replaced; overlapping spans give one placeholder. Null stays null.

    ``length_col``, if named, gets the new length of texts that change; all other columns stay.
    """
    text = F.col(text_col)
    pieces = F.aggregate(
        "__spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"])
            .otherwise(
                F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(placeholder))
            )
            .alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)),
    )
    found = _found(docs, model, text_col)
    hit = F.size("__spans") > 0
    clean = found.withColumn(text_col, F.when(hit, pieces).otherwise(text))
    if length_col:
        length = F.length(text_col).cast(docs.schema[length_col].dataType)
        clean = clean.withColumn(length_col, F.when(hit, length).otherwise(F.col(length_col)))
    return clean.select(*docs.columns)
