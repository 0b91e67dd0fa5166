"""Toxicity by class-conditional Kneser-Ney models over words and their stems.

Each class has P(word) = P(stem) P(word | stem), both with absolute discounting. What a discount
frees goes to backoff counts that both classes share: in how many contexts a word (or a stem's words)
was seen, whatever the class. A rare word therefore costs the same in both classes, and its stem
decides.

A document's evidence is the log-likelihood of a text in which every word is toxic with a small
prior, against the ordinary model, over a power of its length; a logistic curve, fitted on labelled
rows that the counts have not seen, turns it into a score.

Counts come from all labelled training rows. They are kept in tables of 2**WORD_BITS words and 2**16
stems, which bounds what is broadcast (some 30 MB) at any size of corpus.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.llm.common import crc_bucket, map_rows, only_memo
from bookflow.session import materialize

FOLDS = 5
HELD_OUT = 0
#: The training fold that fits the curve; the other training folds give the counts.
CURVE_FOLD = 1
STEM = 4
WORD_BITS = 21
#: An odd factor that spreads ids over the word table, small enough that products fit in 63 bits.
SPREAD = 0x5E3779B1
DISCOUNT = 0.75
#: Share of a toxic text's words that are toxic, before the text is seen.
PRIOR = 0.01
LENGTH_POWER = 0.75
MEMO_WORDS = 100_000
_SPLIT = re.compile(r"\W+").split


class _Ids(dict):
    """Word -> 32-bit id: 16 bits of its stem's hash above 16 bits of its own."""

    def __missing__(self, word: str) -> int:
        own = xxhash.xxh64_intdigest(word) & 0xFFFF
        found = (xxhash.xxh64_intdigest("^" + word[:STEM]) & 0xFFFF) << 16 | own
        if len(self) < MEMO_WORDS:
            self[word] = found
        return found


_ids = _Ids()


def word_ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words of the texts, and the positions where each text starts and ends."""
    only_memo("toxicity", _ids)
    parts = [list(map(_ids.__getitem__, filter(None, _SPLIT((t or "").lower())))) for t in texts]
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.fromiter((i for p in parts for i in p), np.int64, int(ends[-1]))
    return flat, ends


def slot(ids: np.ndarray) -> np.ndarray:
    """A word's place in the word table."""
    return ((ids * SPREAD) & 0xFFFFFFFF) >> (32 - WORD_BITS)


def _counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(context and word, toxic count, ordinary count) of a batch of (text, toxic)."""
    ids, ends = word_ids(batch.column(0).to_pylist())
    toxic = np.repeat(batch.column(1).to_numpy(zero_copy_only=False) == 1, np.diff(ends))
    before = np.r_[0, slot(ids[:-1])] if len(ids) else ids
    before[ends[:-1][np.diff(ends) > 0]] = (1 << WORD_BITS) - 1  # a text's start
    keys, at = np.unique(before << 32 | ids, return_inverse=True)
    t = np.bincount(at, weights=toxic, minlength=len(keys)).astype(np.int64)
    n = np.bincount(at, minlength=len(keys))
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(t), pa.array(n - t)], ["key", "t", "o"])


@dataclass
class Model:
    """Tables of counts and the curve; a few arrays of bounded size."""

    words: np.ndarray  # (3, 2**WORD_BITS): toxic, ordinary, contexts
    stems: np.ndarray  # (5, 2**16): toxic, ordinary, toxic types, ordinary types, contexts
    slope: float = 1.0
    shift: float = -1.0

    def __post_init__(self) -> None:
        contexts = self.stems[4].astype(float)
        shared = (contexts + 0.1) / (contexts.sum() + 0.1 * len(contexts))
        self._base = contexts + 1.0
        self._stem = []
        for count in self.stems[:2].astype(float):
            total, types = max(count.sum(), 1.0), (count > 0).sum()
            freed = DISCOUNT * types / total if types else 1.0
            self._stem.append(np.log(np.maximum(count - DISCOUNT, 0) / total + freed * shared))

    def ratio(self, ids: np.ndarray) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary)."""
        stem, word = ids >> 16, slot(ids)
        shared = (self.words[2][word] + 0.1) / self._base[stem]
        logs = []
        for c in (0, 1):
            total = self.stems[c][stem]
            own = np.maximum(self.words[c][word] - DISCOUNT, 0) + DISCOUNT * self.stems[2 + c][stem] * shared
            logs.append(self._stem[c][stem] + np.log(np.where(total > 0, own / np.maximum(total, 1), shared)))
        return np.clip(logs[0] - logs[1], -20, 20)

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """Length-normalised log-likelihood ratio of each text; 0 without words."""
        ids, ends = word_ids(texts)
        gain = np.log1p(PRIOR * np.expm1(self.ratio(ids)))
        total = np.r_[0, np.cumsum(gain)]
        return (total[ends[1:]] - total[ends[:-1]]) / np.maximum(np.diff(ends), 1) ** LENGTH_POWER

    def score(self, texts: list[str | None]) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-np.clip(self.slope * self.evidence(texts) + self.shift, -500, 500)))


def _curve(value: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one feature by Newton steps, with a slight pull of the slope to zero."""
    x = np.stack([value, np.ones_like(value)])
    beta = np.zeros(2)
    loss = lambda b: (weight * np.logaddexp(0, np.where(label == 1, -1, 1) * (b @ x))).sum() + 0.005 * b[0] ** 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -500, 500)))
        grad = x @ (weight * (p - label)) + [0.01 * beta[0], 0]
        hess = (x * (weight * p * (1 - p))) @ x.T + np.diag([0.01, 1e-9])
        step = np.linalg.solve(hess, grad)
        while loss(beta - step) > loss(beta) and np.abs(step).max() > 1e-9:
            step /= 2
        beta = beta - step
        if np.abs(step).max() < 1e-7:
            break
    return float(beta[0]), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the rows of ``docs`` that ``labels`` (doc_id, toxic) marks, but for the held-out fold.

    A document with several labels is toxic if one says so; null labels and rows without an id are
    left out. Without toxic or without ordinary training rows every score is the share of toxic ones.
    """
    spark = docs.sparkSession
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("toxic"))
        .where("__id is not null and toxic in (0, 1)")
        .groupBy("__id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("__fold", crc_bucket(F.col("__id"), FOLDS))
        .where(F.col("__fold") != HELD_OUT)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text"))

    def labelled(curve: bool) -> DataFrame:
        same = lambda c: (crc_bucket(F.col(c), FOLDS) == CURVE_FOLD) == curve
        held = crc_bucket(F.col("__id"), FOLDS) == HELD_OUT
        # the same plan at every size: labels grow with the corpus and are not broadcast
        marked = marks.where(same("__id")).hint("merge")
        return texts.where(~held & same("__id")).join(marked, "__id").select("text", "toxic")

    pairs = map_rows(labelled(False), "key long, t long, o long", _counts)
    pairs = pairs.groupBy("key").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    word = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))
    words = materialize(
        pairs.groupBy(word.alias("id")).agg(F.sum("t").alias("t"), F.sum("o").alias("o"), F.count("*").alias("n")),
        "word_counts",
    )
    place = F.shiftright((F.col("id") * F.lit(SPREAD)).bitwiseAND(F.lit(0xFFFFFFFF)), 32 - WORD_BITS)
    by_word = words.groupBy(place.cast("int").alias("at")).agg(*[F.sum(c).alias(c) for c in "ton"])
    types = [F.count_if(F.col(c) > 0).alias(f"types_{c}") for c in "to"]
    by_stem = words.groupBy(F.shiftright("id", 16).cast("int").alias("at")).agg(
        F.sum("t").alias("t"), F.sum("o").alias("o"), *types, F.sum("n").alias("n")
    )
    model = Model(_table(by_word, 1 << WORD_BITS), _table(by_stem, 1 << 16))

    sent = spark.sparkContext.broadcast(model)

    def evidence(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = np.round(np.clip(sent.value.evidence(batch.column(0).to_pylist()), -5, 20) * 1000).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(v), batch.column(1)], ["v", "toxic"])

    for curve in (True, False):  # few labels: the counting folds have to do
        bins = map_rows(labelled(curve), "v long, toxic int", evidence).groupBy("v", "toxic").count().toPandas()
        if bins["toxic"].nunique() == 2:
            model.slope, model.shift = _curve(bins["v"].to_numpy() / 1000, bins["toxic"].to_numpy(), bins["count"].to_numpy(float))
            return model
    model.slope, model.shift = 0.0, 500.0 if bins["toxic"].eq(1).any() else -500.0
    return model


def _table(counts: DataFrame, size: int) -> np.ndarray:
    """Rows (at, ...) as dense columns; at most ``size`` rows reach the driver."""
    found = counts.toArrow()
    out = np.zeros((found.num_columns - 1, size), np.float32)
    for i, name in enumerate(found.column_names[1:]):
        out[i, found.column("at").to_numpy()] = found.column(name).to_numpy()
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row; only the text decides. Null text: no words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = sent.value.score(batch.column(2).to_pylist())
        cols = [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted"])

    fold = F.coalesce(crc_bucket(F.col(id_col).cast("long"), FOLDS) == HELD_OUT, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), fold.alias("held_out"), F.col(text_col))
    return map_rows(rows, "doc_id long, held_out boolean, score double, predicted int", run)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(sent.value.score(batch.column(text_col).to_pylist()) < 0.5))

    return map_rows(docs, docs.schema, clean)
