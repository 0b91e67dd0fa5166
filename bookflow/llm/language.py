"""Language identification with a string kernel, Nyström landmarks and kernel ridge regression.

The kernel of two texts counts the character 1-, 2- and 3-grams that both hold (presence, not
frequency; grams are hashed to 2**DIM_BITS places), normalised to 1 for equal texts. A bounded sample
of labelled texts is fitted: some of them are landmarks, whose kernel values, whitened, are the
features of one ridge regression per language against the rest. As the kernel is a product of presence
vectors, landmarks, whitening and weights multiply out to one matrix; a batch of texts is scored by
one matrix product with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.llm.common import crc_bucket, map_rows

FOLDS = 3
HELD_OUT = 1
ORDERS = (1, 2, 3)
DIM_BITS = 15
DIM = 1 << DIM_BITS
#: Bound of the fitted sample: so many texts per language on average, and in all.
PER_LANGUAGE = 512
SAMPLE = 4096
LANDMARKS = 256
RIDGE = 1e-3
UNKNOWN = "und"
#: Texts and characters of one matrix product.
TEXTS, CHARS = 64, 1 << 20


def presence(texts: list[str]) -> np.ndarray:
    """(texts, DIM) of 0 and 1: which hashed grams each text holds. NUL separates, like text ends."""
    joined = "\x00".join(t.lower() for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t.lower()) + 1 for t in texts])[: len(code)] * DIM
    out = np.zeros(len(texts) * DIM, np.uint8)
    gram, whole = np.zeros(len(code), np.uint32), np.ones(len(code), bool)
    for n in range(max(ORDERS)):
        size = len(code) - n
        if size <= 0:
            break
        gram = (gram[:size] + code[n:]) * np.uint32(0x9E3779B1) + np.uint32(n)
        whole = whole[:size] & (code[n:] != 0)
        if n + 1 in ORDERS:
            mixed = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            out[(row[:size] + (mixed >> np.uint32(32 - DIM_BITS)))[whole]] = 1
    return out.reshape(len(texts), DIM)


def _batches(texts: list[str]) -> Iterator[list[str]]:
    batch, chars = [], 0
    for text in texts:
        if batch and (len(batch) == TEXTS or chars + len(text) > CHARS):
            yield batch
            batch, chars = [], 0
        batch.append(text)
        chars += len(text)
    if batch:
        yield batch


@dataclass
class Model:
    languages: list[str]
    matrix: np.ndarray  # (DIM, languages)

    def decide(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): regression values, near 1 for the language and -1 for the others."""
        if not texts:
            return np.zeros((0, len(self.languages)))
        parts = []
        for batch in _batches(texts):
            held = presence(batch).astype(np.float32)
            parts.append((held @ self.matrix) / np.sqrt(np.maximum(held.sum(axis=1, keepdims=True), 1)))
        return np.concatenate(parts)


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström features of the texts, and one ridge regression per language."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((DIM, 0), np.float32))
    marks: list[int] = []
    share = -(-landmarks // len(names))
    for name in names:
        marks += [i for i, lang in enumerate(langs) if lang == name][:share]
    held = presence([texts[i] for i in marks]).astype(np.float32)
    held /= np.sqrt(np.maximum(held.sum(axis=1, keepdims=True), 1))
    values, vectors = np.linalg.eigh((held @ held.T).astype(float))
    solid = values > 1e-6 * values.max(initial=1e-12)
    whiten = vectors[:, solid] / np.sqrt(values[solid])
    features = Model(names, (held.T @ whiten).astype(np.float32)).decide(texts).astype(float)
    target = np.where(np.array(langs)[:, None] == np.array(names), 1.0, -1.0)
    gram = features.T @ features + ridge * len(texts) * np.eye(features.shape[1])
    weights = np.linalg.solve(gram, features.T @ target)
    return Model(names, (held.T @ (whiten @ weights)).astype(np.float32))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a sample of the rows outside the held-out fold that have a text and a language.

    Rows are drawn by a hash of id and text, at a rate that gives every language about PER_LANGUAGE
    texts and all languages about SAMPLE; the driver holds no more. Rows without an id are not drawn.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    ).where(crc_bucket(F.col("id"), FOLDS) != HELD_OUT)
    rows = rows.where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], [])
    each = min(PER_LANGUAGE, max(1, SAMPLE // len(counts)))
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, each / n))])
    draw = F.shiftrightunsigned(F.xxhash64("id", F.md5("text")), 11).cast("double") / float(1 << 53)
    drawn = rows.where(draw < F.element_at(rate, F.col("lang"))).orderBy(draw, "id").collect()
    return fit([r["text"] for r in drawn], [r["lang"] for r in drawn])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row; only the text decides.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Ties go to
    the language first in order. Repeated rows give repeated results.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, texts = sent.value, batch.column(2).to_pylist()
        known = [i for i, t in enumerate(texts) if t is not None and model.languages]
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        values = model.decide([texts[i] for i in known])
        for i, v in zip(known, values, strict=True):
            lang[i] = model.languages[int(v.argmax())]
            score[i] = min(max((1 + float(v.max())) / 2, 0.0), 1.0)
        cols = [batch.column(0), batch.column(1), pa.array(lang), pa.array(score)]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "lang_pred", "score"])

    text = F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col))
    fold = F.coalesce(crc_bucket(F.col(id_col).cast("long"), FOLDS) == HELD_OUT, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), fold.alias("held_out"), text.alias("text"))
    return map_rows(rows, "doc_id long, held_out boolean, lang_pred string, score double", run)
