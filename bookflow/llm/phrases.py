"""Removal of word passages that occur earlier, located by Aho-Corasick automata.

Phrases of a few words that recur somewhere in the corpus are confirmed by counting. Each shard of
documents compiles one automaton of the phrases confirmed in it and streams its documents through it,
which gives every occurrence of every phrase; a shard has at most some megabytes of text, so an
automaton stays small however large the corpus is. The windows around the occurrences are then
compared exactly (``recurring``), as only whole windows count.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from bookflow.llm import recurring
from bookflow.llm.common import Batches, borders, release
from bookflow.session import materialize

WINDOW = 20
GRAM = 8
MEMO_WORDS = 200_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(self) < MEMO_WORDS:
            self[word] = found
        return found


_hashes = _Hashes()


def _symbols(texts: list) -> tuple[list, np.ndarray, np.ndarray]:
    """Words (bytes between ASCII white space) of each text, their hashes, and their numbers."""
    raw = [t.encode().split() for t in texts]
    sizes = np.array([len(w) for w in raw], np.int64)
    flat = np.fromiter((_hashes[w] for words in raw for w in words), np.uint64, int(sizes.sum()))
    return raw, flat, sizes


def automaton(phrases: set[bytes]) -> ahocorasick.Automaton | None:
    """Finds the phrases (words joined by one space) as whole words. Bytes are read as Latin-1."""
    machine = ahocorasick.Automaton()
    for phrase in phrases:
        machine.add_word(f" {phrase.decode('latin-1')} ", len(phrase) + 2)
    if not len(machine):
        return None
    machine.make_automaton()
    return machine


def occurrences(machine: ahocorasick.Automaton, words: list[bytes]) -> np.ndarray:
    """Word positions at which any phrase occurs in a text."""
    line = f" {b' '.join(words).decode('latin-1')} "
    spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    starts = [end - size + 1 for end, size in machine.iter(line)]
    return np.unique(np.searchsorted(spaces, starts))


def _compare(table: pa.Table) -> pa.RecordBatch:
    """Ranges of windows that equal an earlier one of their phrase's group, at the same distance."""
    key, doc, start, back = (table[c].to_numpy() for c in ("key", "doc", "start", "back"))
    bodies, out = table["body"].to_pylist(), []
    edge = borders(key).tolist()
    for s, e in zip(edge, edge[1:], strict=False):
        seen: set[tuple[int, bytes]] = set()
        for r in range(s, e):
            run: list[int] | None = None
            for j, content in enumerate(_cut(bodies[r], WINDOW)):
                if (mark := (j - int(back[r]), content)) not in seen:
                    seen.add(mark)
                    run = None
                elif run is None:
                    out.append(run := [int(doc[r]), int(start[r]) + j, int(start[r]) + j])
                else:
                    run[2] += 1
    cols = list(zip(*out, strict=True)) or [(), (), ()]
    kinds = (pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc", "first", "last"])


def _piece(words: list[bytes], start: int, size: int) -> bytes:
    return b" ".join(words[start : start + size])


def _cut(body: bytes, window: int) -> list[bytes]:
    ends = [i for i, b in enumerate(body) if b == 32] + [len(body)]
    starts = [0, *[i + 1 for i in ends]]
    return [body[starts[i] : ends[i + window - 1]] for i in range(len(ends) - window + 1)]


def remove_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    group: int = recurring.GROUP,
    with_text: bool = False,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) for every row of ``docs``.

    Removed is each word covered by WINDOW consecutive words whose sequence also starts earlier (smaller
    doc_id, or same document and earlier start). Null, empty and blank texts have no words. Rows that
    repeat an id and its text are one document and get the same result each; an id must not stand for
    different texts. A row without an id stays whole and counts as nobody's earlier text. ``kept`` is
    what remains, joined by single spaces.
    """
    texts = recurring.source(docs, id_col, text_col)
    known = texts.where("doc is not null")
    places = recurring.recurring_places(known, _symbols, WINDOW, GRAM)

    def contexts(batches: Batches) -> Batches:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            texts_, marks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for s, e in recurring.chunks([len(t) for t in texts_]):
                raw, flat, sizes = _symbols(texts_[s:e])
                machine = automaton(
                    {b" ".join(words[p : p + GRAM]) for words, at in zip(raw, marks[s:e], strict=True) for p in at or ()}
                )
                if machine is None:
                    continue
                met = [occurrences(machine, words) if words else np.zeros(0, np.int64) for words in raw]
                met = np.concatenate([(i << 32) | m for i, m in enumerate(met)])
                row, place, key, first, windows = recurring.anchors(flat, sizes, WINDOW, GRAM)
                hit = np.flatnonzero(np.isin(row << 32 | place, met))
                row, place, key, first, windows = (c[hit] for c in (row, place, key, first, windows))
                yield recurring.context_rows(ids[s:e], row, key, first, windows, place - first, raw, _piece, WINDOW)

    around = known.join(places, "doc", "left").select("doc", "text", "places").mapInArrow(contexts, recurring.CONTEXT)
    around = materialize(around, "contexts")
    release(docs.sparkSession)
    ranges = recurring.earlier_ranges(around, known, WINDOW, _symbols, _piece, _compare, _cut, group)

    def finish(batches: Batches) -> Batches:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.encode().split()
                n, removed = len(words), 0
                if found:
                    gone = recurring.covered(n, found, WINDOW)
                    removed = int(gone.sum())
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = b" ".join(words)
                for col, v in zip(out, (n, removed, hashlib.sha256(kept).hexdigest(), kept.decode()), strict=True):
                    col.append(v)
            cols = [batch.column(0), *[pa.array(c, pa.int64()) for c in out[:2]], pa.array(out[2], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols, names = [*cols, pa.array(out[3], pa.string())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    joined = texts.join(ranges, "doc", "left").select("doc", "text", "ranges")
    return joined.mapInArrow(finish, schema + (", kept string" if with_text else ""))
