"""Removal of byte strings that occur earlier, by a suffix sort with hash-compared suffixes.

Suffixes that may be equal over a window are sorted by merging runs. Two suffixes are compared
through prefix polynomial hashes: binary search finds their common extension in log steps, and the
byte after it decides. After the sort, equal neighbours are verified byte by byte, which guards
against hash collisions. ``recurring`` says which suffixes have to be sorted.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from bookflow.llm import recurring
from bookflow.llm.common import Batches, borders, release
from bookflow.llm.recurring import BASE
from bookflow.session import materialize

WINDOW = 100
GRAM = 32
#: Suffixes that are sorted at once, unless one group has more.
SORT = 1 << 18

_INVERSE = pow(BASE, -1, 1 << 64)


class Suffixes:
    """Bytes with prefix hashes; suffixes are compared over ``limit`` bytes."""

    def __init__(self, data: np.ndarray, limit: int) -> None:
        self.data, self.limit = data, limit
        n = len(data)
        powers = np.full(n + 1, _INVERSE, np.uint64)
        powers[0] = 1
        self.sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.cumprod(powers)[:n], dtype=np.uint64)]
        scale = np.full(n + 1, BASE, np.uint64)
        scale[0] = 1
        self.scale = np.cumprod(scale)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes at ``a`` and ``b``, up to the limit."""
        size = np.zeros(len(a), np.int64)
        pa_, pb = self.sums[a], self.sums[b]
        sa, sb = self.scale[a], self.scale[b]
        step = 1 << (self.limit.bit_length() - 1)
        while step:
            longer = size + step
            fits = longer <= self.limit
            to = np.where(fits, longer, 0)
            same = fits & ((self.sums[a + to] - pa_) * sa == (self.sums[b + to] - pb) * sb)
            size = np.where(same, longer, size)
            step >>= 1
        return size

    def before(self, a: np.ndarray, b: np.ndarray, ties: bool) -> np.ndarray:
        """Whether suffix ``a`` sorts before ``b``; equal ones count as ``ties``."""
        size = self.common(a, b)
        equal = size == self.limit
        at = np.where(equal, 0, size)
        return np.where(equal, ties, self.data[a + at] < self.data[b + at])

    def sort(self, items: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Order of ``items`` (suffix starts, grouped by ``segment``): each segment merge-sorted, stable.

        All pairs of runs of a width are merged together: an item's new place is its place in its own
        run plus the number of items of the other run before it, found by binary search.
        """
        edge = borders(segment)
        low = np.repeat(edge[:-1], np.diff(edge))
        high = np.repeat(edge[1:], np.diff(edge))
        order, place = np.arange(len(items)), np.arange(len(items))
        width, longest = 1, int(np.diff(edge).max(initial=0))
        while width < longest:
            run = (place - low) // width
            left = run % 2 == 0
            start = low + run * width
            other = np.where(left, start + width, start - width)
            end = np.minimum(np.where(left, other + width, start), high)
            moving = np.flatnonzero(other < high)
            lo, hi = other[moving].copy(), np.maximum(end[moving], other[moving])
            mine, is_left, sorted_items = items[order][moving], left[moving], items[order]
            while len(todo := np.flatnonzero(lo < hi)):
                mid = (lo[todo] + hi[todo]) // 2
                # from the left run go the items below, from the right run also the equal ones
                theirs, own, l_ = sorted_items[mid], mine[todo], is_left[todo]
                ahead = np.where(l_, self.before(theirs, own, False), self.before(theirs, own, True))
                lo[todo] = np.where(ahead, mid + 1, lo[todo])
                hi[todo] = np.where(ahead, hi[todo], mid)
            target = place.copy()
            rank = lo - other[moving]
            target[moving] = np.where(is_left, place[moving] + rank, place[moving] - width + rank)
            merged = np.empty_like(order)
            merged[target] = order
            order = merged
            width *= 2
        return order

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Byte-wise equality over the limit, for pairs whose hashes agree."""
        reach = np.arange(self.limit)
        return np.concatenate(
            [
                (self.data[a[i : i + 4096, None] + reach] == self.data[b[i : i + 4096, None] + reach]).all(axis=1)
                for i in range(0, len(a), 4096)
            ]
            or [np.zeros(0, bool)]
        )


def repeats(suffixes: Suffixes, items: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Which items equal an item before them in their segment, over the limit."""
    order = suffixes.sort(items, segment)
    a, b = items[order[:-1]], items[order[1:]]
    same = (segment[order[:-1]] == segment[order[1:]]) & (suffixes.common(a, b) == suffixes.limit)
    true = suffixes.equal(a[same], b[same])
    out = np.zeros(len(items), bool)
    if true.all():
        out[order[1:][same]] = True
        return out
    seen: set = set()  # a collision: this batch is settled by its bytes
    for i, (at, s) in enumerate(zip(items.tolist(), segment.tolist(), strict=True)):
        content = (s, suffixes.data[at : at + suffixes.limit].tobytes())
        out[i] = content in seen
        seen.add(content)
    return out


def _compare(table: pa.Table, window: int) -> pa.RecordBatch:
    """Ranges of windows that equal an earlier one of their k-gram's group, at the same distance."""
    table = table.combine_chunks()
    key, doc, start, windows, back = (table[c].to_numpy() for c in ("key", "doc", "start", "windows", "back"))
    bodies = table["body"].to_pylist()
    edge, total = borders(key), np.r_[0, np.cumsum(windows)]
    out: list[list[np.ndarray]] = [[], [], []]
    g = 0
    while g < len(edge) - 1:
        to = g + 1  # as many groups as may be sorted together
        while to < len(edge) - 1 and total[edge[to + 1]] - total[edge[g]] <= SORT:
            to += 1
        s, e = int(edge[g]), int(edge[to])
        g = to
        data = np.frombuffer(b"".join(bodies[s:e]), np.uint8)
        at = np.r_[0, np.cumsum([len(b) for b in bodies[s:e]])][:-1]
        n = windows[s:e]
        row = np.repeat(np.arange(e - s), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        group = np.repeat(np.cumsum(np.r_[False, key[s + 1 : e] != key[s : e - 1]]), n)
        segment = group * (2 * window) + (step - back[s:e][row] + window)
        by = np.argsort(segment, kind="stable")  # rows stay in order of doc and start
        found = np.zeros(len(row), bool)
        found[by] = repeats(Suffixes(data, window), (at[row] + step)[by], segment[by])
        hit = np.flatnonzero(found)
        if len(hit):
            new = np.r_[True, (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])]
            first, last = hit[new], hit[np.r_[new[1:], True]]
            r = row[first] + s
            out[0].append(doc[r])
            out[1].append(start[r] + step[first])
            out[2].append(start[r] + step[last])
    cols = [
        pa.array(np.concatenate(c) if c else [], t)
        for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32()), strict=True)
    ]
    return pa.RecordBatch.from_arrays(cols, ["doc", "first", "last"])


def _symbols(texts: list) -> tuple[list, np.ndarray, np.ndarray]:
    raw = [t.encode() if isinstance(t, str) else t for t in texts]
    return raw, np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) + np.uint64(1), np.array([len(r) for r in raw], np.int64)


def _piece(raw: bytes, start: int, size: int) -> bytes:
    return raw[start : start + size]


def _cut(body: bytes, window: int) -> list[bytes]:
    return [body[i : i + window] for i in range(len(body) - window + 1)]


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    id_col: str = "doc_id",
    text_col: str = "text",
    group: int = recurring.GROUP,
    with_text: bool = False,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row of ``docs``.

    Removed is each UTF-8 byte covered by a ``window``-byte string that also starts earlier (smaller
    doc_id, or same document and earlier start). A null text is empty. Rows that repeat an id and its
    text are one document and get the same result each; an id must not stand for different texts. A
    row without an id stays whole and counts as nobody's earlier text. ``gram`` is a power of two up to
    ``window``. ``kept`` holds the remaining bytes.
    """
    texts = recurring.source(docs, id_col, text_col)
    known = texts.where("doc is not null")
    places = recurring.recurring_places(known, _symbols, window, gram)

    def contexts(batches: Batches) -> Batches:
        for batch in batches:
            ids, texts_, marks = (batch.column(i) for i in range(3))
            texts_ = texts_.to_pylist()
            for s, e in recurring.chunks([len(t) for t in texts_]):
                raw, flat, sizes = _symbols(texts_[s:e])
                row, place, key, first, windows = recurring.anchors(flat, sizes, window, gram)
                part = marks.slice(s, e - s)
                wanted = np.repeat(np.arange(e - s), pc.list_value_length(part).to_numpy()) << 32 | part.flatten().to_numpy()
                hit = np.flatnonzero(np.isin(row << 32 | place, wanted))
                row, place, key, first, windows = (c[hit] for c in (row, place, key, first, windows))
                yield recurring.context_rows(
                    ids.to_numpy()[s:e], row, key, first, windows, place - first, raw, _piece, window
                )

    around = known.join(places, "doc").select("doc", "text", "places").mapInArrow(contexts, recurring.CONTEXT)
    around = materialize(around, "contexts")
    release(docs.sparkSession)
    ranges = recurring.earlier_ranges(
        around, known, window, _symbols, _piece, lambda t: _compare(t, window), _cut, group
    )

    def finish(batches: Batches) -> Batches:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode()
                gone = recurring.covered(len(raw), found, window) if found else np.zeros(len(raw), bool)
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if found else raw
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                values = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)
                for col, v in zip(out, values, strict=True):
                    col.append(v)
            cols = [batch.column(0), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols, names = [*cols, pa.array(out[4], pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    joined = texts.join(ranges, "doc", "left").select("doc", "text", "ranges")
    return joined.mapInArrow(finish, schema + (", kept binary" if with_text else ""))
