"""Exact "text contains needle" joins.

Two plans give the same rows. A needle table of a few hundred rows, which is checked, is broadcast and
searched with ``contains`` inside the row. A larger table is joined on an anchor: a text that contains
a needle also contains every piece of 1, 2 or 4 characters of it, so an equi join on any of them finds
every candidate and ``contains`` removes the false ones. The piece that the fewest texts hold is the
needle's anchor; a needle with a piece that no text holds has no match. Pieces of texts that no needle
has are dropped by a bitmap of the needles' pieces before anything is shuffled. Both plans are built-in
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.functions.text import grams
from bookflow.session import materialize

# A needle table within both bounds may be shipped to every task.
MAX_ROWS = 20000
MAX_BYTES = 4 * 1024 * 1024
ANCHORS = (1, 2, 4)
# The bitmap has 64 bits in each of so many rows, whatever the number of needles.
SLOT_BITS = 16


def fits(df: DataFrame, columns: list[str], max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES):
    """Whether ``df`` is small enough to broadcast; reads at most ``max_rows + 1`` rows."""
    size = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in columns), F.lit(0))
    row = (
        df.select(size.alias("b"))
        .limit(max_rows + 1)
        .agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"))
        .first()
    )
    return row["n"] <= max_rows and row["b"] <= max_bytes


def bounded_broadcast(df: DataFrame) -> DataFrame:
    """``df``, written once, with a broadcast hint when its size allows it.

    For one row per project or book that many wide rows look up: without the hint those rows could
    be shuffled, text and all, onto the few keys.
    """
    texts = [n for n, t in df.dtypes if t == "string"]
    df = materialize(df, "lookup")
    return F.broadcast(df) if fits(df, texts, 100_000, 16 * 1024 * 1024) else df


def _anchor_size(needle: Column) -> Column:
    """The longest anchor that the needle can fill."""
    size = F.lit(ANCHORS[0])
    for n in ANCHORS[1:]:
        size = F.when(F.length(needle) >= n, F.lit(n)).otherwise(size)
    return size


def _hashed(df: DataFrame, on: list[str]) -> DataFrame:
    """Add the place of a row's gram in the bitmap."""
    h = F.xxhash64(*on, "__a")
    slot = F.shiftright(h, 6).bitwiseAND(F.lit((1 << SLOT_BITS) - 1).cast("long"))
    return df.withColumns({"__slot": slot, "__bit": h.bitwiseAND(F.lit(63).cast("long")).cast("int")})


def anchor_candidates(
    hay: DataFrame, hay_keys: list[str], text: str, needles: DataFrame, needle_cols: list[str], needle: str, on: list[str]
) -> DataFrame:
    """``hay_keys + needle_cols`` (and ``on``) of texts that hold the rarest piece of a needle."""
    sized = needles.filter(F.length(needle) > 0).withColumn("__g", _anchor_size(F.col(needle)))
    sizes = sorted(r["__g"] for r in sized.select("__g").distinct().collect()) or [1]
    cut = F.when(F.col("__g") == sizes[0], grams(F.col(needle), sizes[0]))
    for g in sizes[1:]:
        cut = cut.when(F.col("__g") == g, grams(F.col(needle), g))
    extra = [c for c in needle_cols if c not in on]
    pieces = materialize(sized.select(*on, *extra, F.posexplode(cut).alias("__p", "__a")), "pieces")

    mask = F.expr("shiftleft(1L, __bit)")
    marked = _hashed(pieces.select(*on, "__a").distinct(), on)
    bitmap = marked.groupBy("__slot").agg(F.bit_or(mask).alias("__bits"))
    found = F.flatten(F.array(*[grams(F.col(text), g) for g in sizes]))
    cols = list(dict.fromkeys([*hay_keys, *on]))
    exploded = _hashed(hay.select(*cols, F.explode(found).alias("__a")), on)
    held = exploded.join(F.broadcast(bitmap), "__slot").filter(F.col("__bits").bitwiseAND(mask) != 0)
    held = materialize(held.select(*cols, "__a"), "held")

    counts = held.groupBy(*on, "__a").agg(F.count("*").alias("__held"))
    rated = pieces.join(counts, [*on, "__a"], "left").withColumn("__held", F.coalesce("__held", F.lit(0)))
    rarest = rated.groupBy(*on, *extra).agg(F.min(F.struct("__held", "__p", "__a")).alias("__rare"))
    anchored = rarest.filter(F.col("__rare.__held") > 0).select(*on, *extra, F.col("__rare.__a").alias("__a"))
    return held.join(anchored, [*on, "__a"]).drop("__a")


def contains_pairs(
    hay: DataFrame,
    hay_keys: list[str],
    text: str,
    needles: DataFrame,
    needle_keys: list[str],
    needle: str,
    on: list[str],
) -> DataFrame:
    """Distinct ``hay_keys + needle_keys`` where ``text`` contains ``needle``, by anchor join.

    Only keys and grams are shuffled for the candidates; the text joins them afterwards.
    ``hay_keys`` and ``needle_keys`` include the ``on`` columns where the caller wants them back.
    """
    needle_cols = list(dict.fromkeys([*needle_keys, needle]))
    candidates = anchor_candidates(hay, hay_keys, text, needles, needle_cols, needle, on)
    verified = candidates.join(hay.select(*hay_keys, text), hay_keys).filter(
        F.contains(F.col(text), F.col(needle))
    )
    return verified.select(*dict.fromkeys([*hay_keys, *needle_keys])).distinct()
