"""Array helpers that keep per-row groupings inside the row, so they need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS_TYPE = "array<struct<value:string,n:int,first_pos:int>>"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Columns are expression trees: a value that is mentioned twice is computed twice unless it
    is bound to a name, which a one-element transform does.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def explode_rows(df: DataFrame, arr: str, *, pos: str | None = None, item: str) -> DataFrame:
    """Explode a computed array column, dropping it.

    For a plain explode of a column Spark infers ``size(column) > 0`` and pushes that below the
    projection that computes it, so the array is computed twice. An outer explode infers nothing.
    """
    keep = [c for c in df.columns if c != arr]
    if pos is None:
        out = df.select(*keep, F.posexplode_outer(arr).alias("__pos", item))
        return out.filter(F.col("__pos").isNotNull()).drop("__pos")
    out = df.select(*keep, F.posexplode_outer(arr).alias(pos, item))
    return out.filter(F.col(pos).isNotNull())


def indexes(arr: Column) -> Column:
    """0-based positions; empty for an empty array."""
    return F.when(F.size(arr) > 0, F.sequence(F.lit(0), F.size(arr) - 1)).otherwise(
        F.array().cast("array<int>")
    )


def value_counts(arr: Column, min_count: int = 1) -> Column:
    """``array<struct<value, n, first_pos>>`` of values seen at least ``min_count`` times.

    Equal values are neighbours after sorting (value, position), so the start of a run carries
    the first position and the distance to the next start is the count. An array without enough
    repeats is recognised by its distinct size and is not sorted at all.
    """
    placed = F.sort_array(F.transform(arr, lambda x, i: F.struct(x.alias("v"), i.alias("p"))))

    def starts(sorted_arr: Column) -> Column:
        return F.filter(
            indexes(sorted_arr),
            lambda i: (i == 0)
            | (F.get(sorted_arr, i)["v"] != F.get(sorted_arr, F.greatest(i - 1, F.lit(0)))["v"]),
        )

    def runs(sorted_arr: Column, start_idx: Column) -> Column:
        ends = F.concat(F.slice(start_idx, 2, F.size(sorted_arr)), F.array(F.size(sorted_arr)))
        return F.zip_with(
            start_idx,
            ends,
            lambda s, e: F.struct(
                F.get(sorted_arr, s)["v"].alias("value"),
                (e - s).cast("int").alias("n"),
                F.get(sorted_arr, s)["p"].cast("int").alias("first_pos"),
            ),
        )

    counted = let(placed, lambda s: let(starts(s), lambda st: runs(s, st)))
    if min_count > 1:
        enough = F.size(arr) - F.size(F.array_distinct(arr)) >= min_count - 1
        counted = F.when(enough, F.filter(counted, lambda x: x["n"] >= min_count)).otherwise(
            F.array().cast(COUNTS_TYPE)
        )
        return counted
    return F.when(F.size(arr) > 0, counted).otherwise(F.array().cast(COUNTS_TYPE))
