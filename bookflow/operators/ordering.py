"""Ordered computations that stay balanced when one key holds most of the rows.

A plain window over a book or a job puts that whole group in one task. Here the ordering column
is cut into fixed-width buckets, the window runs inside (key, bucket) - never more than
``2**bits`` positions - and bucket totals, summed by a normal partial aggregation, supply the
offsets. Two levels of buckets keep the offset windows equally small. Everything is a function of
the values, so a recomputed task gives the same answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookflow.operators.matching import bounded_broadcast
from bookflow.session import materialize

BITS = 14


def running_totals(
    df: DataFrame, keys: list[str], order: str, values: dict[str, Column], bits: int = BITS
) -> DataFrame:
    """Add, per entry of ``values``, its sum over rows of the same keys with a smaller ``order``.

    ``order`` is integral and unique within ``keys``. Keys and values are written once and summed
    there; the other columns join the sums at the end, so they take no part in any window.
    """
    fine, coarse, outs = "__fine", "__coarse", list(values)
    narrow = df.select(
        *keys, order, *[v.cast("long").alias(f"__v_{o}") for o, v in values.items()], F.shiftright(order, bits).alias(fine)
    )
    valued = materialize(narrow, "sums")

    def before(part: list[str], by: str, col: str) -> Column:
        frame = W.partitionBy(*part).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum(col).over(frame), F.lit(0))

    totals = (
        valued.groupBy(*keys, fine)
        .agg(*[F.sum(f"__v_{o}").alias(f"__t_{o}") for o in outs])
        .withColumn(coarse, F.shiftright(fine, bits))
    )
    top = (
        totals.groupBy(*keys, coarse)
        .agg(*[F.sum(f"__t_{o}").alias(f"__tt_{o}") for o in outs])
        .select(*keys, coarse, *[before(keys, coarse, f"__tt_{o}").alias(f"__top_{o}") for o in outs])
    )
    mid = totals.select(
        *keys, coarse, fine, *[before([*keys, coarse], fine, f"__t_{o}").alias(f"__mid_{o}") for o in outs]
    )
    offsets = mid.join(top, [*keys, coarse]).select(
        *keys, fine, *[(F.col(f"__mid_{o}") + F.col(f"__top_{o}")).alias(f"__off_{o}") for o in outs]
    )
    local = valued.withColumns(
        {f"__loc_{o}": before([*keys, fine], order, f"__v_{o}") for o in outs}
    )
    sums = local.join(offsets, [*keys, fine]).select(
        *keys, order, *[(F.col(f"__off_{o}") + F.col(f"__loc_{o}")).alias(o) for o in outs]
    )
    if set(df.columns) == {*keys, order}:
        return sums.select(*df.columns, *outs)
    # the narrow sums are the side that is hashed: left to itself, Spark may broadcast the wide rows
    # and leave all of them to the few tasks of the sums
    return df.join(sums.hint("shuffle_hash"), [*keys, order]).select(*df.columns, *outs)


def running_total(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str, bits: int = BITS
) -> DataFrame:
    return running_totals(df, keys, order, {out: value}, bits)


def ordinal(df: DataFrame, keys: list[str], order: str, out: str, bits: int = BITS) -> DataFrame:
    """Add ``out``: the 0-based position of each row within its keys."""
    return running_total(df, keys, order, F.lit(1), out, bits)


def joined_parts(
    df: DataFrame, keys: list[str], order: str, text: str, separator: str
) -> DataFrame:
    """Prefix every text but the first of its keys with ``separator``.

    Concatenating the parts in order gives exactly the joined text, but no task or row ever
    holds a whole group: a sink writes the parts in order instead.
    """
    first = df.groupBy(*keys).agg(F.min(order).alias("__first"))
    glued = F.when(F.col(order) == F.col("__first"), F.col(text)).otherwise(
        F.concat(F.lit(separator), F.col(text))
    )
    return df.join(bounded_broadcast(first), keys).withColumn(text, glued).select(*df.columns)


def tree_hash(
    df: DataFrame, keys: list[str], order: str, row_hash: Column, out: str, fan_out: int = 1024
) -> DataFrame:
    """One SHA-256 per key over its rows in order.

    Hashes are folded ``fan_out`` at a time in three levels, so no group concatenates more than
    ``fan_out`` hashes up to 10^9 rows per key; a single group would have to hold them all.
    """
    level = df.select(*keys, F.col(order).cast("long").alias("__i"), row_hash.alias("__h"))
    for _ in range(2):
        level = (
            level.groupBy(*keys, F.floor(F.col("__i") / fan_out).cast("long").alias("__b"))
            .agg(F.sha2(_ordered_concat("__h", "__i"), 256).alias("__h"))
            .withColumnRenamed("__b", "__i")
        )
    return level.groupBy(*keys).agg(F.sha2(_ordered_concat("__h", "__i"), 256).alias(out))


def _ordered_concat(value: str, order: str) -> Column:
    pairs = F.sort_array(F.collect_list(F.struct(order, value)))
    return F.array_join(F.transform(pairs, lambda x: x[value]), "\n")
