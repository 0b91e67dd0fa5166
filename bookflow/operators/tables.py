"""Keyed snapshots: upsert, eviction, set union of ids, redaction, ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(
    existing: DataFrame, incoming: DataFrame, keys: list[str], now: Column
) -> DataFrame:
    """The next snapshot: incoming fields win, absent (null) ones keep the existing value.

    Open columns (``map<string,variant>``: fields that no schema names) are merged name by name.
    ``created_at`` is the existing one, else the incoming one, else ``now``; ``updated_at`` is
    ``now`` for incoming rows. Rows that nothing touches stay as they are.
    """
    stamps = ("created_at", "updated_at")
    names = list(dict.fromkeys([*existing.columns, *incoming.columns]))
    fields = [n for n in names if n not in keys and n not in stamps]
    old = existing.select(*keys, *[F.col(n).alias(f"__o_{n}") for n in existing.columns if n not in keys])
    new = incoming.select(
        *keys,
        *[F.col(n).alias(f"__n_{n}") for n in incoming.columns if n not in keys],
        F.lit(True).alias("__touched"),
    )
    joined = old.join(new, keys, "full")

    def merged(name: str, order: str) -> list[Column]:
        return [F.col(f"__{side}_{name}") for side in order if f"__{side}_{name}" in joined.columns]

    kinds = dict(existing.dtypes) | dict(incoming.dtypes)
    touched = F.col("__touched")
    created = F.coalesce(*merged("created_at", "on"), F.when(touched, now))
    updated = F.when(touched, now).otherwise(F.coalesce(*merged("updated_at", "o"), F.lit(None)))
    return joined.select(
        *keys,
        *[merged_field(merged(n, "no"), kinds[n]).alias(n) for n in fields],
        created.alias("created_at"),
        updated.alias("updated_at"),
    )


#: The type of a column that holds the fields that a schema does not name.
OPEN = "map<string,variant>"


def merged_field(sides: list[Column], kind: str) -> Column:
    """The first side that is there; of an open column, each name's first side."""
    if kind != OPEN or len(sides) < 2:
        return F.coalesce(*sides)
    new, old = sides
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.coalesce(F.map_concat(new, kept), *sides)


def union_ids(existing: Column, new_id: Column) -> Column:
    """``existing`` with ``new_id`` added once."""
    return F.array_union(
        F.coalesce(existing, F.array().cast("array<string>")), F.array(new_id.cast("string"))
    )


def distinct_jobs(df: DataFrame) -> DataFrame:
    return df.select("project_id", "job_id").distinct()


def redact(df: DataFrame) -> DataFrame:
    """Drop the model key from a config table, as a column or as a field of a config struct."""
    out = df.drop("api_key", "apiKey")
    for name, field in ((f.name, f.dataType) for f in out.schema.fields):
        secrets = [n for n in getattr(field, "names", []) if n in ("api_key", "apiKey")]
        if secrets:
            out = out.withColumn(name, F.col(name).dropFields(*secrets))
    return out


def order_listing(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("updated_at"))
