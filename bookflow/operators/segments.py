"""Segments: size-bounded pieces of a chapter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.config import JobConfig
from bookflow.functions.arrays import explode_rows
from bookflow.functions.text import fixed_slices, js_trim, paragraphs
from bookflow.operators.chapters import numbered_title

_STATE = "struct<starts:array<int>,room:int>"


def _segment_starts(paras: Column, max_chars: int) -> Column:
    """Positions of the paragraphs that open a segment.

    The fold only carries those positions and the length of the open segment, not its text.
    ``room`` is 0 when no segment is open for more paragraphs.
    """
    zero = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("room"))
    sized = F.transform(paras, lambda p, i: F.struct(F.length(p).alias("n"), i.alias("i")))

    def step(state: Column, para: Column) -> Column:
        n = para["n"]
        together = state["room"] + 2 + n
        fits = (state["room"] > 0) & (together <= max_chars)
        return F.struct(
            F.when(fits, state["starts"])
            .otherwise(F.concat(state["starts"], F.array(para["i"])))
            .alias("starts"),
            F.when(fits, together).when(n > max_chars, F.lit(0)).otherwise(n).alias("room"),
        ).cast(_STATE)

    return F.aggregate(sized, zero.cast(_STATE), step)["starts"]


def _packed(paras: Column, starts: Column, max_chars: int) -> Column:
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(paras)))

    def pieces(start: Column, end: Column) -> Column:
        single = F.get(paras, start)
        too_long = (end - start == 1) & (F.length(single) > max_chars)
        packed = F.array_join(F.slice(paras, start + 1, end - start), "\n\n")
        return F.when(too_long, fixed_slices(single, max_chars)).otherwise(F.array(packed))

    return F.when(F.size(paras) > 0, F.flatten(F.zip_with(starts, ends, pieces))).otherwise(
        F.array().cast("array<string>")
    )


def pack_segments(df: DataFrame, max_chars: int, text: str = "text") -> DataFrame:
    """Replace ``text`` by ``pieces``: paragraphs joined while they fit into ``max_chars``.

    A longer paragraph is cut hard and nothing is joined to its tail.
    """
    keep = [c for c in df.columns if c != text]
    return (
        df.select(*keep, paragraphs(F.col(text)).alias("__p"))
        .withColumn("__s", _segment_starts(F.col("__p"), max_chars))
        .select(*keep, _packed(F.col("__p"), F.col("__s"), max_chars).alias("pieces"))
    )


def slice_segments(df: DataFrame, max_chars: int, text: str = "text") -> DataFrame:
    """Replace ``text`` by ``pieces``: the trimmed text cut every ``max_chars``."""
    keep = [c for c in df.columns if c != text]
    trimmed = js_trim(F.coalesce(F.col(text), F.lit("")))
    return df.select(*keep, fixed_slices(trimmed, max_chars).alias("pieces"))


def segment_pieces(df: DataFrame, cfg: JobConfig, text: str = "text") -> DataFrame:
    if cfg.preserve_paragraphs:
        return pack_segments(df, cfg.max_chars, text)
    return slice_segments(df, cfg.max_chars, text)


def build_segments(chapters: DataFrame, cfg: JobConfig) -> DataFrame:
    """``chapters(job_id, chapter_index, title, text)`` -> pending segments."""
    kept = chapters.select("job_id", "chapter_index", "title", "text")
    counted = segment_pieces(kept, cfg).withColumn("segments_total", F.size("pieces"))
    return explode_rows(counted, "pieces", pos="pos", item="text").select(
        "job_id",
        F.format_string("c%d-s%d", F.col("chapter_index") + 1, F.col("pos") + 1).alias("segment_id"),
        F.col("chapter_index").cast("int").alias("chapter_index"),
        numbered_title(F.col("title"), F.col("chapter_index")).alias("chapter_title"),
        (F.col("pos") + 1).alias("segment_index"),
        "segments_total",
        "text",
        F.lit("pending").alias("status"),
        F.lit(0).alias("attempts"),
    )
