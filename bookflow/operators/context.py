"""The context and the messages a segment's prompt is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow import constants as C
from bookflow.config import JobConfig
from bookflow.functions.template import render_template
from bookflow.functions.text import estimate_tokens, non_empty, trim_to_budget
from bookflow.operators.glossary import attach_terms, format_terms, with_default_terms
from bookflow.operators.retrieval import attach_context, format_context
from bookflow.operators.summaries import previous_summaries
from bookflow.schemas import SEG_KEYS


def _or_none(c: Column) -> Column:
    return F.coalesce(non_empty(c), F.lit(C.NONE_TEXT))


def prompt_context(
    segs: DataFrame,
    terms: DataFrame,
    summaries: DataFrame,
    bank: DataFrame,
    cfg: JobConfig,
    small_terms: bool | None = None,
    book: str = "project_id",
) -> DataFrame:
    """Add glossary, summary and retrieval text and their token estimates to each segment.

    ``segs`` carries ``project_id``, and summaries belong to its ``book`` column. The estimates are taken before the budgets cut the texts and
    the glossary estimate counts matched terms only.
    """
    base = segs.columns
    joined = segs.join(
        chapter_context(segs.select(book, "chapter_index"), summaries, cfg, book),
        [book, "chapter_index"],
        "left",
    )
    # from here on rows stay where they are, unless glossary or bank are too large for that
    retrieved = attach_context(joined, bank, SEG_KEYS, cfg.retrieval_count)
    termed = with_default_terms(
        attach_terms(retrieved, terms, SEG_KEYS, cfg.glossary_limit, small=small_terms),
        terms,
        cfg.glossary_limit,
        small_terms,
    )
    texts = termed.select(
        *base,
        format_terms(F.col("shown")).alias("glossary_text"),
        format_terms(F.col("matched")).alias("__matched"),
        format_context(F.col("retrieved")).alias("__retrieved"),
        F.col("__summary_text"),
        F.col("__summary_tokens"),
    )
    alone = _or_none(trim_to_budget(F.lit(cfg.context), cfg.summary_tokens))
    return texts.select(
        *base,
        "glossary_text",
        F.coalesce("__summary_text", alone).alias("summary_text"),
        _or_none(trim_to_budget(F.col("__retrieved"), cfg.retrieval_tokens)).alias(
            "retrieval_text"
        ),
        estimate_tokens(F.col("__matched")).alias("glossary_tokens"),
        F.coalesce("__summary_tokens", F.lit(0)).alias("summary_tokens"),
        estimate_tokens(F.col("__retrieved")).alias("retrieval_tokens"),
    )


def chapter_context(
    chapters: DataFrame, summaries: DataFrame, cfg: JobConfig, book: str = "project_id"
) -> DataFrame:
    """The summary part of the prompt, worked out once per chapter instead of per segment."""
    keys = [book, "chapter_index"]
    previous = previous_summaries(chapters, summaries, book=book)
    own = summaries.select(*keys, "summary")
    text = F.array_join(
        F.array(
            non_empty(F.lit(cfg.context)),
            F.concat(F.lit("当前章节摘要："), non_empty(F.col("summary"))),
            F.concat(F.lit("前文摘要：\n"), non_empty(F.col("previous"))),
        ),
        "\n\n",
    )
    return own.join(previous, keys, "full").select(
        *keys,
        _or_none(trim_to_budget(text, cfg.summary_tokens)).alias("__summary_text"),
        estimate_tokens(F.coalesce("previous", F.lit(""))).alias("__summary_tokens"),
    )


def prompt_messages(ctx: DataFrame, cfg: JobConfig) -> DataFrame:
    """Add ``system`` and ``user``; a template that places ``{{text}}`` is the whole user turn."""
    values = {
        "sourceLanguage": F.lit(cfg.source_language),
        "targetLanguage": F.lit(cfg.target_language),
        "chapterTitle": F.col("chapter_title"),
        "segmentIndex": F.col("segment_index"),
        "segmentsTotal": F.col("segments_total"),
        "glossary": F.col("glossary_text"),
        "context": F.col("summary_text"),
        "retrieval": F.col("retrieval_text"),
        "text": F.col("text"),
    }
    rendered = render_template(cfg.prompt, values)
    if "{{text}}" in cfg.prompt:
        return ctx.withColumns({"system": F.lit(C.TEMPLATE_SYSTEM), "user": rendered})
    sections = [
        F.concat(
            F.lit("章节："),
            F.coalesce(non_empty(F.col("chapter_title")), F.lit(C.UNTITLED_CHAPTER)),
        ),
        F.concat(
            F.lit("片段："),
            F.col("segment_index").cast("string"),
            F.lit("/"),
            F.col("segments_total").cast("string"),
        ),
        F.lit(f"源语言：{cfg.source_language or '自动识别'}"),
        F.lit(f"目标语言：{cfg.target_language or '中文'}"),
        F.concat(F.lit("术语表：\n"), F.col("glossary_text")),
        F.concat(F.lit("上下文摘要：\n"), F.col("summary_text")),
        F.concat(F.lit("相关资料：\n"), F.col("retrieval_text")),
        F.lit("待翻译文本："),
        F.col("text"),
    ]
    return ctx.withColumns({"system": rendered, "user": F.concat_ws("\n\n", *sections)})
