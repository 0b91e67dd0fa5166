"""Quality checks of translated segments. Every check works inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow import constants as C
from bookflow.functions.arrays import let, value_counts
from bookflow.functions.text import count_cjk, count_paragraphs, js_trim, paragraphs
from bookflow.operators.glossary import attach_terms, missed_terms
from bookflow.operators.work import qa_eligible
from bookflow.schemas import SEG_KEYS

ISSUE = "struct<type:string,severity:string,message:string,source:string,target:string>"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def issue(
    kind: str,
    message: Column | str,
    severity: str = "warning",
    source: Column | None = None,
    target: Column | None = None,
) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("type"),
        F.lit(severity).alias("severity"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
        (none if source is None else source).alias("source"),
        (none if target is None else target).alias("target"),
    ).cast(ISSUE)


def is_blank(tgt: Column) -> Column:
    return js_trim(_text(tgt)) == ""


def check_empty(tgt: Column) -> Column:
    return F.when(is_blank(tgt), issue("empty", C.MSG_EMPTY, "error"))


def _ratio(src: Column, tgt: Column) -> Column:
    return F.length(_text(tgt)) / F.greatest(F.lit(1), F.length(_text(src)))


def check_short(src: Column, tgt: Column) -> Column:
    return F.when(_ratio(src, tgt) < F.lit(0.18), issue("length", C.MSG_SHORT))


def check_long(src: Column, tgt: Column) -> Column:
    return F.when(_ratio(src, tgt) > F.lit(4.2), issue("length", C.MSG_LONG))


def check_untranslated(src: Column, tgt: Column) -> Column:
    return let(
        F.struct(count_cjk(src).alias("s"), count_cjk(tgt).alias("t")),
        lambda n: F.when(
            (n["s"] > 20) & (n["t"] > n["s"] * F.lit(0.9)) & F.rlike(src, F.lit(C.KANA_PATTERN)),
            issue("untranslated", C.MSG_UNTRANSLATED),
        ),
    )


def check_format(src: Column, tgt: Column, preserve: bool = True) -> Column:
    if not preserve:
        return F.lit(None).cast(ISSUE)

    def judged(n: Column) -> Column:
        slack = F.greatest(F.lit(2).cast("double"), F.ceil(n["s"] * F.lit(0.35)).cast("double"))
        message = F.concat(
            F.lit("段落数量差异较大：原文 "),
            n["s"].cast("string"),
            F.lit(" 段，译文 "),
            n["t"].cast("string"),
            F.lit(" 段。"),
        )
        differs = (n["s"] >= 2) & (F.abs(n["s"] - n["t"]) > slack)
        return F.when(differs, issue("format", message))

    counts = F.struct(count_paragraphs(src).alias("s"), count_paragraphs(tgt).alias("t"))
    return let(counts, judged)


def check_instruction(tgt: Column) -> Column:
    chatty = F.rlike(js_trim(_text(tgt)), F.lit(C.INSTRUCTION_PATTERN))
    return F.when(chatty, issue("instruction", C.MSG_INSTRUCTION))


def glossary_issues(matched: Column, tgt: Column) -> Column:
    """An issue for each of the matched terms that the translation misses."""
    return F.transform(
        missed_terms(matched, _text(tgt)),
        lambda t: issue(
            "glossary",
            F.concat(
                F.lit("术语「"),
                t["source"],
                F.lit("」建议译为「"),
                t["target"],
                F.lit("」，译文中未检测到目标译名。"),
            ),
            source=t["source"],
            target=t["target"],
        ),
    )


def repeats(
    c: Column, min_len: int = C.REPEAT_MIN_CHARS, min_count: int = C.REPEAT_MIN_COUNT
) -> Column:
    """``value_counts`` of the long lines a text repeats."""
    long_lines = F.filter(paragraphs(c), lambda x: F.length(x) >= min_len)
    return let(long_lines, lambda ls: value_counts(ls, min_count))


def first_repeats(counts: Column, n: int = C.REPEAT_LIMIT) -> Column:
    placed = F.transform(
        counts, lambda c: F.struct(c["first_pos"].alias("pos"), c["value"].alias("line"), c["n"])
    )
    return F.slice(F.sort_array(placed), 1, n)


def repetition_issues(tgt: Column) -> Column:
    return F.transform(
        first_repeats(repeats(tgt)),
        lambda r: issue(
            "repetition",
            F.concat(
                F.lit("译文中疑似重复输出 "),
                r["n"].cast("string"),
                F.lit(" 次："),
                F.substring(r["line"], 1, 60),
            ),
        ),
    )


def repeated_lines(results: DataFrame, keys: list[str], text: str = "translated_text") -> DataFrame:
    """One row per text and repeated line, with its count and first position."""
    return results.select(*keys, F.explode(repeats(F.col(text))).alias("r")).select(
        *keys, F.col("r.value").alias("line"), "r.n", "r.first_pos"
    )


def check_segment(src: Column, tgt: Column, matched: Column, preserve: bool = True) -> Column:
    """All issues of one segment in order; a blank translation has just the one."""
    scalar = F.filter(
        F.array(
            check_short(src, tgt),
            check_long(src, tgt),
            check_untranslated(src, tgt),
            check_format(src, tgt, preserve),
            check_instruction(tgt),
        ),
        lambda x: x.isNotNull(),
    )
    every = F.concat(scalar, glossary_issues(matched, tgt), repetition_issues(tgt))
    return F.when(is_blank(tgt), F.array(check_empty(tgt))).otherwise(every)


LOCATION = ["chapter_index", "chapter_title", "segment_index"]


def check_jobs(
    results: DataFrame, terms: DataFrame, preserve: bool = True, small: bool | None = None
) -> DataFrame:
    """The issue table of all finished segments, each issue with its place.

    ``results`` carries ``project_id``, the location columns, ``text`` and ``translated_text``.
    """
    eligible = attach_terms(qa_eligible(results), terms, SEG_KEYS, C.QA_TERM_LIMIT, small=small)
    issues = check_segment(
        F.col("text"), F.col("translated_text"), F.col("matched"), preserve
    )
    return eligible.select(*SEG_KEYS, *LOCATION, F.posexplode(issues).alias("issue_no", "i")).select(
        *SEG_KEYS, *LOCATION, "issue_no", "i.*"
    )


def glossary_misses(
    results: DataFrame, terms: DataFrame, limit: int = C.QA_TERM_LIMIT, small: bool | None = None
) -> DataFrame:
    """The glossary issues alone."""
    attached = attach_terms(results, terms, SEG_KEYS, limit, small=small)
    found = glossary_issues(F.col("matched"), F.col("translated_text"))
    return attached.select(*SEG_KEYS, *LOCATION, F.posexplode(found).alias("issue_no", "i")).select(
        *SEG_KEYS, *LOCATION, "issue_no", "i.*"
    )


def check_repetition(results: DataFrame) -> DataFrame:
    found = repetition_issues(F.col("translated_text"))
    return results.select(*SEG_KEYS, *LOCATION, F.posexplode(found).alias("issue_no", "i")).select(
        *SEG_KEYS, *LOCATION, "issue_no", "i.*"
    )
