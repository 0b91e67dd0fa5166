"""Text functions. Lengths and positions count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bookflow import constants as C
from bookflow.functions.arrays import let


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def js_trim(c: Column) -> Column:
    """Trim the full white-space set from both ends (no regular expression)."""
    return F.btrim(c, F.lit(C.WS_CHARS))


def non_empty(c: Column) -> Column:
    """The value, or null when it is null or ''."""
    return F.nullif(c, F.lit(""))


def collapse_ws(c: Column) -> Column:
    return js_trim(F.regexp_replace(c, f"[{C.WS_CLASS}]+", " "))


def normalize_text(c: Column) -> Column:
    """LF line ends, no NUL, no blanks before LF, at most three LFs in a row, trimmed."""
    lf = F.replace(F.replace(_text(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    no_nul = F.replace(lf, F.lit("\x00"), F.lit(""))
    no_tail = F.regexp_replace(no_nul, "[ \t]+\n", "\n")
    return js_trim(F.regexp_replace(no_tail, "\n{4,}", "\n\n\n"))


def lines(c: Column) -> Column:
    return F.split(_text(c), "\n")


def paragraphs(c: Column) -> Column:
    """Trimmed non-blank lines."""
    return F.filter(F.transform(lines(c), js_trim), lambda x: x != "")


def preview(c: Column, n: int = 6) -> Column:
    """The first ``n`` paragraphs."""
    return F.slice(paragraphs(c), 1, n)


def fixed_slices(c: Column, n: int) -> Column:
    """Consecutive pieces of ``n`` code points, in one linear pass over the text."""
    return F.regexp_extract_all(c, F.lit(f"(?s).{{1,{n}}}"), F.lit(0))


def count_cjk(c: Column) -> Column:
    return F.length(_text(c)) - F.length(F.regexp_replace(_text(c), C.CJK_CLASS, ""))


def count_paragraphs(c: Column) -> Column:
    return F.size(paragraphs(c))


def estimate_tokens(c: Column) -> Column:
    # others = what a removal of the CJK characters leaves
    return let(
        F.struct(
            F.length(_text(c)).alias("n"),
            F.length(F.regexp_replace(_text(c), C.CJK_CLASS, "")).alias("others"),
        ),
        lambda x: F.ceil((x["n"] - x["others"]) * F.lit(0.8) + x["others"] / F.lit(4)).cast("long"),
    )


def trim_to_budget(c: Column, max_tokens: int) -> Column:
    if not max_tokens:
        return F.lit("")
    limit = max(160, int(max_tokens * 3.2))
    return let(
        js_trim(_text(c)),
        lambda t: F.when(F.length(t) <= limit, t).otherwise(
            F.concat(js_trim(F.substring(t, 1, limit)), F.lit("..."))
        ),
    )


def first_sentences(c: Column, limit: int = 280) -> Column:
    """The first four sentences run together, cut to ``limit``.

    Only the last piece of the split can be empty, so asking for five pieces is enough.
    """
    # the result has at most `limit` visible characters, so the text's first ones decide it
    needed = rf"(?s)^(?:[{C.WS_CLASS}]*[^{C.WS_CLASS}]){{0,{limit}}}"
    head = F.regexp_extract(_text(c), needed, 0)
    pieces = F.split(collapse_ws(head), f"(?<=[。！？.!?])[{C.WS_CLASS}]*", 5)
    joined = F.array_join(F.slice(F.filter(pieces, lambda s: s != ""), 1, 4), "")
    return F.substring(joined, 1, limit)


def xml_escape(c: Column) -> Column:
    out = F.replace(_text(c), F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    out = F.replace(out, F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;"))


def sanitize_id(c: Column, prefix: str = "item") -> Column:
    """A file-safe id; values with nothing safe in them get a hash of the value."""
    dashed = F.regexp_replace(js_trim(_text(c)), "[^a-zA-Z0-9._-]+", "-")
    safe = F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 80)
    generated = F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(_text(c), 256), 1, 16))
    return F.coalesce(non_empty(safe), generated)


def demo_translate(c: Column, target_language: str = "", preset_name: str = "") -> Column:
    """The offline translator: a banner line, then every non-empty line with a mark."""
    banner = f"【Demo 译文｜{target_language or '中文'}｜{preset_name or '默认预设'}】\n"
    marked = F.transform(
        F.filter(lines(c), lambda x: x != ""), lambda x: F.concat(F.lit("译："), x)
    )
    return F.concat(F.lit(banner), F.array_join(marked, "\n"))


def retry_delay_base(attempt: Column) -> Column:
    """Milliseconds before the next attempt, without the run-time jitter."""
    exponent = F.greatest(attempt - 1, F.lit(0))
    return F.least(F.lit(30000.0), F.lit(1000) * F.pow(F.lit(2.0), exponent)).cast("long")


def is_retryable(flag: Column, status: Column) -> Column:
    by_status = F.when(F.coalesce(status, F.lit(0)) == 0, F.lit(True)).otherwise(
        (status == 429) | (status >= 500)
    )
    return F.coalesce(flag, by_status)


def clip_error(c: Column) -> Column:
    return F.substring(c, 1, C.ERROR_CHARS)


def tokens(c: Column) -> Column:
    """Distinct lower-case runs of two or more Han, kana or ASCII word characters."""
    return F.array_distinct(
        F.regexp_extract_all(F.lower(_text(c)), F.lit(C.TOKEN_PATTERN), F.lit(0))
    )


def grams(c: Column, size: int) -> Column:
    """Distinct substrings of ``size`` characters, found in one linear pass."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))
