"""HTML, entity, attribute and path functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bookflow import constants as C
from bookflow.functions.arrays import let
from bookflow.functions.text import _text, collapse_ws, js_trim, non_empty, normalize_text

# The tags that start a new line, matched as prefixes (so <link> counts as <li>).
BLOCK_TAGS = "p|div|section|article|li|h[1-6]|blockquote"

# Named entities in decoding order; numeric ones follow.
NAMED_ENTITIES = (
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
)


def _code_point(digits: Column, base: int) -> Column:
    """The character for a number written in ``base``; null beyond the Unicode range."""
    n = F.conv(digits, base, 10).cast("decimal(20,0)")
    hex8 = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.when(n <= 0x10FFFF, F.decode(F.unhex(hex8), "UTF-32"))


def _numeric(c: Column, pattern: str, base: int) -> Column:
    """Replace every numeric entity in a single pass: split around them, decode, join again."""
    gaps = F.split(c, pattern, -1)
    found = F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))
    digits = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    decoded = F.zip_with(digits, found, lambda d, raw: F.coalesce(_code_point(d, base), raw))
    return F.array_join(
        F.zip_with(gaps, decoded, lambda gap, ch: F.concat(gap, F.coalesce(ch, F.lit("")))), ""
    )


def html_decode(c: Column) -> Column:
    """Decode named entities in order, then hexadecimal and decimal ones; others stay."""
    out = _text(c)
    for entity, char in NAMED_ENTITIES:
        out = F.regexp_replace(out, f"(?i){entity}", char)

    def numeric(t: Column) -> Column:
        return let(_numeric(t, "(?i)&#x([0-9a-f]+);", 16), lambda h: _numeric(h, "&#([0-9]+);", 10))

    return let(out, lambda t: F.when(F.contains(t, F.lit("&#")), numeric(t)).otherwise(t))


def strip_tags(c: Column) -> Column:
    return collapse_ws(html_decode(F.regexp_replace(_text(c), "<[^>]+>", " ")))


def html_title(c: Column, fallback: Column) -> Column:
    """First h1-h3, else <title>, else the fallback."""
    heading = F.regexp_extract(c, r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>", 1)
    title = F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1)
    # an empty heading still wins over <title>, then gives way to the fallback
    has_heading = F.rlike(c, F.lit(r"(?is)<h[1-3][^>]*>.*?</h[1-3]>"))
    chosen = F.when(has_heading, heading).otherwise(title)
    inner = strip_tags(F.coalesce(non_empty(chosen), fallback))
    return F.coalesce(non_empty(inner), fallback)


def html_body(c: Column) -> Column:
    """Readable text of a page: one trimmed line per block, no markup."""
    out = F.regexp_replace(_text(c), r"(?is)<script.*?</script>", "")
    out = F.regexp_replace(out, r"(?is)<style.*?</style>", "")
    out = F.regexp_replace(out, rf"(?i)<br[{C.WS_CLASS}]*/?>", "\n")
    out = F.regexp_replace(out, rf"(?i)</(?:{BLOCK_TAGS})>", "\n")
    out = F.regexp_replace(out, rf"(?i)<(?:{BLOCK_TAGS})[^>]*>", "\n")
    out = html_decode(F.regexp_replace(out, "<[^>]+>", ""))
    kept = F.filter(F.transform(F.split(out, "\n"), js_trim), lambda x: x != "")
    return normalize_text(F.array_join(kept, "\n"))


def extract_attrs(c: Column) -> Column:
    """``map<name, decoded value>`` of quoted attributes; the last duplicate wins."""
    pattern = rf"([\w:-]+)[{C.WS_CLASS}]*=[{C.WS_CLASS}]*([\"'])(.*?)\2"
    names = F.regexp_extract_all(_text(c), F.lit(pattern), F.lit(1))
    values = F.regexp_extract_all(_text(c), F.lit(pattern), F.lit(3))

    def decoded(v: Column) -> Column:
        return F.when(F.contains(v, F.lit("&")), html_decode(v)).otherwise(v)

    def last(found: Column) -> Column:
        pairs = F.zip_with(found, values, lambda k, v: F.struct(k.alias("k"), decoded(v).alias("v")))
        later = lambda pair, i: F.slice(found, i + 2, F.size(found))
        return F.filter(pairs, lambda pair, i: F.array_position(later(pair, i), pair["k"]) == 0)

    # bound once: inside the filter the names would be searched for again with every pair
    return F.map_from_entries(let(names, last))


def resolve_path(base: Column, href: Column) -> Column:
    """Join two paths, dropping '.' and empty parts and stepping back on '..'."""
    joined = F.replace(F.concat(_text(base), F.lit("/"), _text(href)), F.lit("\\"), F.lit("/"))
    parts = F.aggregate(
        F.split(joined, "/"),
        F.array().cast("array<string>"),
        lambda acc, part: F.when(part.isin("", "."), acc)
        .when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(part))),
    )
    return F.array_join(parts, "/")


def base_name(c: Column, ext: str = "") -> Column:
    """Last path part, without ``ext`` when it ends in it (any case)."""
    clean = F.element_at(F.split(F.replace(_text(c), F.lit("\\"), F.lit("/")), "/"), -1)
    if not ext:
        return clean
    kept = F.substring(clean, F.lit(1), F.length(clean) - len(ext))
    return F.when(F.endswith(F.lower(clean), F.lit(ext)), kept).otherwise(clean)


def ext_name(c: Column) -> Column:
    """Lower-cased part from the last dot on; '' without a dot."""
    return F.regexp_extract(F.lower(_text(c)), r"(?s)(\.[^.]*)$", 1)
