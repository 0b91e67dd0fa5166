"""Glossaries: parsing, matching against texts, formatting, missed terms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookflow import constants as C
from bookflow.functions.arrays import explode_rows
from bookflow.functions.text import js_trim, non_empty
from bookflow.operators.matching import contains_pairs, fits

# Separators of a glossary line, of its note, and of an alias list.
LINE_PATTERN = rf"^(.+?)(?:[{C.WS_CLASS}]*(?:=>|->|=|：|:)[{C.WS_CLASS}]*)(.+)$"
SHORT_PATTERN = r"^(.+?)(?:=>|->|=|：|:)(.+)$"
LINE_BREAKS = "\n\r\x85\u2028\u2029"
NOTE_SPLIT = rf"[{C.WS_CLASS}]+#[{C.WS_CLASS}]+|[{C.WS_CLASS}]+//[{C.WS_CLASS}]+"
ALIAS_SPLIT = "[|,，、]"

# Up to so many terms, looking for each in the row costs less than a join by anchors.
SMALL_TERMS = 500

TERM_TYPE = (
    "struct<term_idx:int,source:string,target:string,aliases:array<string>,note:string>"
)


def parse_glossary(raw: DataFrame) -> DataFrame:
    """``raw(project_id, glossary)`` -> glossary rows, one per line that is no comment."""
    lines = raw.select("project_id", F.split("glossary", "\r?\n").alias("lines"))
    lined = explode_rows(lines, "lines", pos="pos", item="line")
    kept = lined.select("project_id", "pos", js_trim(F.col("line")).alias("line")).filter(
        (F.col("line") != "") & ~F.startswith(F.col("line"), F.lit("#"))
    )
    # white space beside a separator is trimmed, not matched, but where it may break a line
    broken = F.translate("line", LINE_BREAKS, "") != F.col("line")

    def group(n: int) -> Column:
        return F.when(broken, F.regexp_extract("line", LINE_PATTERN, n)).otherwise(
            F.regexp_extract("line", SHORT_PATTERN, n)
        )

    matched = kept.select(
        "project_id", "pos", "line", js_trim(group(1)).alias("source"),
        F.ltrim(group(2), F.lit(C.WS_CHARS)).alias("rest"),
    )
    rest = F.col("rest")
    noted = F.contains(rest, F.lit("#")) | F.contains(rest, F.lit("//"))
    parts = F.when(noted, F.split(rest, NOTE_SPLIT)).otherwise(F.array(rest))
    parsed = matched.select(
        "project_id",
        "pos",
        F.coalesce(non_empty(F.col("source")), F.col("line")).alias("source"),
        F.when(F.col("source") != "", parts).otherwise(F.array(F.lit(""))).alias("parts"),
    )
    return parsed.select(
        "project_id",
        F.col("pos").cast("int").alias("term_idx"),
        F.concat(F.lit("term-"), (F.col("pos") + 1).cast("string")).alias("id"),
        "source",
        js_trim(F.coalesce(F.get("parts", F.lit(0)), F.lit(""))).alias("target"),
        F.array().cast("array<string>").alias("aliases"),
        js_trim(F.coalesce(F.get("parts", F.lit(1)), F.lit(""))).alias("note"),
        F.lit("term").alias("category"),
        F.lit("contains").alias("match_type"),
    )


def split_aliases(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ALIAS_SPLIT), js_trim), lambda x: x != "")


def normalize_terms(df: DataFrame) -> DataFrame:
    """Glossary rows from loosely named records; absent columns count as empty.

    ``aliases`` may be an array or a separated string.
    """

    def first_of(*names: str) -> Column:
        present = [non_empty(F.col(n)) for n in names if n in df.columns]
        return F.coalesce(*present, F.lit(""))

    if "aliases" not in df.columns:
        aliases = F.array().cast("array<string>")
    elif dict(df.dtypes)["aliases"] == "string":
        aliases = split_aliases(F.coalesce("aliases", F.lit("")))
    else:
        trimmed = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), js_trim)
        aliases = F.filter(trimmed, lambda x: x != "")
    source = js_trim(first_of("source", "input", "original", "term"))
    return df.select(
        "project_id",
        "term_idx",
        F.coalesce(non_empty(first_of("id")), source).alias("id"),
        source.alias("source"),
        js_trim(first_of("target", "translation", "output")).alias("target"),
        aliases.alias("aliases"),
        js_trim(first_of("note", "description")).alias("note"),
        js_trim(F.coalesce(non_empty(first_of("category", "type")), F.lit("term"))).alias("category"),
        F.coalesce(non_empty(first_of("match_type")), F.lit("contains")).alias("match_type"),
    ).filter(F.col("source") != "")


# --- matching ----------------------------------------------------------------------------------


def _term() -> Column:
    return F.struct(
        *[F.col(n) for n in ("term_idx", "source", "target", "aliases", "note")]
    ).cast(TERM_TYPE)


def _needles(any_name: bool) -> Column:
    if not any_name:
        return F.array("source")
    return F.filter(F.concat(F.array("source"), "aliases"), lambda n: n != "")


def small_glossary(terms: DataFrame) -> bool:
    """Whether the glossary may be broadcast and searched for row by row."""
    sized = terms.withColumn("__names", F.array_join("aliases", ""))
    return fits(sized, ["source", "target", "note", "__names"], max_rows=SMALL_TERMS)


def found_udf(names: dict[str, list[list[bytes]]], limit: int | None) -> Callable[..., Column]:
    """Arrow UDF ``(group, text as bytes) -> array<int>``: places of the group's terms, ``limit`` at most,
    any of whose ``names`` the text contains.

    A name is looked for only in texts that hold its first four bytes, which are found in one pass
    as numbers, behind a bitmap of all names' first bytes.
    """

    def hashed(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint32(2654435769)) >> np.uint32(16)

    def finder(terms: list[list[bytes]]):
        short: list[tuple[int, bytes]] = []
        starts: dict[int, list[tuple[int, bytes]]] = {}
        for place, own in enumerate(terms):
            for name in own:
                known = short if len(name) < 4 else starts.setdefault(int.from_bytes(name[:4], "little"), [])
                known.append((place, name))
        bitmap = np.zeros(1 << 16, bool)
        bitmap[hashed(np.array([*starts], np.uint32))] = True

        def find(text: bytes) -> list[int]:
            found = {place for place, name in short if name in text}
            if len(text) > 3:
                one = np.frombuffer(text, np.uint8).astype(np.uint32)
                codes = one[:-3] | one[1:-2] << np.uint32(8) | one[2:-1] << np.uint32(16) | one[3:] << np.uint32(24)
                for code in set(codes[bitmap[hashed(codes)]].tolist()):
                    for place, name in starts.get(code, ()):
                        if place not in found and (len(name) == 4 or name in text):
                            found.add(place)
            return sorted(found)[:limit]

        return find

    @F.arrow_udf("array<int>")
    def places(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        finders = {group: finder(terms) for group, terms in names.items()}
        for groups, texts in batches:
            # one text at a time becomes an object
            rows = [
                finders[g](t.as_py()) if g in finders and t.is_valid else []
                for g, t in zip(groups.to_pylist(), texts, strict=True)
            ]
            yield pa.array(rows, pa.list_(pa.int32()))

    return places


def join_small(
    segs: DataFrame, terms: DataFrame, any_name: bool, text: str, limit: int | None = None
) -> DataFrame:
    """``segs`` with ``matched``, the relevant terms of each row in glossary order.

    For glossaries whose size was checked: the term lists are broadcast.
    """
    entry = F.struct(F.col("term_idx"), _term().alias("term"), _needles(any_name).alias("needles"))
    lists = terms.groupBy("project_id").agg(F.sort_array(F.collect_list(entry)).alias("__terms"))
    names = {
        r["project_id"]: [[n.encode() for n in own or [] if n] for own in r["needles"]]
        for r in lists.select("project_id", F.col("__terms.needles").alias("needles")).collect()
        if r["project_id"] is not None
    }
    found = found_udf(names, limit)("project_id", F.col(text).cast("binary"))
    joined = segs.join(F.broadcast(lists), "project_id", "left").withColumn("__at", found)
    matched = F.transform("__at", lambda i: F.get("__terms", i)["term"])
    return joined.select(*segs.columns, F.coalesce(matched, F.array().cast(f"array<{TERM_TYPE}>")).alias("matched"))


def _pairs(
    segs: DataFrame, terms: DataFrame, keys: list[str], text: str, any_name: bool
) -> DataFrame:
    needles = terms.select("project_id", "term_idx", F.explode(_needles(any_name)).alias("__n"))
    return contains_pairs(
        segs.select(*keys, "project_id", text),
        [*keys, "project_id"],
        text,
        needles,
        ["project_id", "term_idx"],
        "__n",
        ["project_id"],
    )


def first_terms(matched: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first ``n`` matches of every key in glossary order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("term_idx"))
    return matched.withColumn("__r", rank).filter(F.col("__r") <= n).drop("__r")


def match_terms(
    segs: DataFrame,
    terms: DataFrame,
    keys: list[str],
    text: str = "text",
    any_name: bool = True,
    small: bool | None = None,
) -> DataFrame:
    """One row ``keys, project_id, term_idx`` per text and relevant term.

    A term is relevant when its source or, with ``any_name``, an alias occurs in the text.
    """
    if small_glossary(terms) if small is None else small:
        hits = join_small(segs.select(*keys, "project_id", text), terms, any_name, text)
        found = hits.select(*keys, "project_id", F.col("matched.term_idx").alias("__idx"))
        return explode_rows(found, "__idx", item="term_idx")
    return _pairs(segs, terms, keys, text, any_name)


def attach_terms(
    segs: DataFrame,
    terms: DataFrame,
    keys: list[str],
    limit: int,
    text: str = "text",
    small: bool | None = None,
) -> DataFrame:
    """Add ``matched``: the first ``limit`` relevant terms of each text, in glossary order."""
    if small_glossary(terms) if small is None else small:
        return join_small(segs, terms, True, text, limit)
    pairs = first_terms(_pairs(segs, terms, keys, text, True), keys, limit)
    lists = (
        pairs.join(terms.select("project_id", "term_idx", _term().alias("__t")), ["project_id", "term_idx"])
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("__t")).alias("matched"))
    )
    return segs.join(lists, keys, "left").withColumn(
        "matched", F.coalesce("matched", F.array().cast(f"array<{TERM_TYPE}>"))
    )


def leading_terms(terms: DataFrame, limit: int) -> DataFrame:
    """``project_id, leading``: the first ``limit`` terms of each glossary."""
    ranked = first_terms(terms, ["project_id"], limit)
    return ranked.groupBy("project_id").agg(
        F.sort_array(F.collect_list(_term())).alias("leading")
    )


def terms_or_default(
    segs: DataFrame, matched: DataFrame, terms: DataFrame, keys: list[str], limit: int
) -> DataFrame:
    """The matches, and the glossary's first ``limit`` terms for texts without any."""
    bare = segs.select(*keys, "project_id").join(matched.select(*keys).distinct(), keys, "left_anti")
    default = bare.join(leading_terms(terms, limit), "project_id").select(
        *keys,
        "project_id",
        F.explode(F.transform("leading", lambda t: t["term_idx"])).alias("term_idx"),
    )
    return first_terms(matched, keys, limit).select(*keys, "project_id", "term_idx").unionByName(
        default
    )


def with_default_terms(
    segs: DataFrame, terms: DataFrame, limit: int, small: bool | None = None
) -> DataFrame:
    """Add ``shown``: ``matched``, or the glossary's first ``limit`` terms when it is empty."""
    leading = leading_terms(terms, limit)
    if small_glossary(terms) if small is None else small:
        leading = F.broadcast(leading)
    joined = segs.join(leading, "project_id", "left")
    shown = F.when(F.size("matched") > 0, F.col("matched")).otherwise(
        F.coalesce("leading", F.array().cast(f"array<{TERM_TYPE}>"))
    )
    return joined.withColumn("shown", shown).drop("leading")


def format_terms(arr: Column) -> Column:
    """Prompt lines for an array of terms."""
    line = F.transform(
        arr,
        lambda t: F.concat(
            F.lit("- "),
            t["source"],
            F.when(t["target"] != "", F.concat(F.lit(" => "), t["target"])).otherwise(F.lit("")),
            F.when(
                F.size(t["aliases"]) > 0,
                F.concat(F.lit("；别名："), F.array_join(t["aliases"], "、")),
            ).otherwise(F.lit("")),
            F.when(t["note"] != "", F.concat(F.lit("；备注："), t["note"])).otherwise(F.lit("")),
        ),
    )
    return F.when(F.size(arr) > 0, F.array_join(line, "\n")).otherwise(F.lit(C.NONE_TEXT))


def missed_terms(matched: Column, translated: Column) -> Column:
    """The matched terms whose target is absent from the translation."""
    return F.filter(
        matched, lambda t: (t["target"] != "") & ~F.contains(translated, t["target"])
    )


def glossary_preview(
    texts: DataFrame, terms: DataFrame, keys: list[str], limit: int = 80, small: bool | None = None
) -> DataFrame:
    """``matched`` terms and the ``prompt_text`` a model would see for each text."""
    attached = attach_terms(texts, terms, keys, limit, small=small)
    shown = with_default_terms(attached, terms, limit, small)
    return shown.select(*keys, "matched", format_terms(F.col("shown")).alias("prompt_text"))
