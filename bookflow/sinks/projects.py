"""Project export."""

from __future__ import annotations

import gzip
import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookflow.functions.text import non_empty
from bookflow.operators.matching import bounded_broadcast
from bookflow.operators.tables import OPEN, redact
from bookflow.session import drop_scratch, materialize, scratch_dir, wide_rows
from bookflow.sources.stores import GZIP, opened_path, store

DOCUMENT = ["project_id", "owner", "document"]
# Positions of a run, bytes of a piece from which it is packed alone, of small pieces packed together, copied at once.
RUN_BITS, LARGE, TOGETHER, COPIED = 12, 256, 64 * 1024, 4 * 1024 * 1024
# Characters of a piece that order those of one position; only pieces that agree on them are unpacked for it.
HEAD, LEVEL = 64, 3
RUN = "project_id string, owner string, document int, place int, bucket long, file string, at long, first long, bytes long"


def project_lines(header: DataFrame, sections: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``project_id, section, pos, json``: the header line and one line per child row.

    ``sections`` maps a name to (table with ``project_id``, ordering column). No project is
    gathered, however large it is.
    """

    def lines(name: str, df: DataFrame, pos: Column) -> DataFrame:
        fields = [c for c in df.columns if c != "project_id"]
        return df.select(
            "project_id",
            F.lit(name).alias("section"),
            pos.cast("long").alias("pos"),
            flat_json(df, fields).alias("json"),
        )

    out = lines("project", safe_header(header), F.lit(0))
    for name, (df, order) in sections.items():
        out = out.unionByName(lines(name, df, F.col(order)))
    return out


def export_projects(
    header: DataFrame, sections: dict[str, tuple[DataFrame, str]], exported_at: Column
) -> DataFrame:
    """``project_id, document, place, pos, json``: the ordered pieces of one document per header row.

    ``header`` names its columns as the document does; model keys in it are left out. A section named
    ``chapters`` becomes the chapters of the document's book. A document's pieces by place, pos and json,
    with a comma between two of one place, are its text; without sections it is one piece. A child row is
    a piece, so no row, group or task holds a project.
    """
    stamp = F.date_format(exported_at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    out = safe_header(header).withColumn("exportedAt", stamp)
    names = list(sections)
    fields = [c for c in out.columns if c != "project_id" and not (c == "book" and "chapters" in sections)]
    title = F.to_json(F.struct("title")) if "chapters" in sections else F.lit("{}")
    numbered = W.partitionBy("project_id").orderBy("json")
    heads = (
        out.select("project_id", flat_json(out, fields).alias("json"), title.alias("book"))
        .withColumn("document", F.row_number().over(numbered))
    )
    first = [F.lit(0).alias("place"), F.lit(0).cast("long").alias("pos")]
    if not names:
        return heads.select("project_id", "document", *first, "json")
    for name in names:
        held = sections[name][0].select("project_id", F.lit(True).alias(f"__{name}")).distinct()
        heads = heads.join(held, "project_id", "left")
    heads = materialize(heads, "heads")

    def opened(json: Column) -> Column:
        return F.substring(json, 1, F.length(json) - 1)

    # an object never opens empty, so that a comma may follow
    made = [(0, opened(F.when(F.col("json") == "{}", '{"exportedAt":null}').otherwise(F.col("json"))))]
    for i, name in enumerate(names):
        held = F.col(f"__{name}").isNotNull()
        start, end = F.when(held, f',"{name}":['), F.when(held, "]")
        if name == "chapters":
            glue = F.when(F.col("book") == "{}", "").otherwise(",")
            book = F.concat(F.lit(',"book":'), opened(F.col("book")))
            start = F.when(held, F.concat(book, glue, F.lit('"chapters":['))).otherwise(book)
            end = F.when(held, "]}").otherwise("}")
        made += [(3 * i + 1, start), (3 * i + 3, end)]
    made.append((3 * len(names) + 1, F.lit("}")))
    pieces = F.array(*[F.struct(F.lit(place).alias("place"), text.alias("json")) for place, text in made])
    out = heads.select("project_id", "document", F.explode(pieces).alias("p")).select(
        "project_id", "document", "p.place", F.lit(0).cast("long").alias("pos"), "p.json"
    ).filter("json is not null")
    keys = heads.select("project_id", "document")
    for i, name in enumerate(names):
        df, order = sections[name]
        fields = [c for c in df.columns if c not in ("project_id", order)]
        rows = df.select("project_id", F.col(order).cast("long").alias("pos"), F.to_json(F.struct(*fields)).alias("json"))
        out = out.unionByName(
            rows.join(bounded_broadcast(keys), "project_id").select(
                "project_id", "document", F.lit(3 * i + 2).alias("place"), "pos", "json"
            )
        )
    return out


def flat_json(df: DataFrame, fields: list[str]) -> Column:
    """A JSON object of the fields; what an open column holds stands beside the named fields, which win."""
    kinds = dict(df.dtypes)
    loose = [c for c in fields if kinds[c] == OPEN]
    named = [c for c in fields if c not in loose]
    out = F.to_json(F.struct(*named))
    for c in loose:
        more = F.to_json(F.map_filter(c, lambda k, _: ~k.isin(*named)))
        glue = F.when(F.endswith(out, F.lit("{}")), "").otherwise(",")
        both = F.concat(F.substring(out, 1, F.length(out) - 1), glue, F.substring(more, 2, F.length(more)))
        out = F.when(F.coalesce(more, F.lit("{}")) == "{}", out).otherwise(both)
    return out


def safe_header(header: DataFrame) -> DataFrame:
    """``header`` without model keys, be they columns, fields of a struct or entries of a map."""
    out = redact(header)
    for name, kind in out.dtypes:
        if kind.startswith("map<string"):  # open columns too
            out = out.withColumn(name, F.map_filter(name, lambda k, _: ~k.isin("apiKey", "api_key")))
    return out


def write_lines(lines: DataFrame, path: str) -> None:
    (
        lines.repartitionByRange("project_id", "section", "pos")
        .sortWithinPartitions("project_id", "section", "pos")
        .write.partitionBy("project_id", "section")
        .json(path)
    )


def write_documents(documents: DataFrame, path: str, sections: int = 0, spent: str | None = None) -> None:
    """JSON documents below a folder per project: whole ones of a row, a line each, or the pieces of
    ``export_projects``, a gzip file per document.

    Pieces travel packed, as members of a gzip file. Tasks sort runs of them by position and write them to
    scratch; one task joins the runs of a document, which it neither sorts nor packs anew. Where tasks cannot
    open the files themselves, a document's task sorts its pieces, spilling, and writes plain text.

    With the number of ``sections`` their pieces are shuffled one section after the other, for pieces that are
    quick to make again. ``spent`` is a scratch folder that only the pieces are made of: it goes before the
    documents are joined.
    """
    if "place" not in documents.columns:
        documents.select("project_id", "json").write.partitionBy("project_id").text(path)
        return
    # never null, or the text writer would sort the rows anew by their folder and mix up the pieces
    folder = F.coalesce(non_empty(F.col("project_id")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    foldered = documents.withColumn("owner", F.col("project_id")).withColumn("project_id", folder)
    spark = documents.sparkSession
    scratch = scratch_dir(spark)
    target, kept = opened_path(spark, path), opened_path(spark, scratch)
    if not target or not kept:
        drop_scratch(spark, scratch)
        _write_text(foldered, path)
        if spent:
            drop_scratch(spark, spent)
        return
    files, root = store(target)
    if files.get_file_info(root).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    files.create_dir(root)
    section = F.greatest(F.floor((F.col("place") - 1) / 3), F.lit(0))
    parts = [foldered.filter(section == i) for i in range(sections + 1)] if sections else [foldered]
    with wide_rows(spark):
        for i, part in enumerate(parts):
            materialize(_write_runs(_packed(part), f"{kept}/pieces-{i}"), f"runs/{i}", scratch)
        if spent:
            drop_scratch(spark, spent)
        runs = spark.read.schema(RUN).parquet(*[f"{scratch}/runs/{i}" for i in range(len(parts))])
        dealt = runs.repartition(*DOCUMENT).sortWithinPartitions(*DOCUMENT, "place", "bucket")
        _join_runs(dealt, target).write.format("noop").mode("overwrite").save()
    drop_scratch(spark, scratch)


def _write_text(documents: DataFrame, path: str) -> None:
    dealt = documents.repartition(*DOCUMENT)
    listed = F.row_number().over(W.partitionBy(*DOCUMENT, "place").orderBy("pos", "json"))
    glued = dealt.withColumn("value", F.concat(F.when(listed > 1, ",").otherwise(""), F.col("json")))
    ordered = glued.sortWithinPartitions(*DOCUMENT, "place", "pos", "json")
    ordered.select("value", "project_id").write.partitionBy("project_id").text(path)


def _pack(data: bytes) -> bytes:
    return gzip.compress(data, LEVEL, mtime=0)


def _unpacked(data: bytes) -> bytes:
    return gzip.decompress(data) if data.startswith(GZIP) else data


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _packed(documents: DataFrame) -> DataFrame:
    """Pieces with a comma before each, as bytes: a large one is a member of a gzip file."""
    rows = documents.select(
        *DOCUMENT, "place", "pos", F.substring("json", 1, HEAD).alias("head"),
        F.concat(F.lit(","), "json").cast("binary").alias("data"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = (x.as_py() or b"" for x in batch.column("data"))
            made = [_pack(x) if len(x) >= LARGE else x for x in pieces]
            data = pa.array(made, batch.schema.field("data").type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], data], schema=batch.schema)

    return rows.mapInArrow(run, rows.schema)


def _members(rows: Iterable[tuple]) -> Iterator[bytes]:
    """Members of a gzip file with the pieces of ``pos, head, data`` in order; small ones share a member."""
    small = bytearray()
    for _, same in groupby(rows, key=lambda r: r[:2]):
        pieces = Counter(r[2] for r in same)
        for piece in sorted(pieces, key=_unpacked) if len(pieces) > 1 else pieces:
            for _ in range(pieces[piece]):
                if not piece.startswith(GZIP):
                    small += piece
                if small and (piece.startswith(GZIP) or len(small) > TOGETHER):
                    yield _pack(small)
                    small.clear()
                if piece.startswith(GZIP):
                    yield piece
    if small:
        yield _pack(small)


def _write_runs(packed: DataFrame, folder: str) -> DataFrame:
    """Runs of pieces, in files below ``folder``: of each where it is and how long its first member.

    A run holds neighbouring positions of one place, so a task holds no document.
    """
    keys = [*DOCUMENT, "place", "bucket"]
    bucketed = packed.withColumn("bucket", F.shiftright("pos", RUN_BITS))
    dealt = bucketed.repartition(*keys).sortWithinPartitions(*keys, "pos", "head")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        files.create_dir(root)
        name, at, made = f"{TaskContext.get().taskAttemptId()}", 0, []
        with files.open_output_stream(f"{root}/{name}", compression=None) as out:
            for key, rows in groupby(_rows(batches), key=lambda r: r[:5]):
                start, first = at, 0
                for member in _members(r[5:] for r in rows):
                    out.write(member)
                    at, first = at + len(member), first or len(member)
                made.append((*key, f"{folder}/{name}", start, first, at - start))
                if len(made) == 1000:
                    yield _batch(made)
                    made = []
        yield _batch(made)

    return dealt.select(*keys, "pos", "head", "data").mapInArrow(run, RUN)


_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}


def _batch(runs: list[tuple]) -> pa.RecordBatch:
    named = [c.split() for c in RUN.split(", ")]
    columns = zip(*runs, strict=True) if runs else [()] * len(named)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(columns, named, strict=True)], [name for name, _ in named]
    )


def _opened(file: str) -> pa.NativeFile:
    files, place = store(file)
    return files.open_input_file(place)


# What a folder's name cannot hold, as in Spark's writers.
_ESCAPED = {c: f"%{c:02X}" for c in [*range(1, 32), 127, *b"\"#%'*/:=?\\{[]^"]}


def _join_runs(runs: DataFrame, folder: str) -> DataFrame:
    """Write the documents of sorted runs. A file gets its name when it is whole, so a repeated task replaces it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        part = f"{root}/.part-{TaskContext.get().taskAttemptId()}"
        for (project, owner, document), own in groupby(_rows(batches), key=lambda r: r[:3]):
            with files.open_output_stream(part, compression=None) as out:
                held = bytearray()
                for _, rows in groupby(own, key=lambda r: r[3]):
                    for i, (file, at, first, size) in enumerate(r[5:] for r in rows):
                        with _opened(file) as source:
                            source.seek(at)
                            if i == 0:  # the place's first piece has no comma
                                held += _unpacked(source.read(first))[1:]
                                size -= first
                            if held and (size or len(held) > TOGETHER):
                                out.write(_pack(held))
                                held.clear()
                            while size:
                                data = source.read(min(size, COPIED))
                                out.write(data)
                                size -= len(data)
                out.write(_pack(held + b"\n"))
            name = "null" if owner is None else hashlib.sha256(owner.encode()).hexdigest()[:16]
            to = f"{root}/project_id={project.translate(_ESCAPED)}"
            files.create_dir(to)
            files.move(part, f"{to}/{name}-{document}.json.gz")
        yield from ()

    return runs.mapInArrow(run, "project_id string")
