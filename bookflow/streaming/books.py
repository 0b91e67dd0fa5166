"""Stream ingest: new book files below a folder are parsed once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from bookflow.schemas import BOOKS, CHAPTERS, REJECTS
from bookflow.sources.books import Library, parse_files
from bookflow.sources.text_files import name_files
from bookflow.streaming.state import read_batches, write_batch

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_books(
    spark: SparkSession, path: str, out: str, checkpoint: str, max_files: int = 10000
) -> StreamingQuery:
    """Parse the files that arrived below ``path`` since the last start, then stop."""
    source = (
        spark.readStream.format("binaryFile")
        .schema(FILES)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", str(max_files))
        .load(path)
    )

    def ingest(batch: DataFrame, batch_id: int) -> None:
        library = parse_files(name_files(batch), f"{out}/work/batch={batch_id}")
        write_batch(library.books, f"{out}/books", batch_id)
        write_batch(library.chapters, f"{out}/chapters", batch_id)
        write_batch(library.rejects, f"{out}/rejects", batch_id)

    return (
        source.writeStream.foreachBatch(ingest)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_library(spark: SparkSession, out: str) -> Library:
    return Library(
        read_batches(spark, f"{out}/books", BOOKS).drop("batch"),
        read_batches(spark, f"{out}/chapters", CHAPTERS).drop("batch"),
        read_batches(spark, f"{out}/rejects", REJECTS).drop("batch"),
    )
