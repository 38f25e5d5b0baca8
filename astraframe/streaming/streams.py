"""Bounded streams over one unit, and unbounded ones over files as they arrive."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from ..operators import images, memory, tables
from ..sources.storage import open_file

#: Bytes of a chunk of a file.
CHUNK_BYTES = 64 * 2880


class Progress(NamedTuple):
    """How much of a file has been read: bytes up to now, and bytes in all."""

    done: int
    total: int


def stream_bytes(path: str, chunk: int = CHUNK_BYTES) -> Iterator[tuple[Progress, bytes]]:
    """The bytes of a file in order, a chunk at a time, each with the progress after it."""
    file = open_file(path)
    try:
        for at in range(0, file.size, chunk):
            data = file.at(at, chunk)
            yield Progress(at + len(data), file.size), data
    finally:
        file.close()


def stream_rows(spark: SparkSession, path: str, **options: object) -> Iterator[Row]:
    """Rows of a table in order of partitions; the next partition is fetched while one is read."""
    return tables.read_table(spark, path, **options).toLocalIterator(prefetchPartitions=True)


def stream_normalized_image(spark: SparkSession, path: str, plane: int = 0, mode: str = "standard", **options: object) -> Iterator[tuple[int, int, float]]:
    """(x, y, value) of each sample of a plane."""
    df = images.normalized(images.read_image(spark, path, plane, **options), mode=mode).select("x", "y", "value")
    return (tuple(r) for r in df.toLocalIterator(prefetchPartitions=True))


def arriving(spark: SparkSession, folder: str, relation: str = "table", schema: T.StructType | str | None = None, max_files: int = 100, **options: object) -> DataFrame:
    """A streaming DataFrame of a relation over files that arrive in a folder; tables and images need a schema.

    Watermarks, windows and stateful operators are Structured Streaming's own.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.{fit,fits,fts,fit.gz,fits.gz,fts.gz}").option("maxFilesPerTrigger", max_files).load(folder)
    return memory.relation(files.select("path", "content"), relation, schema, **options)
