"""Shared pieces of the training-data operators: scratch tables, Arrow text slices, word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text handled by NumPy at a time; a single longer document is a slice of its own.
SLICE_BYTES = 512 << 10
#: Documents handled at a time at most, however short.
SLICE_ROWS = 2048
#: Arrow batches sent to Python are closed at this many bytes, so that long texts cannot pile up.
ARROW_BATCH_BYTES = 4 << 20

WORD = r"[^\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, where unset on one machine (tests), a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get() if known.isDefined() else None
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="astraframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def session_folder(spark: SparkSession) -> str:
    """Where this session's intermediate tables are, below the shared folder."""
    return f"{scratch_root(spark)}/astraframe/{spark.sparkContext.applicationId}"


def drop_stashed(spark: SparkSession, folder: str | None = None) -> None:
    """Remove a scope's intermediate tables, or all of this session's, when no DataFrame made from them is in use any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder or session_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_scopes: list[str] = []


@contextmanager
def stash_scope(spark: SparkSession) -> Iterator[str]:
    """A folder of their own for the tables stashed inside, to be dropped with drop_stashed when what is made of them is written."""
    _scopes.append(f"{session_folder(spark)}/scope-{uuid.uuid4().hex}")
    try:
        yield _scopes[-1]
    finally:
        _scopes.pop()


#: Rows that a file of a table has where their number is known.
STASH_ROWS = 1 << 18


def stash(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and reread it: lineage ends there and survives lost executors.

    rows: what df has at most, where that is known; it sets how many files there are.
    """
    path = f"{_scopes[-1] if _scopes else session_folder(df.sparkSession)}/{uuid.uuid4().hex}/{name}"
    (df if rows is None else df.coalesce(rows // STASH_ROWS + 1)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes besides rows, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        if int(spark.conf.get(key)) > ARROW_BATCH_BYTES:
            spark.conf.set(key, str(ARROW_BATCH_BYTES))
    except (TypeError, ValueError):
        spark.conf.set(key, str(ARROW_BATCH_BYTES))


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, giving freed memory back to the system when a task ends, since Python workers outlive tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about limit bytes of text and SLICE_ROWS documents at most, or one document."""
    i = batch.schema.get_field_index(column)
    text = batch.column(i).cast(pa.string())
    if text.null_count:
        text = pc.fill_null(text, "")
    batch = batch.set_column(i, column, text)
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, min(start + SLICE_ROWS, int(np.searchsorted(ends, base + limit, side="right"))))
        yield batch.slice(start, stop - start)
        start = stop


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, of batches that are sorted by keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for k, c in zip(keys, cols):
            new[1:] |= c[1:] != c[:-1]
            new[0] |= bool(held) and held[-1].column(k)[-1].as_py() != c[0]
        start = 0
        for at in np.flatnonzero(new).tolist():
            if at > start:
                held.append(batch.slice(start, at - start))
            if held:
                yield pa.Table.from_batches(held)
            held, start = [], at
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array without nulls, and its D + 1 offsets from 0."""
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_R = int(_rng.integers(1, 2**62)) * 4 + 1
_R_INV = pow(_R, -1, 2**64)
#: Bytes hashed with one table of powers; longer texts are cut at white space.
PIECE = 1 << 22


def powers(base: int, n: int, _kept: dict = {}) -> np.ndarray:  # noqa: B006  a cache
    """base ** i modulo 2 ** 64 for i < n."""
    have = _kept.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:  # doubling
            step = min(done, size - done)
            have[done : done + step] = have[:step] * np.uint64(pow(base, done, 2**64))
            done += step
        _kept[base] = have
    return have[:n]


def mix(h: np.ndarray, key: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values, another one for each key."""
    h = h ^ np.uint64((key * 0x9E3779B97F4A7C15 + 0x1234567) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashed: bool = True):
    """Words of white-space separated documents: their document, first byte, end, and 64-bit hash.

    A hash is a polynomial over the bytes, so equal words have equal hashes wherever they stand.
    """
    n = len(data)
    if not n:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, np.empty(0, np.uint64)
    space = SPACE[data]
    firsts, lasts = offsets[:-1], offsets[1:] - 1
    full = firsts <= lasts
    edge = np.empty(n, bool)
    edge[0], edge[1:] = True, space[:-1]
    edge[firsts[full]] = True
    starts = np.flatnonzero(edge & ~space)
    edge[-1], edge[:-1] = True, space[1:]
    edge[lasts[full]] = True
    ends = np.flatnonzero(edge & ~space) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    if not hashed:
        return doc, starts, ends, None
    table, out = _BYTE_LOWER if lower else _BYTE, np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + PIECE, side="right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[data[lo:hi]] * powers(_R, hi - lo), out=sums[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = (sums[e] - sums[s]) * powers(_R_INV, hi - lo)[s]
        a = b
    return doc, starts, ends, mix(out)


def rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of each width consecutive values; an odd base, another one for another hash."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    inverse = pow(base, -1, 2**64)
    for a in range(0, n, PIECE):
        b = min(n, a + PIECE)
        part = h[a : b + width - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers(base, len(part)), out=sums[1:])
        out[a:b] = (sums[width:] - sums[:-width]) * powers(inverse, b - a)
    return mix(out, base & 0xFFFF)


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")
