"""Bloom filters of 64-bit hashes, built by tasks, merged by segment, and broadcast at a fixed bound."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .common import lean

#: Bits a key, in a power of two up to MAX_BITS (64 MB); a fuller filter answers yes more often.
BITS_A_KEY, MIN_BITS, MAX_BITS = 16, 1 << 16, 1 << 29
SEGMENT = 1 << 16


def positions(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    top = np.uint64(bits - 1)
    return h & top, (h >> np.uint64(32)) & top


def size(keys: int, each: int = BITS_A_KEY) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << (max(1, keys * each) - 1).bit_length()))


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set in the packed filter."""
    hit = lambda p: (bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
    a, b = positions(h, len(bits) * 8)
    return (hit(a) & hit(b)).astype(bool)


def fold(h: np.ndarray, bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(segment, once, twice) of a task's hashes: places set, and those set by two of the hashes."""
    a, b = positions(h, bits)
    place, n = np.unique(np.concatenate([a, b[a != b]]), return_counts=True)
    segment = (place >> np.uint64(16)).astype(np.int64)
    low = (place & np.uint64(SEGMENT - 1)).astype("<u2")
    at = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if len(place) else []
    for i, j in zip(at, [*at[1:], len(place)]):
        yield int(segment[i]), zlib.compress(low[i:j].tobytes(), 1), zlib.compress(low[i:j][n[i:j] > 1].tobytes(), 1)


def folded(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["segment", "once", "twice"])


FOLDED = "segment long, once binary, twice binary"


def gather(rows: DataFrame, bits: int, seen_twice: bool) -> np.ndarray:
    """Merge folded rows of all tasks into one packed set of bits / 8 bytes, once or twice seen.

    twice = a.twice | b.twice | (a.once & b.once) and once = a.once | b.once, in any order of rows.
    """

    @lean
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)  # of one segment at a time

        def out() -> Iterator[pa.RecordBatch]:
            x = twice if seen_twice else once
            if x.any():
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([zlib.compress(np.packbits(x, bitorder="little").tobytes(), 1)], pa.binary())], names=["segment", "bits"])

        for b in batches:
            for s, o, t in zip(*(c.to_pylist() for c in b.columns)):
                if s != at:
                    yield from out()
                    at, once[:], twice[:] = s, False, False
                o, t = (np.frombuffer(zlib.decompress(x), "<u2") for x in (o, t))
                twice[o[once[o]]] = True
                twice[t] = True
                once[o] = True
        yield from out()

    out = np.zeros(bits // 8, np.uint8)
    for s, packed in rows.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment long, bits binary").collect():  # bits / 8 bytes at most
        out[s * SEGMENT // 8 : (s + 1) * SEGMENT // 8] = np.frombuffer(zlib.decompress(packed), np.uint8)
    return out


def build(keys: DataFrame, n: int) -> np.ndarray:
    """The filter of a column of n 64-bit hashes."""
    bits = size(n)

    @lean
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if rows := list(fold(b.column(0).to_numpy().view(np.uint64), bits)):
                yield folded(rows)

    return gather(keys.mapInArrow(each, FOLDED), bits, False)


def pick(batch: pa.RecordBatch, key: str, bits: np.ndarray, inside: bool = True) -> pa.RecordBatch:
    """The rows of a batch whose 64-bit key the filter has, or has not."""
    hit = has(bits, batch.column(key).to_numpy().view(np.uint64))
    return batch.filter(pa.array(hit if inside else ~hit))


def matching(df: DataFrame, key: str, bits: Broadcast) -> DataFrame:
    """The rows of df whose 64-bit key the broadcast filter has: all that match, and a few others."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pick(b, key, bits.value)

    return df.mapInArrow(run, df.schema)
