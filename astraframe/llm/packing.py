"""Best-fit packing of tokenized documents into sequences, by large-item matching.

A placement depends only on how many pieces of each length there are, so the whole corpus is packed
from a histogram of at most ``capacity`` numbers: pieces above a third of the capacity (at most two
of them fit in a sequence) are matched greedily, longest with the longest that fits beside it; all
shorter ones then go, longest first, into the tightest gap that holds them. The plan is a list of
runs "ranks a.. of length s go to sequences b.., at this offset", whose size is bounded by the
capacity and not by the corpus; each piece finds its place from its length and its rank in it.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, small_batches, stash, text_slices
from .tokens import encoder, parts

#: Ranks of a length are below this, as are lengths times it in 64 bits.
_RANKS = 1 << 44


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, ranks, first sequence, offset), and the number of sequences."""
    left = {s: n for s, n in counts.items() if n > 0}
    used, runs, gaps, bins = dict.fromkeys(left, 0), [], {}, 0

    def place(s: int, n: int, first: int, offset: int) -> None:
        runs.append((s, used[s], n, first, offset))
        used[s] += n
        left[s] -= n

    def free(gap: int, first: int, n: int) -> None:
        if gap:
            if gap not in gaps:
                bisect.insort(order, gap)
            gaps.setdefault(gap, []).append((first, n))

    order: list[int] = []
    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        k = bisect.bisect_right(large, capacity - a) - 1
        while k >= 0 and (not left[large[k]] or large[k] == a and left[a] < 2):
            k -= 1
        if k < 0:
            n = left[a]
            place(a, n, bins, 0)
            free(capacity - a, bins, n)
        else:
            b = large[k]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            place(a, n, bins, 0)
            place(b, n, bins, a)
            free(capacity - a - b, bins, n)
        bins += n
    for s in sorted((s for s in left if left[s]), reverse=True):
        while left[s]:
            k = bisect.bisect_left(order, s)
            if k == len(order):  # no gap holds it: open a sequence as often as whole sequences fill
                each = min(capacity // s, left[s])
                n = left[s] // each
                for j in range(each):
                    place(s, n, bins, j * s)
                free(capacity - each * s, bins, n)
                bins += n
                continue
            gap = order[k]
            first, n = gaps[gap].pop()
            take = min(n, left[s])
            if take < n:
                gaps[gap].append((first + take, n - take))
            if not gaps[gap]:
                del gaps[gap]
                order.pop(k)
            place(s, take, first, capacity - gap)
            free(gap - s, first, take)
    return np.array(sorted(runs), np.int64).reshape(-1, 5), bins


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32, sequence_id, offset; with keep_ids also ids.

    A document is its ids and end_id. A longer one than capacity is cut into pieces of capacity, of
    which the first may be shorter. Null and empty texts are one end_id; a null id stays null;
    repeated rows are packed each; an empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    picked = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    schema = "id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + (", ids array<int>" if keep_ids else "")

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part, seen, end = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), np.array([end_id], np.uint32)
        for batch in batches:
            for some in text_slices(batch):
                out: list[tuple] = []
                for i, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    ids = np.concatenate([*(e.ids(p) for p in parts(text or "")), end])
                    first = len(ids) % capacity or capacity
                    for k, stop in enumerate(range(first, len(ids) + 1, capacity)):
                        start = max(0, stop - capacity) if k else 0
                        own = ids[start:stop]
                        out.append((i, k, start, stop - start, zlib.crc32(own), part, int(seen[stop - start]), own.astype(np.int32) if keep_ids else None))
                        seen[stop - start] += 1
                cols = list(zip(*out))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in list(zip(cols, kinds))[: 7 + keep_ids]], names=[x.split()[0] for x in schema.split(", ")])

    pieces = stash(picked.mapInArrow(cut, schema), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = by_part.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count("*")).collect()}  # at most capacity rows
    runs, _ = plan_bins(counts, capacity)
    key = runs[:, 0] * _RANKS + runs[:, 1]

    @lean
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            run = runs[np.searchsorted(key, length * _RANKS + rank, side="right") - 1] if b.num_rows else runs[:0]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4]), *([b.column("ids")] if keep_ids else [])], names=names)

    names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
    ranked = pieces.join(before, ["length", "part"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"), *(["ids"] if keep_ids else []))
    return ranked.mapInArrow(put, f"`{id_col}` long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids array<int>" if keep_ids else ""))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, of pack(..., keep_ids=True): sequence_id, ids in order of offset."""
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
