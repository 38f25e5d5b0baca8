"""Chroma audio fingerprints of media columns, and the alignment of recordings.

Recordings are windowed, their spectra folded into twelve pitch classes, frames normalised and smoothed
in time. Sixteen filters compare areas of the frames' integral image (parts of time, parts of the
classes, both); each gives two bits in Gray code, which pack into a 32-bit code a frame. Frames are
rounded to integers before they are summed, so codes don't depend on how rows are batched.

Recordings with equal codes are one class. Queries' codes, once a run of equal ones, are indexes of a
bounded size that all classes are held against: each code that differs in one bit at most proposes an
offset, and every offset proposed is checked by the bit errors of all codes that overlap there. Codes of
unlike recordings often agree, so what they propose grows with the square of the corpus; it is made,
counted and checked in memory, a bounded number at a time, and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, mix, rolling, small_batches, stash

#: Samples a second, a frame, and from frame to frame.
RATE, FRAME, HOP = 8000, 256, 32
#: Bins are 31 Hz apart, which tells semitones apart from A4 on; lower ones would fall into their neighbours' classes.
LOWEST, HIGHEST = 427.0, 3600.0
SMOOTH = (1, 3, 4, 3, 1)
SPAN = 16
#: Codes of which a frame is the first need so many further frames.
REACH = SPAN + len(SMOOTH) - 2
#: (kind, first class, classes, frames), by a rule that varies all four.
FILTERS = tuple((k % 4, (k * 5) % (13 - h), h, w) for k, (h, w) in enumerate((h, w) for w in (4, 8, 12, 16) for h in (2, 4, 6, 12)))
GAP, MIN_VOTES, MAX_ERROR = 8, 3, 0.15
#: An overlap of so many codes (of a frame that none of the first one's shares) needs no votes besides one code.
LONG = REACH + 1
#: Codes of a block of queries; runs, codes proposed, and overlapping codes that a task handles at a time.
BLOCK, RUNS, HITS, CELLS = 1 << 21, 1 << 15, 1 << 20, 1 << 21
#: What a code may differ in.
_PROBES = np.array([0, *(1 << k for k in range(32))], np.uint32)


def _fold() -> np.ndarray:
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(f), 12))
    for i, x in enumerate(f):
        if LOWEST <= x <= HIGHEST:
            out[i, int(round(12 * np.log2(x / 440.0))) % 12] = 1.0
    return out


_FOLD, _HANN = _fold(), np.hanning(FRAME)


def frames(samples: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Pitch-class energies of the frames that begin at starts, of length 1 each; silence is 0."""
    out = np.empty((len(starts), 12))
    for a in range(0, len(starts), 4096):
        part = samples[starts[a : a + 4096, None] + np.arange(FRAME)[None, :]].astype(np.float64)
        part = (part - part.mean(1, keepdims=True)) * _HANN
        chroma = (np.abs(np.fft.rfft(part, axis=1)) ** 2) @ _FOLD
        norm = np.sqrt((chroma**2).sum(1, keepdims=True))
        out[a : a + 4096] = np.where(norm > 1e-6, chroma / np.maximum(norm, 1e-6), 0.0)
    return out


def codes(chroma: np.ndarray) -> np.ndarray:
    """A code for each frame from which REACH others follow."""
    n = len(chroma) - REACH
    if n <= 0:
        return np.empty(0, np.uint32)
    m = len(chroma) - len(SMOOTH) + 1
    level = np.rint(chroma * 1000).astype(np.int64)
    smooth = sum(w * level[i : i + m] for i, w in enumerate(SMOOTH))
    area = np.zeros((m + 1, 13), np.int64)
    area[1:, 1:] = smooth.cumsum(0).cumsum(1)
    t = np.arange(n)
    box = lambda a, b, y, z: area[t + b, z] - area[t + a, z] - area[t + b, y] + area[t + a, y]
    out = np.zeros(n, np.uint32)
    for k, (kind, y, h, w) in enumerate(FILTERS):
        z, half, mid = y + h, w // 2, y + h // 2
        if kind == 0:
            p, q = box(0, half, y, z), box(half, w, y, z)
        elif kind == 1:
            p, q = box(0, w, y, mid), box(0, w, mid, z)
        elif kind == 2:
            p, q = box(0, half, y, mid) + box(half, w, mid, z), box(half, w, y, mid) + box(0, half, mid, z)
        else:
            p, q = 2 * box(w // 4, w - w // 4, y, z), 2 * (box(0, w // 4, y, z) + box(w - w // 4, w, y, z))
        p, q = p + 1, q + 1
        level_k = (4 * q <= 5 * p).astype(np.uint32) + (q <= p) + (5 * q <= 4 * p)
        out |= (level_k ^ (level_k >> np.uint32(1))).astype(np.uint32) << np.uint32(2 * k)
    return out


def _samples(data: bytes | np.ndarray, pcm: str) -> np.ndarray:
    samples = np.frombuffer(data, np.uint8) if not isinstance(data, np.ndarray) else data
    return samples[: len(samples) // 2 * 2].view("<i2") if pcm == "s16" else samples


def fingerprint(data: bytes | np.ndarray, pcm: str = "u8") -> np.ndarray:
    """The codes of one recording: unsigned 8-bit (u8) or signed little-endian 16-bit (s16) mono samples."""
    samples = _samples(data, pcm)
    if len(samples) < FRAME:
        return np.empty(0, np.uint32)
    out, step = [], 1 << 15
    total = (len(samples) - FRAME) // HOP + 1
    for a in range(0, max(1, total - REACH), step):  # long recordings in parts that overlap
        out.append(codes(frames(samples, np.arange(a, min(total, a + step + REACH)) * HOP)))
    return np.concatenate(out)


def held(data: bytes | np.ndarray, pcm: str = "u8") -> np.ndarray:
    """The codes of a recording too short for fingerprint: a code a frame, the last frame held; less than a frame is filled with its mean."""
    samples = _samples(data, pcm)
    if not len(samples):
        return np.empty(0, np.uint32)
    if len(samples) < FRAME:
        samples = np.append(samples, np.full(FRAME - len(samples), np.rint(samples.mean())).astype(samples.dtype))
    own = frames(samples, np.arange((len(samples) - FRAME) // HOP + 1) * HOP)
    return codes(np.concatenate([own, np.repeat(own[-1:], REACH, 0)]))


def _run_starts(c: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.empty(0, np.int64)


def fingerprints(docs: DataFrame, id_col: str, media_col: str, pcm: str = "u8") -> DataFrame:
    """(id, n_samples, n_codes, lo, hi, codes): codes as little-endian bytes, lo and hi a digest of them, of short recordings one of the samples."""
    small_batches(docs.sparkSession)
    width = 2 if pcm == "s16" else 1

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows = []
                for data in part.column(1).to_pylist():
                    c = fingerprint(data or b"", pcm)
                    own = c.tobytes()
                    h = mix(c.astype(np.uint64), 21)
                    if not len(c):  # held frames are alike in most bits, so samples tell these apart
                        own, h = (c := held(data or b"", pcm)).tobytes(), mix(_samples(data or b"", pcm).astype(np.uint64), 22)
                    digest = [int(rolling(mix(h, k), len(h), 0x9E3779B97F4A7C15 + 2 * k)[0]) if len(h) else 0 for k in (1, 2)]
                    rows.append((len(data or b"") // width, len(c), *(x - (1 << 64) if x >> 63 else x for x in digest), own))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=["id", "n_samples", "n_codes", "lo", "hi", "codes"])

    picked = docs.select(docs[id_col].cast("long").alias("id"), docs[media_col].alias("media"))
    return picked.mapInArrow(run, "id long, n_samples long, n_codes long, lo long, hi long, codes binary")


def _flat(recordings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All codes of recordings, each one's first place and number, and all starts of runs: recording, place in it."""
    n = np.array([len(c) for c in recordings], np.int64)
    runs = [_run_starts(c) for c in recordings]
    own = np.repeat(np.arange(len(n)), np.array([len(r) for r in runs], np.int64))
    return np.concatenate([*recordings, np.empty(0, np.uint32)]), np.cumsum(n) - n, n, own, np.concatenate([*runs, np.empty(0, np.int64)])


def indexed(ids: np.ndarray, recordings: list[np.ndarray]) -> tuple:
    """Queries' ids and codes, and the starts of runs by code."""
    flat, first, n, own, at = _flat(recordings)
    key = flat[first[own] + at]
    order = np.argsort(key, kind="stable")
    return ids, flat, first, n, np.bincount(own, minlength=len(n)), key[order], own[order], at[order]


def _chunks(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, side="right")))
        yield a, b
        a = b


def _places(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1 and so on, count of each."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def search(recordings: list[np.ndarray], index: tuple) -> dict[str, np.ndarray]:
    """Each (own, query, offset) that a code proposes: votes, near, overlap, bit_errors, needed.

    near counts the codes that differ in one bit at most, votes the equal ones that are followed by
    another equal one GAP codes later; needed is how many codes the shorter recording has, once a run,
    if all of it overlaps.
    """
    ids, flat, first, n, runs, key, owner, at = index
    mine, begin, m, i, p = _flat(recordings)
    own_runs = np.bincount(i, minlength=len(m))
    packed, near, votes = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for r in range(0, len(p), RUNS):
        code = (mine[begin[i[r : r + RUNS]] + p[r : r + RUNS]][:, None] ^ _PROBES).ravel()
        low = np.searchsorted(key, code)
        there = np.flatnonzero((low < len(key)) & (np.append(key, np.uint32(0))[low] == code))
        low, exact, run = low[there], there % len(_PROBES) == 0, r + there // len(_PROBES)
        count = np.searchsorted(key, code[there], side="right") - low
        for a, b in _chunks(count, HITS):
            which, slot = np.repeat(np.arange(a, b), count[a:b]), _places(low[a:b], count[a:b])
            k, o, x, y = i[run[which]], owner[slot], p[run[which]], at[slot]
            pair = exact[which] & (x + GAP < m[k]) & (y + GAP < n[o])
            pair[pair] = mine[(begin[k] + x + GAP)[pair]] == flat[(first[o] + y + GAP)[pair]]
            u, where = np.unique(((k * len(ids) + o) << 32) + (x - y + (1 << 31)), return_inverse=True)
            packed.append(u)
            near.append(np.bincount(where, minlength=len(u)))
            votes.append(np.bincount(where[pair], minlength=len(u)))
    u, where = np.unique(np.concatenate(packed), return_inverse=True)
    near, votes = (np.bincount(where, np.concatenate(v), len(u)).astype(np.int64) for v in (near, votes))
    k, o = np.divmod(u >> 32, max(1, len(ids)))
    offset = (u & 0xFFFFFFFF) - (1 << 31)
    start = np.maximum(0, offset)
    over = np.minimum(m[k], n[o] + offset) - start
    wrong = np.zeros(len(u), np.int64)
    for a, b in _chunks(over, CELLS):
        c = over[a:b]
        bits = np.bitwise_count(mine[_places((begin[k] + start)[a:b], c)] ^ flat[_places((first[o] + start - offset)[a:b], c)])
        wrong[a:b] = np.add.reduceat(bits, np.cumsum(c) - c, dtype=np.int64)
    shorter = np.where(m[k] < n[o], own_runs[k], np.where(m[k] > n[o], runs[o], np.minimum(own_runs[k], runs[o])))
    needed = np.where(over == np.minimum(m[k], n[o]), shorter, np.iinfo(np.int64).max)
    return {"own": k, "query": o, "offset": offset, "votes": votes, "near": near, "overlap": over, "bit_errors": wrong, "needed": needed}


def passing(s: dict[str, np.ndarray], min_votes: int = MIN_VOTES, max_error: float = MAX_ERROR) -> np.ndarray:
    enough = (s["overlap"] >= LONG) | (s["near"] >= np.minimum(min_votes, s["needed"]))
    return enough & (s["bit_errors"] <= max_error * 32 * s["overlap"])


_FOUND = "match_id long, match_offset long, votes long, overlap long, bit_errors long"


def _matched(part: pa.RecordBatch, index: tuple, min_votes: int, max_error: float) -> pa.RecordBatch:
    """The classes of a batch with their best offset and all aligned queries of a block."""
    s = search([np.frombuffer(x, "<u4") for x in part.column("codes").to_pylist()], index)
    own = part.column("query_id")
    query = index[0][s["query"]] if len(s["query"]) else s["query"]
    same = own.is_valid().to_numpy(zero_copy_only=False)[s["own"]] & (own.fill_null(0).to_numpy()[s["own"]] == query)
    ok = passing(s, min_votes, max_error)
    order = np.lexsort((s["offset"], query, np.where(ok, -s["near"], 0), -s["votes"], ~ok, s["own"]))
    order = order[~same[order] & (ok | (s["votes"] > 0))[order]]
    k, best = np.unique(s["own"][order], return_index=True)
    at = np.full(part.num_rows, -1)
    at[k] = order[best]
    values = {"match_id": query, "match_offset": s["offset"], "votes": s["votes"], "overlap": s["overlap"], "bit_errors": s["bit_errors"], "near": s["near"], "aligned": ok}
    take = pa.array(at, mask=at < 0)
    cols = {c: pa.array(v).take(take) if len(v) else pa.nulls(part.num_rows, pa.bool_() if c == "aligned" else pa.int64()) for c, v in values.items()}
    order = order[ok[order]]
    _, one = np.unique(np.stack([s["own"][order], query[order]], 1), axis=0, return_index=True)
    every = order[one]
    ends = np.append(0, np.cumsum(np.bincount(s["own"][every], minlength=part.num_rows))).astype(np.int32)
    names = [f.split()[0] for f in _FOUND.split(", ")]
    matches = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(values[c][every].astype(np.int64)) for c in names], names))
    return pa.RecordBatch.from_arrays([*(part.column(c) for c in ("lo", "hi", "class_id")), *cols.values(), matches], names=["lo", "hi", "class_id", *cols, "matches"])


def align(docs: DataFrame, id_col: str = "doc_id", media_col: str = "media", query: Column | None = None, pcm: str = "u8", min_votes: int = MIN_VOTES, max_error: float = MAX_ERROR, block: int = BLOCK) -> DataFrame:
    """One row a row: id, n_samples, n_codes, class_id, match_id, match_offset, votes, overlap, bit_errors, aligned, matches.

    class_id is the least id with the same codes, or, of recordings with too few frames for a code (held), the
    same samples. matches are the query recordings (query: a condition
    on ``id``, by default ids divisible by 100) of other classes with which the row is aligned, each by
    its least id and once, at the offset with the most votes, then the most near codes, then the least
    offset; offset is in frames, the row's less the query's. overlap is the number of codes that overlap
    there, bit_errors what differs in them, votes the equal pairs of codes GAP apart. A row is aligned
    where bit_errors is within max_error and the overlap is LONG or min_votes codes, or all codes of a
    shorter recording that is all overlapped, agree but for one bit. match_id and what follows are of
    the aligned query with the most votes, then near codes, ties to the least id; where none is aligned,
    of the query and offset with the most votes. Null and empty recordings have no codes and no class;
    null ids are above all others; repeated rows are of one class; an empty table gives no rows. Other
    columns are not read.
    """
    spark = docs.sparkSession
    query = F.col("id") % 100 == 0 if query is None else query
    made = stash(fingerprints(docs, id_col, media_col, pcm), "fingerprints")
    group = made.where("n_codes > 0").groupBy("lo", "hi").agg(F.min("id").alias("class_id"), F.min(F.when(query, F.col("id"))).alias("query_id"), F.any_value("n_codes").alias("n_codes"), F.any_value("codes").alias("codes"))
    group = stash(group, "classes")
    asked = group.where("query_id is not null")
    blocks = max(1, -(-asked.agg(F.coalesce(F.sum("n_codes"), F.lit(0))).first()[0] // block))

    def against(k: int) -> DataFrame:
        rows = sorted(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).select("query_id", "codes").collect())  # a block at most
        index = spark.sparkContext.broadcast(indexed(np.array([r[0] for r in rows], np.int64), [np.frombuffer(r[1], "<u4") for r in rows]))

        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for a in range(0, b.num_rows, 64):
                    yield _matched(b.slice(a, 64), index.value, min_votes, max_error)

        return group.select("lo", "hi", "class_id", "query_id", "codes").mapInArrow(run, f"lo long, hi long, class_id long, {_FOUND}, near long, aligned boolean, matches array<struct<{_FOUND}>>")

    found = [stash(against(k), "matched") for k in range(blocks)]
    known = found[0]
    if blocks > 1:
        for other in found[1:]:
            known = known.union(other)
        rank = F.struct(~F.col("aligned"), -F.col("votes"), F.when(F.col("aligned"), -F.col("near")).otherwise(0), "match_id", "match_offset", F.struct("match_id", "match_offset", "votes", "overlap", "bit_errors", "aligned").alias("best"))
        known = known.groupBy("lo", "hi", "class_id").agg(F.min(F.when(F.col("match_id").isNotNull(), rank))["best"].alias("b"), F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches")).select("lo", "hi", "class_id", "b.*", "matches")
    out = made.select("id", "n_samples", "n_codes", "lo", "hi").join(known.drop("near"), ["lo", "hi"], "left")
    has = F.col("n_codes") > 0
    keep = lambda c: F.when(has, F.col(c)).alias(c)
    return out.select(F.col("id").alias(id_col), "n_samples", "n_codes", *(keep(c) for c in ("class_id", "match_id", "match_offset", "votes", "overlap", "bit_errors")), F.coalesce(has & F.col("aligned"), F.lit(False)).alias("aligned"), F.coalesce(keep("matches"), F.array().cast(known.schema["matches"].dataType)).alias("matches"))
