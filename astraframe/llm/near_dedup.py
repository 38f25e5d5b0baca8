"""MinHash near-dedup with odd sketches.

1. A document's set of word shingles gives 128 MinHash samples, 32 band keys of four samples each, a
   512-bit odd sketch of the samples (each flips one bit, so the XOR of two sketches has a bit for
   what the samples don't share) and a 128-bit digest of the set. Equal sets are one vertex.
2. Vertices that share a band key are a bucket. Each member is a candidate with the bucket's two
   pivots; XOR population counts discard pairs whose estimate is far below the threshold, and the
   others are confirmed on full sets. A family of near copies becomes a star of few pivots.
3. Buckets that then still hold two components give their other pairs, those between components:
   sketches are compared in memory, by size of set and in blocks, and each vertex's NEAREST
   candidates are confirmed on full sets. Vertices with further ones are only tied to each other.
4. Ties' components that still are not of one component of links are rare, and are compared as a
   whole: sets are dealt over pairs of blocks, and pairs are confirmed, nearest first, if their
   sketches allow it and no link connects them already. So many texts that are alike, but less than
   the threshold, cost a copy of each set a block and not one a pair.
5. The confirmed links' components are the result.

No pair within a component is confirmed. At a similarity of 0.8 a pair shares no band with a chance of 5e-8, and an estimate is 0.2 too
low with one of about 1e-8. Components are found by contraction: each vertex points to its neighbour
of least random rank, edges are contracted, and what is left goes on; no step gathers a component.
Keys of many rows (a bucket, a hub) are only joined with one row a key, which Spark's adaptive skew
join splits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blooms
from .common import drop_stashed, grouped, lean, mix, powers, raw, rolling, small_batches, stash, stash_scope, text_slices, words_of

BANDS, ROWS, ODD_BITS = 32, 4, 512
SAMPLES = BANDS * ROWS
#: Vertices of a block whose sketches one task compares with those of another, and pairs of a hub's run.
BLOCK, RUN = 4096, 4096
#: Pairs of each vertex in a bucket that are confirmed one by one, of those that pivots leave.
NEAREST = 1
#: Sets and shingles of a block of what then is left.
BLOCK_SETS, BLOCK_SHINGLES = 400, 400_000
#: Estimates below the threshold by more than this are discarded; over five standard deviations.
MARGIN = 0.2
_SHINGLE = 0x9FB21C651E98DF25
_WORDS = tuple(f"w{i}" for i in range(ODD_BITS // 64))
_ODD = f"struct<{', '.join(f'{w}: long' for w in _WORDS)}>"
_rng = np.random.default_rng(77)
_XOR = _rng.integers(0, 2**32, SAMPLES, np.uint32)
_MUL = _rng.integers(0, 2**31, SAMPLES, np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles, sorted; texts of fewer words are one shingle."""
    doc, _, _, h = words_of(data, offsets, lower=True)
    n = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.cumsum(n) - n
    grams = rolling(h, words, _SHINGLE)
    inside = doc[: len(grams)] == doc[words - 1 :] if len(grams) else np.empty(0, bool)
    owners, hashes = [doc[: len(grams)][inside]], [grams[inside]]
    for k in range(1, words):
        short = np.flatnonzero(n == k)
        if len(short):
            total = sum(h[first[short] + j] * powers(_SHINGLE, words)[j] for j in range(k))
            owners.append(short)
            hashes.append(mix(total, 1000 + k))
    owner, hashed = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((hashed, owner))
    owner, hashed = owner[order], hashed[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (hashed[1:] != hashed[:-1])]) if len(owner) else np.empty(0, bool)
    return owner[new], hashed[new]


def digests(owner: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents that have shingles, where each begins, and the 128-bit digest of each set."""
    at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, np.int64)
    if not len(at):
        return at, at, at, at
    return owner[at], at, *(mix(np.add.reduceat(mix(hashed, k), at), k).view(np.int64) for k in (11, 12))


def samples(hashed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash samples, one row a document."""
    h, out = (hashed >> np.uint64(32)).astype(np.uint32), np.empty((len(at), SAMPLES), np.uint32)
    for i in range(SAMPLES):
        out[:, i] = np.minimum.reduceat((h ^ _XOR[i]) * _MUL[i], at)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    m = minima.astype(np.uint64).reshape(len(minima), BANDS, ROWS)
    two = [m[:, :, i] | (m[:, :, i + 1] << np.uint64(32)) for i in (0, 2)]
    return mix(mix(two[0] + np.arange(BANDS, dtype=np.uint64)[None, :]) ^ two[1], 5)


def odd_sketches(minima: np.ndarray) -> np.ndarray:
    """The parity of the number of samples in each of ODD_BITS places, as 64-bit words."""
    out, row = np.zeros((len(minima), ODD_BITS // 64), np.uint64), np.arange(len(minima))
    for i in range(SAMPLES):  # a sample flips one bit of each row
        place = mix(minima[:, i].astype(np.uint64) | np.uint64(i << 32), 9) % np.uint64(ODD_BITS)
        out[row, (place >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (place & np.uint64(63))
    return out


def estimate(odd: np.ndarray) -> np.ndarray:
    """Similarity from the population count of the XOR of two sketches."""
    return 1 + ODD_BITS / (4 * SAMPLES) * np.log(np.maximum(1e-9, 1 - 2 * odd / ODD_BITS))


def most_odd(percent: int) -> int:
    """The most differing bits of two sketches that are not far below the threshold."""
    return int(np.searchsorted(-estimate(np.arange(ODD_BITS // 2)), MARGIN - percent / 100, side="right")) - 1


def differing(a: Column, b: Column) -> Column:
    """The population count of the XOR of two sketches."""
    out = F.lit(0)
    for w in _WORDS:
        out = out + F.bit_count(a[w].bitwiseXOR(b[w]))
    return out


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (v, root): the same root for all vertices that edges connect, some vertex of theirs.

    Each round's tables have no more rows than its edges have ends, so small ones are small files.
    """
    maps: list[DataFrame] = []
    edges = stash(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while n := edges.count():
        rank = lambda c: F.xxhash64(F.lit(len(maps)), c)  # noqa: E731, B023  a bijection of vertices, another one each round
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
        least = both.groupBy("v").agg(F.min_by("u", rank("u")).alias("u"))
        parent = stash(least.select("v", F.when(rank("u") < rank("v"), F.col("u")).otherwise(F.col("v")).alias("p")), "parents", 2 * n)
        maps.append(parent)
        left = edges.join(parent.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(parent.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        edges = stash(left.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges", n)
    if not maps:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    out = maps[0].withColumnRenamed("p", "root")
    for m in maps[1:]:
        out = out.join(m.select(F.col("v").alias("root"), "p"), "root", "left").select("v", F.coalesce("p", "root").alias("root"))
    return stash(out, "components")


def joined_components(label: DataFrame, links: DataFrame) -> DataFrame:
    """label, (v, root), after links (a, b) between its components and other vertices."""
    for c in ("a", "b"):
        links = links.join(label.select(F.col("v").alias(c), F.col("root").alias("to")), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
    merged = components(links)
    moved = label.join(merged.select(F.col("v").alias("root"), F.col("root").alias("to")), "root", "left").select("v", F.coalesce("to", "root").alias("root"))
    return stash(moved.unionByName(merged.join(label, "v", "left_anti")), "labels")


def sketched(source: DataFrame, words: int) -> DataFrame:
    """(id, text) to (id, n, lo, hi, bands, odd): number of shingles, digest, band keys and sketch of each row's set."""

    @lean
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                owner, hashed = shingle_sets(*raw(part.column("text")), words)
                doc, at, lo, hi = digests(owner, hashed)
                n = np.bincount(owner, minlength=part.num_rows)
                full = np.full(part.num_rows, -1)
                full[doc] = np.arange(len(doc))
                index = pa.array(full, mask=full < 0)
                minima = samples(hashed, at) if len(doc) else np.empty((0, SAMPLES), np.uint32)
                bands = pa.ListArray.from_arrays(np.arange(0, (len(doc) + 1) * BANDS, BANDS, np.int32), pa.array(band_keys(minima).view(np.int64).ravel()))
                odd = pa.StructArray.from_arrays([pa.array(w.view(np.int64)) for w in np.ascontiguousarray(odd_sketches(minima).T)], list(_WORDS))
                found = [pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), bands, odd]
                found = [x.take(index) for x in found] if len(doc) else [pa.nulls(part.num_rows, x.type) for x in found]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), *found], names=["id", "n", "lo", "hi", "bands", "odd"])

    return source.select("id", "text").mapInArrow(sketch, f"id long, n long, lo long, hi long, bands array<long>, odd {_ODD}")


def pivot_pairs(vertex: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(hub, v, salt): each member of a bucket with the bucket's two pivots, where sizes and sketches allow a link.

    Pivots are the least vertices by two orders that all buckets share, so the members of a family
    meet few pivots, and rows grow with the members and not with their pairs. salt numbers runs of
    RUN pairs: a hub of many pairs has many runs.
    """
    pairs = members.select("v", F.explode(F.array_distinct(F.array("p", "q"))).alias("hub")).where("hub <> v").distinct()
    own, of_hub = vertex.select("v", "n", "odd"), vertex.select(F.col("v").alias("hub"), F.col("n").alias("hub_n"), F.col("odd").alias("hub_odd"))
    alike = (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")) & (differing(F.col("odd"), F.col("hub_odd")) <= most_odd(percent))
    return salted(pairs.join(own, "v").join(of_hub, "hub").where(alike).select("hub", "v"))


def salted(pairs: DataFrame) -> DataFrame:
    return stash(pairs.sortWithinPartitions("hub").withColumn("salt", F.shiftright(F.monotonically_increasing_id(), RUN.bit_length() - 1)), "pairs")


def other_pairs(vertex: DataFrame, members: DataFrame, label: DataFrame, percent: int, nearest: int, block: int) -> DataFrame:
    """(hub, v, tie): pairs of one bucket but of two components, the nearest alike of each vertex; and ties of vertices that have more.

    Buckets of one component are done. The others are split by size of set (a link is within a class
    of sizes or between neighbours), then dealt over pairs of blocks; sketches are compared in
    memory. Ties are stars, so rows grow with the members and not with their pairs.
    """
    base = math.log(max(100 / percent, 1.0001)) * 1.000001
    named = members.select("key", "v").join(label, "v", "left").select("key", "v", F.coalesce("root", "v").alias("comp"))
    several = named.groupBy("key").agg(F.min("comp").alias("one"), F.max("comp").alias("two")).where("one <> two").select("key")
    open_ = named.join(several, "key").join(vertex.select("v", "n", "odd"), "v").withColumn("class", F.floor(F.log("n") / base))
    open_ = open_.withColumn("c", F.explode(F.array("class", F.col("class") + 1))).withColumn("below", F.col("c") != F.col("class")).drop("class")
    sized = open_.groupBy("key", "c").agg(F.count("*").alias("all"), F.count_if(~F.col("below")).alias("own")).where("`all` > 1 and own > 0")
    sized = sized.select("key", "c", F.ceil(F.col("all") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("v"), F.col("blocks").cast("long")).cast("int")
    dealt = open_.join(sized, ["key", "c"]).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "c", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "below", "v", "comp", "n", "odd.*")
    most, order = most_odd(percent), ["key", "c", "i", "j"]

    def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
        get = lambda c: t.column(c).to_numpy()
        v, comp, n, mine, below = get("v"), get("comp"), get("n"), get("mine"), get("below")
        cross = get("i")[0] != get("j")[0]
        if len(v) < 2 or (comp == comp[0]).all():
            return
        odd = np.stack([get(w) for w in _WORDS], 1).view(np.uint64)
        hub, leaf, tied = [], [], np.arange(len(v))
        for x in range(1, len(v)):
            y = np.flatnonzero(~(below[:x] & below[x]) & (100 * np.minimum(n[:x], n[x]) >= percent * np.maximum(n[:x], n[x])) & (mine[:x] != mine[x] if cross else True))
            y = y[comp[y] != comp[x]]
            if not len(y):
                continue
            off = np.bitwise_count(odd[y] ^ odd[x]).sum(1, dtype=np.int64)
            near = off <= most
            y = y[near][np.argsort(off[near], kind="stable")]
            hub.append(np.full(len(y[:nearest]), v[x]))
            leaf.append(v[y[:nearest]])
            if len(y) > nearest:
                tied[np.isin(tied, tied[y[nearest:]])] = tied[x]
        if hub:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hub)), pa.array(np.concatenate(leaf)), pa.array(np.zeros(sum(map(len, hub)), bool))], names=["hub", "v", "tie"])
        more = np.flatnonzero(tied != np.arange(len(v)))
        if len(more):
            yield pa.RecordBatch.from_arrays([pa.array(v[tied[more]]), pa.array(v[more]), pa.array(np.ones(len(more), bool))], names=["hub", "v", "tie"])

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, order):
            yield from found(group)

    return dealt.repartition(*order).sortWithinPartitions(*order, "v").mapInArrow(compare, "hub long, v long, tie boolean")


def full_sets(source: DataFrame, needs: DataFrame, words: int) -> tuple[DataFrame, Broadcast]:
    """(lo, hi, shingles) of the sets of needs (id, lo, hi), and some others: made anew of the documents that a Bloom filter of ids lets pass.

    Digests tell rows of one id apart; a task makes each set once. The filter is no longer needed once the rows are written.
    """
    spark = needs.sparkSession
    wanted = spark.sparkContext.broadcast(blooms.build(needs.select(F.xxhash64("id").alias("mark")).distinct(), needs.count()))

    @lean
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in text_slices(blooms.pick(batch, "mark", wanted.value)):
                owner, hashed = shingle_sets(*raw(part.column("text")), words)
                _, at, lo, hi = digests(owner, hashed)
                keep = [k for k, d in enumerate(zip(lo.tolist(), hi.tolist())) if d not in seen and not seen.add(d)]
                ends = np.append(at[1:], len(hashed)) if len(at) else at
                yield pa.RecordBatch.from_arrays([pa.array(lo[keep], pa.int64()), pa.array(hi[keep], pa.int64()), pa.array([hashed[at[k] : ends[k]].tobytes() for k in keep], pa.binary())], names=["lo", "hi", "shingles"])

    return source.select("text", F.xxhash64("id").alias("mark")).mapInArrow(make, "lo long, hi long, shingles binary"), wanted


def confirmed(source: DataFrame, vertex: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """(hub, v, salt) to the links (a, b) among them, on full sets, which are shuffled once a pair.

    A hub's set goes to each of its runs and is held there while the others stream by.
    """
    needs = pairs.select("hub", "salt", "v", F.lit(1).alias("leaf")).unionByName(pairs.select("hub", "salt", F.col("hub").alias("v"), F.lit(0).alias("leaf")).distinct())
    needs = stash(needs.join(vertex.select("v", "id", "lo", "hi"), "v"), "needs")
    sets, wanted = full_sets(source, needs, words)
    dealt = sets.join(needs, ["lo", "hi"]).select("hub", "salt", "leaf", "v", "shingles").repartition("hub", "salt").sortWithinPartitions("hub", "salt", "leaf", "v")

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own = None, np.empty(0, np.uint64)
        for batch in batches:
            hub, salt, leaf, v = (batch.column(c).to_numpy() for c in ("hub", "salt", "leaf", "v"))
            data, offsets = raw(batch.column("shingles"))
            flat, at = np.frombuffer(data.tobytes(), np.uint64), offsets // 8
            begins = np.flatnonzero(np.concatenate([[True], (hub[1:] != hub[:-1]) | (salt[1:] != salt[:-1])])) if len(hub) else []
            for a, b in zip(begins, [*begins[1:], len(hub)]):
                if (hub[a], salt[a]) != current:
                    current, own = (hub[a], salt[a]), flat[at[a] : at[a + 1]]  # the hub's set comes first
                rest = a + np.flatnonzero(leaf[a:b] == 1)
                if not len(rest):
                    continue
                first, last = at[rest[0]], at[rest[-1] + 1]
                place = np.minimum(np.searchsorted(own, flat[first:last]), len(own) - 1)
                common = np.add.reduceat((own[place] == flat[first:last]).astype(np.int64), at[rest] - first)
                size = at[rest + 1] - at[rest]
                hit = v[rest[100 * common >= percent * (size + len(own) - common)]]
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), hub[a])), pa.array(hit)], names=["a", "b"])

    links = stash(dealt.mapInArrow(compare, "a long, b long"), "links")
    wanted.unpersist()
    return links


def block_links(odd: np.ndarray, sets: list[np.ndarray], comp: np.ndarray, side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links that connect the components of a block's sets, or, with side, those of two blocks' sets."""
    size, most = np.array([len(s) for s in sets]), most_odd(percent)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    begin, own, comp, out = np.cumsum(size) - size, np.zeros(size.sum(), bool), comp.copy(), []
    for x in range(1, len(sets)):
        y = np.flatnonzero((comp[:x] != comp[x]) & (100 * np.minimum(size[:x], size[x]) >= percent * np.maximum(size[:x], size[x])) & (True if side is None else side[:x] != side[x]))
        off = np.bitwise_count(odd[y] ^ odd[x]).sum(1, dtype=np.int64)
        y = y[off <= most][np.argsort(off[off <= most], kind="stable")]
        mine, step = ids[begin[x] : begin[x] + size[x]], 4
        own[mine] = True
        while len(y):
            part, y = y[:step], y[step:]
            n = size[part]
            spread = np.repeat(begin[part] - np.cumsum(n) + n, n) + np.arange(n.sum())
            common = np.add.reduceat(own[ids[spread]].astype(np.int64), np.cumsum(n) - n)
            for z in part[100 * common >= percent * (n + size[x] - common)].tolist():
                if comp[z] != comp[x]:
                    out.append((x, z))
                    comp[comp == comp[z]] = comp[x]
            y, step = y[comp[y] != comp[x]], min(256, step * 2)
        own[mine] = False
    return out


def rest_links(source: DataFrame, vertex: DataFrame, ties: DataFrame, label: DataFrame, words: int, percent: int, block_sets: int) -> DataFrame:
    """The links (a, b) between components in what ties (a, b) connect."""
    tied = components(ties).join(label.select("v", F.col("root").alias("to")), "v", "left").select("root", "v", F.coalesce("to", "v").alias("comp"))
    tied = tied.join(vertex.select("v", "id", "lo", "hi", "n", "odd"), "v")
    blocks = F.ceil(F.greatest(F.count("*") / block_sets, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    open_ = tied.groupBy("root").agg(F.min("comp").alias("one"), F.max("comp").alias("two"), blocks).where("one <> two").select("root", "blocks")
    needs = stash(tied.join(open_, "root"), "needs")
    sets, wanted = full_sets(source, needs, words)
    mine = F.pmod(F.xxhash64("v"), F.col("blocks").cast("long")).cast("int")
    dealt = sets.join(needs, ["lo", "hi"]).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    order = ["root", "i", "j"]
    dealt = dealt.select("root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "v", "comp", "odd.*", "shingles").repartition(*order).sortWithinPartitions(*order, "v")

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, order):
            v = t.column("v").to_numpy()
            at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))  # a set that several tasks made comes several times
            t, v = t.take(at), v[at]
            odd = np.stack([t.column(w).to_numpy() for w in _WORDS], 1).view(np.uint64)
            side = t.column("mine").to_numpy() if t.column("i")[0] != t.column("j")[0] else None
            found = block_links(odd, [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()], t.column("comp").to_numpy(), side, percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([v[x[k]] for x in found]) for k in (0, 1)], names=["a", "b"])

    links = stash(dealt.mapInArrow(compare, "a long, b long"), "links")
    wanted.unpersist()
    return links


def clusters(source: DataFrame, words: int, percent: int, nearest: int = NEAREST, block: int = BLOCK, block_sets: int = BLOCK_SETS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, text) to (id, n, lo, hi, ...) of each row, its vertices (v, lo, hi, id, ...), and the (v, root) of all linked ones."""
    rows = stash(sketched(source, words), "sketches")
    vertex = rows.where("n > 0").groupBy("lo", "hi").agg(F.min("id").alias("id"), *(F.any_value(c).alias(c) for c in ("n", "bands", "odd")))
    vertex = stash(vertex.withColumn("v", F.monotonically_increasing_id()), "vertices")
    banded = vertex.select("v", F.explode("bands").alias("key"))
    pivots = banded.groupBy("key").agg(F.count("*").alias("n"), *(F.min_by("v", F.xxhash64(F.lit(k), "v")).alias(c) for k, c in ((1, "p"), (2, "q")))).where("n > 1")
    members = stash(banded.join(pivots.select("key", "p", "q"), "key"), "members")
    tested = pivot_pairs(vertex, members, percent)
    label = components(confirmed(source, vertex, tested, words, percent))
    ends = (F.least("hub", "v").alias("a"), F.greatest("hub", "v").alias("b"))
    others = stash(other_pairs(vertex, members, label, percent, nearest, block), "others")
    pairs = others.where("not tie").select(*ends).distinct().join(tested.select(*ends), ["a", "b"], "left_anti")
    pairs = salted(pairs.select(F.col("a").alias("hub"), F.col("b").alias("v")))
    if pairs.count() and not (links := confirmed(source, vertex, pairs, words, percent)).isEmpty():
        label = joined_components(label, links)
    ties = others.where("tie").select(*ends)
    if not ties.isEmpty() and not (links := rest_links(source, vertex, ties, label, words, percent, block_sets)).isEmpty():
        label = joined_components(label, links)
    return rows, vertex, label


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, nearest: int = NEAREST, block: int = BLOCK, block_sets: int = BLOCK_SETS) -> DataFrame:
    """One row a row: id, n_shingles, component_id, kept.

    Texts are taken in lower case (A-Z), their words are runs of anything but ASCII white space; a
    text of fewer words than a shingle is one shingle. Rows are linked at 100 * intersection >=
    percent * union; component_id is the least id that links reach. Null and empty texts have no
    shingles and are linked with nothing. Null ids count as greater than all others: a component of
    null ids alone has a null component_id, and its rows are kept. Repeated rows are linked and, as
    they share their id, kept alike; rows of one id with different texts are judged each. An empty
    table gives no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    source = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows, vertex, label = clusters(source, words, percent, nearest, block, block_sets)
    linked = label.join(vertex.select("v", "id"), "v")
    named = linked.join(linked.groupBy("root").agg(F.min("id").alias("least")), "root").select("v", "least")
    named = stash(vertex.select("v", "lo", "hi", "id").join(named, "v", "left").select("lo", "hi", F.coalesce("least", "id").alias("component")), "named")
    out = rows.select("id", "n", "lo", "hi").join(named, ["lo", "hi"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, unchanged, less all but one of each component: that of the least id (null above all), then the first.

    Rows without shingles stay. No text is written, and only texts are shuffled whose id a Bloom filter
    of the ids of rows that go lets pass; those are told by id and digest, which are made anew. docs
    is read several times and must give the same rows each time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with stash_scope(spark) as own:
        rows, vertex, label = clusters(docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")), words, percent)
        group = vertex.select("v", "lo", "hi").join(label, "v", "left").select("lo", "hi", F.coalesce("root", "v").alias("group"))
        found = stash(rows.where("n > 0").groupBy("id", "lo", "hi").agg(F.count("*").alias("rows")).join(group, ["lo", "hi"]), "found")
        least = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id")))["id"].alias("least")
        several = found.groupBy("group").agg(least, F.sum("rows").alias("all")).where("`all` > 1").select("group", "least")
        families = stash(found.join(several, "group").withColumn("first", F.col("id").eqNullSafe(F.col("least"))), "families")
        ties = families.where("first").groupBy("group").agg(F.sum("rows").alias("firsts")).where("firsts > 1").select("group", F.lit(True).alias("tie"))
        open_ = families.join(ties, "group", "left").where("not first or tie")
    gone = stash(open_.select(F.col("id").alias("of"), "lo", "hi", "group", "first"), "gone")
    drop_stashed(spark, own)  # only the rows that go are needed from here on
    losing = spark.sparkContext.broadcast(blooms.build(gone.select(F.xxhash64("of").alias("mark")), gone.count()))
    carried = docs.select(docs[id_col].cast("long").alias("id"), F.struct(*(docs[c] for c in docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("row"))
    carried, text_at = carried.withColumn("mark", F.xxhash64("id")), docs.columns.index(text_col)

    @lean
    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield blooms.pick(batch, "mark", losing.value, inside=False).select(["doc"])

    @lean
    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = blooms.pick(batch, "mark", losing.value)
            for part in text_slices(some.append_column("text", pc.struct_field(some.column("doc"), [text_at]))):
                doc, _, lo, hi = digests(*shingle_sets(*raw(part.column("text")), words))
                at = np.full(part.num_rows, -1)
                at[doc] = np.arange(len(doc))
                index = pa.array(at, mask=at < 0)
                found = [pa.array(x, pa.int64()).take(index) if len(doc) else pa.nulls(part.num_rows, pa.int64()) for x in (lo, hi)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "doc", "row")), *found], names=["id", "doc", "row", "lo", "hi"])

    kept = carried.mapInArrow(others, carried.select("doc").schema)
    some = carried.mapInArrow(digested, carried.select("id", "doc", "row").schema.add("lo", "long").add("hi", "long"))
    some = some.join(gone.withColumnsRenamed({"lo": "of_lo", "hi": "of_hi"}), F.col("id").eqNullSafe(F.col("of")) & (F.col("lo") == F.col("of_lo")) & (F.col("hi") == F.col("of_hi")), "left")
    some = some.where("first is null or first").groupBy("group", F.when(F.col("first").isNull(), F.col("row")).alias("own")).agg(F.min_by("doc", "row").alias("doc"))
    return kept.unionByName(some.select("doc")).select("doc.*")
