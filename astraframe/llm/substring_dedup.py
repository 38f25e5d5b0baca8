"""Substring dedup by relative Lempel-Ziv parsing.

The reference is the corpus itself, cut into blocks that depend on content alone: each window of
``width`` words belongs to its anchor, the least-hashed ``ANCHOR``-gram in it, and a block is a run
of windows with one anchor occurrence (up to 28 windows and 62 words). Equal windows always have
equal anchors, so a document needs to be held only against the blocks indexed under its own anchors.

1. The index tells of each anchor whether it stands elsewhere, and whether under one block or several.
   A document's blocks whose anchors do not are no one's copy. Where an anchor has several blocks,
   factors begin or end inside of them: such boundary blocks enter the index window by window.
2. Each block or window that stands at two positions or more is a reference, by the 128-bit hash of
   its words; the index keeps two positions of it, so that one is not the text's own.
3. A document is parsed greedily, left to right: at its first indexed position the longest factor
   begins, of those that start at the indexed reference positions; it goes on over blocks and windows
   as long as the next one stands in the reference where the last one ends. The next factor begins at
   the first window that is not inside, so it reaches back over the boundary by width - 1 words.

Factors, "first:end:document:position", have at least ``width`` words, and their union is what goes:
each repeated window is in a factor, and each factor's windows are repeated. Two sets are broadcast
to the parsing tasks as Bloom filters, of anchors seen twice and of anchors with several blocks; they
only spare work, and beyond ``filter_keys`` anchors the same knowledge reaches the tasks by a join
instead. Positions are combined before they are shuffled, so a passage that a third of all documents
hold is a few rows of the index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blooms
from .common import lean, mix, powers, raw, rolling, small_batches, stash, text_slices, words_of

ANCHOR = 8
_GRAM = 0x5851F42D4C957F2D
_LO, _HI = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
#: Anchors in a filter, at 16 bits each; beyond, a join.
FILTER_KEYS = 1 << 25


class Blocks:
    """The blocks of a slice of documents: anchor, first window, windows, document; and hashes."""

    def __init__(self, h: np.ndarray, doc: np.ndarray, width: int):
        self.h, self.width, n = h, width, len(h) - width + 1
        empty = np.empty(0, np.int64)
        self.anchor, self.first, self.count, self.doc = empty.view(np.uint64), empty, empty, empty
        if n <= 0:
            return
        gram = rolling(h, ANCHOR, _GRAM)
        at = np.arange(len(gram), dtype=np.uint64)
        least, have, span = (gram & np.uint64(0xFFFFFFFF00000000)) | at, 1, width - ANCHOR + 1
        while have < span:
            step = min(have, span - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        valid = np.flatnonzero(doc[:n] == doc[width - 1 :])
        if not len(valid):
            return
        p = place[valid]
        new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (valid[1:] != valid[:-1] + 1)]))
        self.first = valid[new]
        self.count = np.diff([*new, len(valid)])
        self.anchor = gram[p[new]]
        self.doc = doc[self.first]

    def hashes(self, first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the words [first, first + words), and of their number."""
        out = []
        for base in (_LO, _HI):
            sums = np.zeros(len(self.h) + 1, np.uint64)
            np.cumsum(mix(self.h, base & 0xFF) * powers(base, len(self.h)), out=sums[1:])
            inverse = powers(pow(base, -1, 2**64), len(self.h))
            out.append(mix((sums[first + words] - sums[first]) * inverse[first] + words.astype(np.uint64), base & 0xFFFF).view(np.int64))
        return out[0], out[1]


def _blocks(part: pa.RecordBatch, width: int) -> Blocks:
    data, offsets = raw(part.column("text"))
    doc, _, _, h = words_of(data, offsets)
    return Blocks(h, doc, width)


def parse_factors(first: list[int], count: list[int], refs: list[list[tuple[int | None, int]]], width: int) -> list[tuple[int, int, int | None, int]]:
    """The greedy parse of a document's indexed units, in order of first: (first word, end, reference document, its first word)."""
    out, k = [], 0
    while k < len(first):
        best = None
        for doc, at in refs[k]:
            shift, last = (doc, at - first[k]), k
            while last + 1 < len(first) and first[last + 1] == first[last] + count[last] and any((d, p - first[last + 1]) == shift for d, p in refs[last + 1]):
                last += 1
            if best is None or last > best[0]:
                best = last, doc, at
        last, doc, at = best
        out.append((first[k], first[last] + count[last] + width - 1, doc, at))
        k = last + 1
    return out


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, filter_keys: int = FILTER_KEYS, texts: bool = False) -> DataFrame:
    """id, n_words, n_removed, kept_sha256, factors of every row; with texts also the kept words.

    Words are runs of anything but ASCII white space. A word goes if a window of width words that
    covers it has the same words as a window that starts anywhere else, in any row, this one
    included; kept words are joined by one space. factors lists the parse's factors as
    "first:end:document:position", in words; those that meet overlap by width - 1 words. Null and empty texts have no words; texts of fewer than width words stay;
    repeated rows are copies of each other, so both go; null ids are kept apart by text; an empty
    table gives no rows; other columns are not read. The document of a factor is an id, null where it
    has none.
    """
    if width <= ANCHOR:
        raise ValueError(f"width must exceed {ANCHOR}")
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))

    @lean
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                b = _blocks(part, width)
                if len(b.first):
                    lo, _ = b.hashes(b.first, b.count + width - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(b.anchor.view(np.int64)), pa.array(lo)], names=["anchor", "block"])

    indexed = source.select("text").mapInArrow(index, "anchor long, block long").groupBy("anchor").agg(F.count("*").alias("n"), F.min("block").alias("low"), F.max("block").alias("high"))
    shared = stash(indexed.where("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("several")), "anchors")
    n_shared, n_several = shared.agg(F.count("*"), F.count_if("several")).first()

    def parse(part: pa.RecordBatch, b: Blocks, known: np.ndarray, several: np.ndarray) -> pa.RecordBatch:
        whole, single = np.flatnonzero(known & ~several), np.flatnonzero(known & several)
        each = b.count[single]
        windows = np.repeat(b.first[single] - np.cumsum(each) + each, each) + np.arange(each.sum())
        first = np.concatenate([b.first[whole], windows])
        count = np.concatenate([b.count[whole], np.ones(len(windows), np.int64)])
        doc = np.concatenate([b.doc[whole], np.repeat(b.doc[single], each)])
        lo, hi = b.hashes(first, count + width - 1) if len(first) else (first, first)
        begin = np.searchsorted(b.word_doc, doc)
        return pa.RecordBatch.from_arrays([part.column("id").take(pa.array(doc)), part.column("mark").take(pa.array(doc)), pa.array(lo), pa.array(hi), pa.array(first - begin), pa.array(count.astype(np.int32))], names=["id", "mark", "lo", "hi", "first", "count"])

    @lean
    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                data, offsets = raw(part.column("text"))
                doc, _, _, h = words_of(data, offsets)
                b = Blocks(h, doc, width)
                b.word_doc = doc
                if "hits" in part.schema.names:
                    hits = [x for row in part.column("hits").to_pylist() for x in row or ()]
                    pick = lambda want: np.isin(b.anchor.view(np.int64), np.array([x["anchor"] for x in hits if want(x)], np.int64))
                    known, several = pick(lambda x: True), pick(lambda x: x["several"])
                else:
                    known, several = blooms.has(filters.value[0], b.anchor), blooms.has(filters.value[1], b.anchor)
                if known.any():
                    yield parse(part, b, known, several)

    if n_shared <= filter_keys:
        both = [blooms.build(shared.select("anchor"), n_shared), blooms.build(shared.where("several").select("anchor"), n_several)]
        filters = spark.sparkContext.broadcast(both)
        to_parse = source
    else:
        @lean
        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text_slices(batch):
                    b = _blocks(part, width)
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(b.doc)), part.column("mark").take(pa.array(b.doc)), pa.array(b.anchor.view(np.int64))], names=["id", "mark", "anchor"])

        hits = source.select("id", "mark", "text").mapInArrow(own, "id long, mark long, anchor long").join(shared, "anchor").groupBy(F.col("id").alias("of"), F.col("mark").alias("of_mark")).agg(F.collect_set(F.struct("anchor", "several")).alias("hits"))
        to_parse = source.join(hits, (F.col("mark") == F.col("of_mark")) & F.col("id").eqNullSafe(F.col("of"))).select("id", "text", "mark", "hits")

    parsed = stash(to_parse.mapInArrow(units, "id long, mark long, lo long, hi long, first long, count int"), "units")
    repeated = stash(parsed.groupBy("lo", "hi").agg(F.count("*").alias("n")).where("n > 1").select("lo", "hi"), "repeated")
    found = stash(parsed.join(repeated, ["lo", "hi"]), "found")
    ends = [f(c, *by).alias(f"{n}_{c}") for n, f, by in (("low", F.min_by, ("mark",)), ("high", F.max_by, ("mark",))) for c in ("id", "first")]
    ends += [f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("mark", "id", "first")]
    index_of = found.groupBy("lo", "hi").agg(*ends)
    alike = F.col("min_mark") == F.col("max_mark")  # one text, or copies of it: any of its ids with any of its positions
    pairs = [F.struct(F.when(alike, F.col(f"{m}_id")).otherwise(F.col(f"{n}_id")).alias("doc"), F.when(alike, F.col(f"{m}_first")).otherwise(F.col(f"{n}_first")).alias("at")) for m, n in (("min", "low"), ("max", "high"))]
    index_of = stash(index_of.select("lo", "hi", pairs[0].alias("one"), pairs[1].alias("two")), "index")  # a table, so that the join can split a frequent hash
    unit = F.struct("first", "count", F.col("one.doc").alias("doc1"), F.col("one.at").alias("at1"), F.col("two.doc").alias("doc2"), F.col("two.at").alias("at2"))
    spans = stash(found.join(index_of, ["lo", "hi"]).groupBy(F.col("id").alias("of"), F.col("mark").alias("of_mark")).agg(F.array_sort(F.collect_set(unit)).alias("units")), "spans")
    unit_names = ["first", "count", "doc1", "at1", "doc2", "at2"]
    cut = spark.sparkContext.broadcast(blooms.build(spans.select("of_mark"), spans.count()))  # only documents with spans meet them in a shuffle
    joined = blooms.matching(source, "mark", cut).join(spans, (F.col("mark") == F.col("of_mark")) & F.col("id").eqNullSafe(F.col("of")), "left").select("id", "text", *(F.col(f"units.{c}").alias(c) for c in unit_names))

    @lean
    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = blooms.pick(batch, "mark", cut.value, inside=False)
            none = pa.nulls(own.num_rows, pa.list_(pa.int64()))
            yield from rewrite(pa.RecordBatch.from_arrays([own.column("id"), own.column("text"), *[none] * len(unit_names)], names=["id", "text", *unit_names]))

    def rewrite(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batch):
            n, gone, digest, factors, kept = [], [], [], [], []
            for i, text, first, count, *refs in zip(part.column("id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), *(part.column(c).to_pylist() for c in unit_names)):
                words = text.split()
                n.append(len(words))
                parsed_ = []
                if first:
                    known = [[x for x in ((d1, p1), (d2, p2)) if x != (i, f)] or [(i, f)] for f, d1, p1, d2, p2 in zip(first, *refs)]
                    parsed_ = parse_factors(first, count, known, width)
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, [x[0] for x in parsed_], 1)
                    np.add.at(cover, [x[1] for x in parsed_], -1)
                    covered = np.cumsum(cover)[:-1] > 0
                    words = [w for w, c in zip(words, covered.tolist()) if not c]
                gone.append(n[-1] - len(words))
                factors.append(",".join(f"{a}:{b}:{'null' if d is None else d}:{p}" for a, b, d, p in parsed_))
                whole = b" ".join(words)
                digest.append(hashlib.sha256(whole).hexdigest())
                if texts:
                    kept.append(whole)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(factors, pa.string()), *([pa.array(kept, pa.binary()).cast(pa.string())] if texts else [])], names=names)

    @lean
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from rewrite(batch)

    names = [id_col, "n_words", "n_removed", "kept_sha256", "factors", *([text_col] if texts else [])]
    schema = f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string, factors string" + (f", `{text_col}` string" if texts else "")
    return source.mapInArrow(untouched, schema).unionByName(joined.mapInArrow(remove, schema))
