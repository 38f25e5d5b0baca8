"""Line dedup with two Bloom filters, for hashes seen once and seen twice.

Every task folds the hashes of its documents' lines into a pair of bit sets: a bit is in ``once`` if
a line set it and in ``twice`` if a second document's line set it again. Pairs merge without any
line: twice = a.twice | b.twice | (a.once & b.once), once = a.once | b.once. A line in two documents
always has all its bits in the merged ``twice``, so only lines found there are suspected repeats,
and only their SHA-256 keys and ids are shuffled, for the exact count and the choice of the document
that keeps them. The filter grows with the number of lines up to a fixed size; beyond it more lines
are suspected, in the limit all, and the result stays the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blooms
from .common import lean, small_batches, stash, text_slices

#: A filter has this many bits a line, up to blooms.MAX_BITS (64 MB, broadcast).
BITS_A_LINE = 12
_STRIP = b" \t\n\r\x0b\x0c"
#: Hashes that a task holds before it folds them.
_FOLD = 1 << 20


def line_keys(text: bytes, least: int) -> list[bytes | None]:
    """The key of each line, None for those below least code points."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(_STRIP)
        n = len(key)
        if n < least or n < 4 * least and not key.isascii() and len(key.decode("utf-8", "replace")) < least:
            out.append(None)
        else:
            out.append(key.lower())
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, carry: tuple[str, ...] = (), texts: bool = True) -> DataFrame:
    """id, [text], n_lines, n_dropped, kept_sha256 of every row, and the columns named in carry.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. A key of
    min_chars code points or more that min_docs documents hold loses its lines in all but those with
    the largest id. A document is a row: repeated rows count each, and rows that share the largest id
    all keep their lines. Null ids are below all others. A null or empty text is one empty line. An
    empty table gives no rows. A carried column named as a result column gives way to it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    made = [id_col, *([text_col] if texts else []), "n_lines", "n_dropped", "kept_sha256"]
    carry = tuple(c for c in carry if c not in made)
    source = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), F.struct(*(docs[c] for c in carry)).alias("rest") if carry else F.lit(0).alias("rest"))
    n_lines = source.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = blooms.size(n_lines, BITS_A_LINE)

    def keys_of(part: pa.RecordBatch, column: int) -> Iterator[tuple[int, set[bytes]]]:
        for i, text in enumerate(part.column(column).cast(pa.binary()).to_pylist()):
            keys = set(line_keys(text, min_chars))
            keys.discard(None)
            yield i, keys

    @lean
    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []

        def out() -> Iterator[pa.RecordBatch]:
            rows = list(blooms.fold(np.array(held, np.uint64), bits))
            held.clear()
            if rows:
                yield blooms.folded(rows)

        for batch in batches:
            for part in text_slices(batch):
                for _, keys in keys_of(part, 0):
                    held += map(xxhash.xxh3_64_intdigest, keys)
                if len(held) >= _FOLD:
                    yield from out()
        yield from out()

    twice = spark.sparkContext.broadcast(blooms.gather(source.select("text").mapInArrow(seen, blooms.FOLDED), bits, True))

    @lean
    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = twice.value
        for batch in batches:
            for part in text_slices(batch):
                own: list[int] = []
                found: list[bytes] = []
                for i, keys in keys_of(part, 1):
                    own += [i] * len(keys)
                    found += keys
                hit = np.flatnonzero(blooms.has(bloom, np.array(list(map(xxhash.xxh3_64_intdigest, found)), np.uint64)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.array(own, np.int64)[hit])), pa.array([hashlib.sha256(found[k]).digest() for k in hit], pa.binary())], names=["id", "key"])

    pairs = stash(source.select("id", "text").mapInArrow(suspects, "id long, key binary"), "suspects")
    twice.unpersist()
    repeated = stash(pairs.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs).select("key", "keeper"), "repeated")
    lost = F.col("keeper").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("keeper")))
    drops = pairs.join(repeated, "key").where(lost).groupBy("id").agg(F.collect_set("key").alias("drop")).withColumnRenamed("id", "of")
    drops = stash(drops, "drops")
    marked = source.withColumn("mark", F.xxhash64("id"))
    losing = spark.sparkContext.broadcast(blooms.build(drops.select(F.xxhash64("of").alias("mark")), drops.count()))  # only documents that lose lines are shuffled
    joined = blooms.matching(marked, "mark", losing).join(drops, F.col("id").eqNullSafe(F.col("of")), "left").select("id", "text", "drop", "rest")
    rest_type = joined.schema["rest"].dataType.simpleString()

    def rewritten(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batch):
            n, gone, digest, kept = [], [], [], []
            for text, drop in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist()):
                lines = text.count(b"\n") + 1
                n.append(lines)
                if drop:
                    drop = set(drop)
                    own = text.split(b"\n")
                    own = [x for x, k in zip(own, line_keys(text, min_chars)) if k is None or hashlib.sha256(k).digest() not in drop]
                    text = b"\n".join(own)
                    gone.append(lines - len(own))
                else:
                    gone.append(0)
                digest.append(hashlib.sha256(text).hexdigest())
                if texts:
                    kept.append(text)
            cols = [part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), part.column(3)]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(kept, pa.binary()).cast(pa.string())] if texts else [])], names=["id", "n_lines", "n_dropped", "kept_sha256", "rest", *(["text"] if texts else [])])

    @lean
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from rewritten(batch)

    @lean
    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = blooms.pick(batch, "mark", losing.value, inside=False)
            none = pa.nulls(own.num_rows, pa.list_(pa.binary()))
            yield from rewritten(pa.RecordBatch.from_arrays([own.column("id"), own.column("text"), none, own.column("rest")], names=["id", "text", "drop", "rest"]))

    schema = f"id long, n_lines long, n_dropped long, kept_sha256 string, rest {rest_type}" + (", text string" if texts else "")
    out = marked.mapInArrow(untouched, schema).unionByName(joined.mapInArrow(rewrite, schema))
    return out.select(F.col("id").alias(id_col), *([F.col("text").alias(text_col)] if texts else []), "n_lines", "n_dropped", "kept_sha256", *(F.col("rest")[c].alias(c) for c in carry))
