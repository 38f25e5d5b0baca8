"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash of their id and queued, up to three passes over the
source. A queued copy gets a virtual finish time: the words of its source up to its end, divided by
the source's target. All copies are range-sorted by that time and truncated where their words reach
the total budget, so that every source is within about a document of its target at any point.

Sums along an order are taken without gathering a source anywhere: rows are range-partitioned by the
whole order (a hot source spreads over many partitions), each partition sums its own rows, and the
partitions' totals, one row a source and partition, give the offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, lean, stash

#: A source's words are used so many times at most.
EPOCHS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) to (source, nr, source_size, target): water filling in closed form.

    Sources by code point, null last, weigh weights in turn and share the sum of all sizes; where a
    share exceeds epochs times the source, the excess goes to the others by weight. With sources in
    order of size over weight, the common level is the largest of the levels at which just the
    sources before each are full. There is a row a source, so one task holds them.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = sizes.withColumn("nr", F.row_number().over(order)).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("nr") - 1) % len(weights) + 1).cast("double"))
    full = (F.col("source_size") * epochs).cast("double")
    by = Window.orderBy(full / F.col("w"), "nr")
    everything = Window.partitionBy()
    n = n.withColumn("full", full).withColumn("before", F.coalesce(F.sum("full").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    n = n.withColumn("open_w", F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))).withColumn("total", F.sum("source_size").over(everything).cast("double"))
    level = F.max((F.col("total") - F.col("before")) / F.col("open_w")).over(everything)
    return n.withColumn("level", level).select("source", F.col("nr").cast("long").alias("nr"), "source_size", F.least("full", F.col("level") * F.col("w")).alias("target"))


def _running(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """df with ``cum``, the sum of ``size`` within group up to and with each row, in the whole order."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    @lean
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            g, size = b.column(group).to_numpy(), b.column("size").to_numpy()
            total = np.cumsum(size)
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            base = np.where(first > 0, total[first - 1], 0)
            cum = total - np.repeat(base, np.diff([*first, len(g)]))
            if g[0] == last:
                cum[: first[1] if len(first) > 1 else len(g)] += carry
            last, carry = g[-1], cum[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(g), part, np.int32)), pa.array(cum)], names=[*b.schema.names, "part", "own"])

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stash(ranged.mapInArrow(local, f"{schema}, part int, own long"), name)
    totals = placed.groupBy(group, "part").agg(F.sum("size").alias("n"))
    before = totals.select(group, "part", (F.sum("n").over(Window.partitionBy(group).orderBy("part")) - F.col("n")).alias("before"))
    return placed.join(before, [group, "part"]).withColumn("cum", F.col("own") + F.col("before")).drop("part", "own", "before")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS) -> DataFrame:
    """One row a row of docs: id, size, source_size, target, taken.

    size is the number of words of the whole text (null: 0); taken is how many words the mix takes of
    the row, at most epochs times its size. A null source is a source of its own, the last. Rows
    without words and tables without words take nothing. Rows alike in id, source and size are
    interchangeable, so reruns agree. Null ids are hashed as empty strings. Other columns, whatever
    their names, are not read.
    """
    size = F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(docs[id_col].cast("long").alias("id"), docs[source_col].cast("string").alias("source"), size.alias("size"))
    taken, _ = mix_sized(sized, weights, epochs)
    return taken.groupBy("rid", "id", "size", "source_size", "target").agg(F.sum("taken").alias("taken")).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def _hashed(ident: Column) -> Column:
    return F.md5(F.coalesce(ident.cast("string"), F.lit("")).cast("binary"))


def mix_sized(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS) -> tuple[DataFrame, DataFrame]:
    """(id, source, size) to what the mix takes of each copy (rid, nr, h, id, size, source_size, target, epoch, taken), and the targets."""
    sized = stash(sized.withColumn("rid", F.monotonically_increasing_id()).withColumn("h", _hashed(F.col("id"))), "sized")
    targets = stash(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs), "targets")
    queued = sized.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select("nr", "h", "id", "size", "rid", "source_size", "target")
    queued = _running(queued, "nr", ["nr", "h", "id", "size", "rid"], "queued")
    copies = queued.select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    finish = F.when(F.col("target") > 0, (F.col("epoch") * F.col("source_size") + F.col("cum")).cast("double") / F.col("target")).otherwise(0.0)
    copies = copies.select("rid", "id", "size", "source_size", "target", "nr", "h", "epoch", finish.alias("finish"), F.lit(0).alias("all"))
    timed = _running(copies, "all", ["finish", "nr", "h", "id", "size", "rid", "epoch"], "timed")
    budget = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    taken = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.lit(budget).cast("long") - (F.col("cum") - F.col("size"))))
    return timed.withColumn("taken", taken), targets


def mix_plan(taken: DataFrame, targets: DataFrame) -> DataFrame:
    """What mix_sized takes, as one row a source with words: (of, nr, passes, bound, more, cut, rest).

    A source's rows, in order of their key (h, id, size), are taken whole passes + 1 times up to bound,
    of whose equals more rows are (bound is null if there are none), and passes times from there on.
    The mix ends in one row: it is the first of those equal to cut that is taken passes times, and
    gives rest words once more.
    """
    rows = taken.where("size > 0").groupBy("rid", "nr", "id", "size").agg(F.sum("taken").alias("taken"))
    rows = rows.select("nr", F.struct(_hashed(F.col("id")).alias("h"), "id", "size").alias("key"), F.expr("taken div size").alias("whole"), F.expr("taken % size").alias("rest"))
    rows = stash(rows, "mixed")
    most = F.max(F.struct("whole", "key"))
    ends = rows.groupBy("nr").agg(F.min("whole").alias("passes"), most.alias("most"), F.max(F.when(F.col("rest") > 0, F.struct("key", "rest"))).alias("end"))
    ends = ends.select("nr", "passes", F.when(F.col("most.whole") > F.col("passes"), F.col("most.key")).alias("bound"), F.col("end.key").alias("cut"), F.col("end.rest").alias("rest"))
    more = rows.join(ends.select("nr", "passes", "bound"), "nr").where("whole > passes and key <=> bound").groupBy("nr").agg(F.count("*").alias("more"))
    plan = ends.join(more, "nr", "left").join(targets.select("nr", F.col("source").alias("of")), "nr")
    return stash(plan.select("of", "nr", "passes", "bound", F.coalesce("more", F.lit(0)).alias("more"), "cut", "rest"), "plan")


def apply_mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS) -> DataFrame:
    """docs as the mix holds them: a row is repeated once a pass that takes it whole; the copy at which
    the budget ends keeps its first words, cut after the last of them; rows not taken go.

    Rows are told what is taken of them by their source's row of the plan. So no text is shuffled
    where the plan, a row a source, is small enough to be broadcast, and written are only rows with
    the keys at which passes end, which count off their equals. docs is read several times and must
    give the same rows each time.
    """
    ident, source = docs[id_col].cast("long").alias("id"), docs[source_col].cast("string").alias("source")
    counted = lambda text: F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    plan = mix_plan(*mix_sized(docs.select(ident, source, counted(docs[text_col])), weights, epochs))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), ident, source).join(plan, F.col("source").eqNullSafe(F.col("of")))
    rows = rows.withColumn("h", _hashed(F.col("id"))).withColumn("size", counted(F.col("doc")[text_col]))
    equal = lambda key: F.coalesce((F.col("h") == F.col(key)["h"]) & F.col("id").eqNullSafe(F.col(key)["id"]) & (F.col("size") == F.col(key)["size"]), F.lit(False))
    none = F.lit(0).cast("long")
    ends = stash(rows.where(equal("bound") | equal("cut")).withColumn("rid", F.monotonically_increasing_id()), "ends")
    at = ends.select((F.col("nr") * 2 + equal("bound").cast("long")).alias("group"), "rid", F.lit(1).cast("long").alias("size"))
    nth = _running(at, "group", ["group", "rid"], "nth").select("rid", F.col("cum").alias("nth"))
    first = F.when(equal("bound"), F.col("more")).otherwise(none)
    ends = ends.join(nth, "rid").select("doc", "size", (F.col("passes") + (F.col("nth") <= first).cast("long")).alias("whole"), F.when(equal("cut") & (F.col("nth") == first + 1), F.col("rest")).otherwise(none).alias("rest"))
    before = F.coalesce(F.struct("h", "id", "size") < F.col("bound"), F.lit(False))
    rows = rows.where(~(equal("bound") | equal("cut"))).select("doc", "size", F.when(F.col("size") > 0, F.col("passes") + before.cast("long")).otherwise(none).alias("whole"), none.alias("rest"))
    head = F.when(F.col("rest") > 0, F.array("rest")).otherwise(F.array().cast("array<bigint>"))
    copies = rows.unionByName(ends).withColumn("words", F.explode(F.concat(F.array_repeat("size", F.col("whole").cast("int")), head)))
    text = F.col("doc")[text_col]
    led = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(led, F.lit(1), F.col("words").cast("int")), "")).otherwise(text)
    return copies.select(*((cut if c == text_col else F.col("doc")[c]).alias(c) for c in docs.columns))
