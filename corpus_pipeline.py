"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes the documents that its predecessor kept, as written and reread; all but the last
return the columns of documents. Documents that the rules reject go; repeated lines go from texts
(n_chars follows); of each group of near copies, at five-word shingles and a similarity of 0.8, the
one row of the least doc_id (null above all, then the least row number) stays; the mix repeats or
leaves out documents by its targets; packing returns the pieces of the last stage's rows with their
places.

Null and empty texts fail the rules, and stages that still meet them keep them as they are; null
ids are kept apart by row; repeated rows count each until near-dedup, which leaves one of them; ties
go to the least row number, and rows alike are interchangeable; empty tables give empty tables.
Further columns come through unchanged.

Stages stash no texts but of rows where the mix's passes end: what goes or is repeated is told by
small tables of ids, digests and keys. Stages read their input several times, so it must give the same rows each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astraframe.llm.common import drop_stashed, stash, stash_scope
from astraframe.llm.line_dedup import dedup_lines
from astraframe.llm.mixing import apply_mix
from astraframe.llm.near_dedup import one_of_each
from astraframe.llm.packing import pack
from astraframe.llm.quality import kept_rows
from astraframe.llm.queries import documents, tokenizer_path


def _others(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c not in ("doc_id", "text"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_rows(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs, carry=_others(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path())


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: The first stage's verdicts and the last stage's tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and reread but for the last.

    What a stage stashed, and the table that it read, go when its output is written.
    """
    docs, read = documents(spark, sf_dir), None
    for k, (_, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with stash_scope(spark) as own:
            out = stage(spark, docs, sf_dir)
        with stash_scope(spark) as written:
            docs = stash(out, f"stage{k}")
        drop_stashed(spark, own)
        if read:
            drop_stashed(spark, read)
        read = written
    return docs
