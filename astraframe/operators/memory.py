"""Files held in a binary column, such as Spark's binaryFile source or a stream of messages gives.

This also reads stores that only Spark's own readers reach.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.headers import pick
from ..sources.source import CARD_SCHEMA, HDU_SCHEMA, Settings, decode_bytes, schema_of
from ..sources.storage import open_bytes
from ..sources.writer import table_bytes
from .headers import parse


def binary_files(spark: SparkSession, path: str, glob: str = "*.{fit,fits,fts,fit.gz,fits.gz,fts.gz}") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")


def relation(df: DataFrame, relation: str = "table", schema: T.StructType | str | None = None, path_col: str = "path", content_col: str = "content", **options: object) -> DataFrame:
    """A relation of the source over whole files in content_col; the schema is the first file's unless given."""
    s = Settings.of({"relation": relation, **{k: str(v) for k, v in options.items()}})
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    if schema is None and relation in ("hdus", "cards"):
        schema = HDU_SCHEMA if relation == "hdus" else CARD_SCHEMA
    if schema is None:
        first = df.select(content_col).where(F.col(content_col).isNotNull()).first()
        unit = pick(open_bytes(bytes(first[0])), s.hdu, s.kinds) if first else None
        if unit is None:
            raise ValueError(f"no {relation} in the first file; give a schema")
        schema = schema_of(unit, s)
    want = schema
    return df.select(F.col(path_col).cast("string").alias("path"), F.col(content_col).alias("content")).mapInArrow(lambda it: decode_bytes(it, want, s), want)


def cards(df: DataFrame, mode: str = "standard", **options: object) -> DataFrame:
    out = relation(df, "cards", **options).where("card is not null").drop("error")
    return parse(out, mode)


def encode_tables(df: DataFrame, key: str, columns: list[str] | None = None, extname: str | None = None) -> DataFrame:
    """(key, content): the rows of each key as a whole file with one binary table. A file is one task's, in memory."""
    columns = columns or [c for c in df.columns if c != key]
    schema = T.StructType([df.schema[c] for c in columns])
    kept = df.schema[key]

    def one(table: pa.Table) -> pa.Table:
        data = b"".join(table_bytes(table.select(columns).to_batches(), schema, extname, []))
        return pa.table([table.column(key).slice(0, 1), pa.array([data], pa.binary())], names=[key, "content"])

    return df.groupBy(key).applyInArrow(one, T.StructType([kept, T.StructField("content", T.BinaryType())]))
