"""Operators over binary and ASCII tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.source import register


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, schema: T.StructType | str | None = None, rows: tuple[int, int] | None = None, relation: str = "table", **options: object) -> DataFrame:
    """A table as a DataFrame; only the columns of the schema (or those named) are decoded.

    rows are a first and an end ordinal, which are addressed and not filtered: row ranges outside are
    not read. Options are those of the source.
    """
    if rows is not None:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        options = options | {"pushdown": "true", "meta": "true"}
    r = register(spark).read.format("starfile").option("relation", relation)
    for k, v in options.items():
        r = r.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    if columns is not None and schema is None:
        full = {f.name: f for f in r.load(path).schema.fields}
        if missing := [c for c in columns if c not in full]:
            raise ValueError(f"no column {', '.join(missing)}")
        schema = T.StructType([full[c] for c in columns] + ([f for n, f in full.items() if n == "_row" and n not in columns] if rows else []))
    df = (r.schema(schema) if schema is not None else r).load(path)
    if rows is not None:
        df = df.where((F.col("_row") >= rows[0]) & (F.col("_row") < rows[1]))
    return df


def read_records(spark: SparkSession, path: str, record: T.StructType, **options: object) -> DataFrame:
    """Typed records by column name: a column's type must be the record's, no widening; others are an error.

    A list column gives its first element where the record has the element's type.
    """
    full = {f.name: f.dataType for f in read_table(spark, path, **options).schema.fields}
    for f in record.fields:
        if f.name not in full:
            raise ValueError(f"no column {f.name}")
        have = full[f.name]
        if have != f.dataType and not (isinstance(have, T.ArrayType) and have.elementType == f.dataType):
            raise TypeError(f"column {f.name}: {have.simpleString()} is not {f.dataType.simpleString()}")
    df = read_table(spark, path, columns=record.names, **options)
    return df.select(*(F.element_at(f.name, 1).alias(f.name) if full[f.name] != f.dataType else F.col(f.name) for f in record.fields))


def row_at(spark: SparkSession, path: str, ordinal: int, **options: object) -> DataFrame:
    """The row of an ordinal; no row beyond the end."""
    return read_table(spark, path, rows=(ordinal, ordinal + 1), **options)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", **options: object) -> None:
    """One file a partition, or with single=True one in all, each with one binary table; column types decide the formats."""
    register(df.sparkSession)
    w = df.write.format("starfile").mode(mode).option("kind", "table")
    for k, v in options.items():
        w = w.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    w.save(path)
