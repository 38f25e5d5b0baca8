"""Queries of the operators that the main ones don't reach: all keywords, compressed and broken files, empty containers, text, streams."""

from __future__ import annotations

import gzip

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import header as H
from ..layout import FAMILIES, KEYWORDS, is_data_file
from ..operators import headers, images, memory, tables
from ..sources.storage import file_system, list_files, open_file
from ..streaming import streams
from . import bridge
from .queries import _image, _table, query

# Keywords: a header a supplier with every one of them

_ENUMS = {"bayer": ("grbg", "GRBG"), "xtension": ("bintable", "BINTABLE"), "imagetype": ("masterflat", "MasterFlat"), "time": ("2024-02-29T12:30:45", "")}


def _value(kind: str, i: int, key: str) -> Column:
    """The text of the i-th keyword's value."""
    n = (F.col("s_suppkey") + i).cast("string")
    if kind in _ENUMS:
        return F.lit(f"'{_ENUMS[kind][0]}'")
    return {"string": bridge.quoted(F.concat(F.lit(f"{key} "), F.col("s_name"))), "int": n, "bool": F.when((F.col("s_suppkey") + i) % 2 == 0, "T").otherwise("F"), "float": F.concat(n, F.lit(".25"))}[kind]


def _sql(kind: str, i: int, key: str) -> str:
    if kind == "time":
        return "epoch_us(TIMESTAMP '2024-02-29 12:30:45')"
    if kind in _ENUMS:
        return f"'{_ENUMS[kind][1]}'"
    return {"string": f"'{key} ' || s_name", "int": f"CAST(s_suppkey + {i} AS BIGINT)", "bool": f"(s_suppkey + {i}) % 2 = 0", "float": f"CAST(s_suppkey + {i} AS DOUBLE) + 0.25"}[kind]


_SINGLE = [(k, name, kind, i) for i, (k, name, kind) in enumerate(KEYWORDS)]
_INDEXED = [(f"{f}{n}", name, n, kind, 100 + 2 * i + n) for i, (f, name, kind) in enumerate(FAMILIES) for n in (1, 2)]


def _headers_of_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = [bridge.text_card(k, _value(kind, i, k)) for k, _, kind, i in _SINGLE] + [bridge.text_card(k, _value(kind, i, k)) for k, _, _, kind, i in _INDEXED]
    cards += [bridge.text_card("AUTHOR", "'a later card that does not count'"), F.rpad(F.lit("END"), 80, " ")]
    return headers.parse(bridge.spread(_table(spark, sf_dir, "supplier"), bridge.UNITS_A_TASK).select(F.col("s_suppkey").cast("string").alias("path"), F.lit(0).alias("hdu_index"), F.posexplode(F.array(*cards)).alias("card_index", "card")))


@query("SELECT s_suppkey, " + ", ".join(f"{_sql(kind, i, k)} AS {name}" for k, name, kind, i in _SINGLE) + " FROM supplier")
def header_all_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = headers.typed_header(_headers_of_suppliers(spark, sf_dir))
    return typed.select(F.col("path").cast("long").alias("s_suppkey"), *((F.unix_micros(name) if kind == "time" else F.col(name)).alias(name) for _, name, kind, _ in _SINGLE))


@query("SELECT s_suppkey, " + ", ".join(f"{_sql(kind, i, k)} AS {name}_{n}" for k, name, n, kind, i in _INDEXED) + " FROM supplier")
def header_all_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = headers.typed_header(_headers_of_suppliers(spark, sf_dir))
    return typed.select(F.col("path").cast("long").alias("s_suppkey"), *(F.element_at(name, n).alias(f"{name}_{n}") for _, name, n, _, _ in _INDEXED))


# Cards of text


def _cards_of(spark: SparkSession, sf_dir: str, *cards: Column) -> DataFrame:
    rows = F.array(*(F.rpad(c, 80, " ") for c in cards), F.rpad(F.lit("END"), 80, " "))
    return headers.parse(_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("path"), F.lit(0).alias("hdu_index"), F.posexplode(rows).alias("card_index", "card")))


def _long_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = lambda x: F.concat(F.lit("CONTINUE  '"), x, F.lit("'"))
    return _cards_of(
        spark, sf_dir, F.concat(F.lit("LONGSTRN= '"), F.col("n_name"), F.lit("&'")), said(F.lit(" and then&")), said(F.col("n_name")),
        F.lit("HIERARCH ESO DET GAIN = 1.5 / a long keyword"), F.lit("        a blank keyword"), F.lit("HISTORY made of nothing"),
    )


@query("""SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, 'LONGSTRN' AS keyword, n_name || ' and then' || n_name AS value, CAST(NULL AS VARCHAR) AS comment FROM nation
  UNION ALL SELECT n_nationkey, 'ESO DET GAIN', '1.5', 'a long keyword' FROM nation
  UNION ALL SELECT n_nationkey, '', NULL, 'a blank keyword' FROM nation
  UNION ALL SELECT n_nationkey, 'HISTORY', NULL, 'made of nothing' FROM nation""")
def header_long_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CONTINUE, HIERARCH, blank and commentary keywords."""
    found = headers.stitch(_long_cards(spark, sf_dir)).where("kind <> 'end'")
    return found.select(F.col("path").cast("long").alias("n_nationkey"), "keyword", F.coalesce("string", F.col("float").cast("string")).alias("value"), "comment")


@query("""SELECT n_name, rpad('OBJECT', 8, ' ') || ' = ' || lpad(n_name, 72, ' ') || ' / a name' AS line FROM nation
  UNION ALL SELECT n_name, rpad('NAXIS1', 8, ' ') || ' = ' || lpad(CAST(n_nationkey AS VARCHAR), 72, ' ') || ' / ' FROM nation
  UNION ALL SELECT n_name, rpad('SIMPLE', 8, ' ') || ' = ' || lpad('T', 72, ' ') || ' / ' FROM nation
  UNION ALL SELECT n_name, 'END' FROM nation""")
def header_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = _cards_of(spark, sf_dir, F.concat(F.lit("OBJECT  = "), bridge.quoted(F.col("n_name")), F.lit(" / a name")), F.concat(F.lit("NAXIS1  = "), F.col("n_nationkey").cast("string")), F.lit("SIMPLE  = T"))
    names = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("path"), "n_name")
    return headers.render(cards).join(names, "path").select("n_name", "line")


@query("SELECT unnest(['1J', '1A12', '3D', '1PE', '2X', '1L']) AS tform")
def format_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = spark.createDataFrame([(t,) for t in ("J", "A12", "3D", "PE", "2X", "L")], "tform string")
    return forms.select(H.format_text(H.parse_format(F.col("tform"))).alias("tform"))


# Units and files


def _three(spark: SparkSession, sf_dir: str) -> str:
    return bridge.joined(spark, [bridge.table_files(_table(spark, sf_dir, n), one=True, extname=n.upper()) for n in ("region", "nation", "supplier")])


@query("SELECT 'all.fits' AS file, CAST(3 AS BIGINT) AS n_extensions, 'IMAGE' AS primary_kind, 'NATION' AS second, CAST(count(*) AS BIGINT) AS n_rows FROM nation")
def hdu_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, primary unit, extensions by number, and their count."""
    catalog = headers.hdus(spark, _three(spark, sf_dir))
    one = headers.primary(catalog).select("path", F.col("kind").alias("primary_kind"))
    two = headers.extension(catalog, 1).select("path", F.col("extname").alias("second"), "n_rows")
    every = headers.extension_count(headers.extensions(catalog)).join(one, "path").join(two, "path")
    return every.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("n_extensions").cast("long").alias("n_extensions"), "primary_kind", "second", "n_rows")


@query("SELECT name, kept FROM (VALUES ('a.fits', true), ('c.fts.gz', true), ('d.fits.bz2', false), ('e.txt', false), ('fits', false)) AS t(name, kept)")
def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, is_data_file(n)) for n in ("a.fits", "c.fts.gz", "d.fits.bz2", "e.txt", "fits")], "name string, kept boolean")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def table_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gzip file of two members."""
    source = open_file(list_files(bridge.table_files(_table(spark, sf_dir, "nation"), one=True))[0][0])
    data = source.at(0, source.size)
    source.close()
    path = bridge.shared_folder(spark)
    fs, inner = file_system(path)
    fs.create_dir(inner, recursive=True)
    with fs.open_output_stream(f"{inner}/nation.fits.gz", compression=None) as f:
        f.write(gzip.compress(data[:2880]) + gzip.compress(data[2880:]))
    return tables.read_table(spark, path).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")


@query("SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r >= 100 AND r < 1100")
def table_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of rows, read in small chunks."""
    path = bridge.table_files(_table(spark, sf_dir, "orders").orderBy("o_orderkey"), one=True)
    return tables.read_table(spark, path, columns=["o_orderkey", "o_totalprice"], rows=(100, 1100), partitionBytes=4096).select("o_orderkey", "o_totalprice")


@query("SELECT CAST(i AS BIGINT) AS nth, name, form FROM (VALUES (1, 'r_regionkey', 'K'), (2, 'r_name', 'A')) AS t(i, name, form)")
def table_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and formats of a table's columns, from its header."""
    path = bridge.table_files(_table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name"), one=True)
    typed = headers.typed_header(headers.cards(spark, path)).where("hdu_index = 1")
    fields = typed.select(F.explode("table_column_type").alias("nth", "name"), "table_column_format")
    return fields.select(F.col("nth").cast("long").alias("nth"), F.trim("name").alias("name"), H.parse_format(F.element_at("table_column_format", F.col("nth")))["letter"].alias("form"))


@query("SELECT part, n FROM (VALUES ('planes after clearing', 0), ('planes before', 1), ('rows of an empty table', 0), ('units of an empty table', 2)) AS t(part, n)")
def empty_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty table, and images that are cleared."""
    table = bridge.table_files(_table(spark, sf_dir, "nation").where("false"), one=True)
    samples = spark.range(6).select(F.lit(0).cast("bigint").alias("plane"), F.floor(F.col("id") / 3).alias("y"), (F.col("id") % 3).alias("x"), F.col("id").cast("smallint").alias("raw"))
    image = bridge.image_file(samples, bitpix=16)
    count = lambda path, what: headers.hdus(spark, path).agg(F.coalesce(what, F.lit(0)).cast("int").alias("n"))
    out = count(table, F.sum("n_rows")).withColumn("part", F.lit("rows of an empty table")).unionByName(count(table, F.count("*")).withColumn("part", F.lit("units of an empty table")))
    before = headers.hdus(spark, image).agg(F.sum("n_planes").cast("int")).first()[0]
    images.write_images(samples.where("false"), image, bitpix=16)
    after = count(image, F.sum("n_planes")).withColumn("part", F.lit("planes after clearing"))
    return out.unionByName(after).unionByName(spark.createDataFrame([(before, "planes before")], "n int, part string")).select("part", "n")


# Errors: what is broken, and what is told about it


@query("SELECT s_suppkey, s_suppkey % 4 <> 0 AS broken FROM supplier")
def header_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without SIMPLE, without any header, and with an extension without XTENSION, beside whole ones."""
    card = bridge.text_card
    cards = [card("BITPIX", "8"), card("NAXIS", "0")]
    whole, kind = bridge.header([card("SIMPLE", "T"), *cards]).cast("binary"), F.col("s_suppkey") % 4
    content = F.when(kind == 0, F.concat(whole, bridge.header([card("XTENSION", "'IMAGE'"), *cards]).cast("binary"))).when(kind == 1, bridge.header(cards).cast("binary"))
    content = content.when(kind == 2, F.rpad(F.lit(""), 2880, " ").cast("binary")).otherwise(F.concat(whole, bridge.header(cards).cast("binary")))
    files = bridge.spread(_table(spark, sf_dir, "supplier")).select(F.col("s_suppkey").cast("string").alias("path"), content.alias("content"))
    found = memory.relation(files, "hdus").groupBy("path").agg(F.count_if(F.col("error").isNotNull()).alias("errors"))
    return found.select(F.col("path").cast("long").alias("s_suppkey"), (F.col("errors") > 0).alias("broken"))


def _error(run) -> str | None:
    try:
        run()
    except Exception as e:  # noqa: BLE001  the query tells it
        return type(e).__name__ if isinstance(e, (ValueError, TypeError)) else "error"
    return None


@query("""SELECT asked, told FROM (VALUES ('as it is', CAST(NULL AS VARCHAR)), ('a column that is not there', 'ValueError'), ('another type', 'TypeError'), ('a pattern that is not known', 'ValueError'), ('superpixels of grey', 'error')) AS t(asked, told)""")
def record_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = bridge.table_files(_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name"), one=True)
    record = lambda *f: T.StructType([T.StructField(n, t) for n, t in f])
    grey = images.read_image(spark, _image(spark, sf_dir, "i16"))
    cases = {
        "as it is": lambda: tables.read_records(spark, path, record(("n_nationkey", T.LongType()), ("n_name", T.StringType()))).count(),
        "a column that is not there": lambda: tables.read_records(spark, path, record(("n_none", T.LongType()))).count(),
        "another type": lambda: tables.read_records(spark, path, record(("n_nationkey", T.DoubleType()))).count(),
        "a pattern that is not known": lambda: images.superpixel(grey, 16, pattern="RGB").count(),
        "superpixels of grey": lambda: images.superpixel(grey, 16).agg(F.sum("r")).collect(),
    }
    return spark.createDataFrame([(k, _error(f)) for k, f in cases.items()], "asked string, told string")


@query("SELECT CAST(0 AS BIGINT) AS absent, CAST(50 AS BIGINT) AS present, CAST(64 AS BIGINT) AS width")
def image_plane_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane that isn't there is empty; one that is has its rows, as buffers of the image's width."""
    path = _image(spark, sf_dir, "i16", rows_a_plane=50)
    absent = images.read_image(spark, path, plane=1 << 20, layout="rows").agg(F.count("*").alias("absent")).withColumn("k", F.lit(0))
    present = images.read_image(spark, path, plane=1, layout="rows").agg(F.count("*").alias("present"), F.max(F.size("raw")).cast("long").alias("width")).withColumn("k", F.lit(0))
    return absent.join(present, "k").drop("k")


# Streams


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS nth FROM nation")
def stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = bridge.table_files(_table(spark, sf_dir, "nation").orderBy("n_nationkey"), one=True)
    return spark.createDataFrame([(int(r["n_nationkey"]), r["n_name"], k) for k, r in enumerate(streams.stream_rows(spark, path))], "n_nationkey long, n_name string, nth long")


@query("""WITH px AS (SELECT vec_id AS y, unnest(generate_series(0, 63)) AS x, CAST(unnest(embedding) AS DOUBLE) AS p FROM embeddings)
  SELECT x, y, ((CAST(floor(p * 1000) AS DOUBLE) + CAST(32768.0 AS DOUBLE)) * CAST(1.0 AS DOUBLE)) / (CAST(32767.0 AS DOUBLE) + CAST(32768.0 AS DOUBLE)) AS value FROM px WHERE y < 20""")
def stream_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = streams.stream_normalized_image(spark, _image(spark, sf_dir, "i16", rows_a_plane=20), 0)
    return spark.createDataFrame(list(pixels), "x long, y long, value double")


@query("SELECT CAST((n + 184319) // 184320 AS BIGINT) AS chunks, CAST(n AS BIGINT) AS done, CAST(n AS BIGINT) AS total FROM (SELECT 2880 + (count(*) * 128 + 2879) // 2880 * 2880 AS n FROM embeddings)")
def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image file's bytes in chunks, with the progress of each."""
    steps = [p for p, _ in streams.stream_bytes(list_files(_image(spark, sf_dir, "i16"))[0][0])]
    return spark.createDataFrame([(len(steps), steps[-1].done, steps[-1].total)], "chunks long, done long, total long")
