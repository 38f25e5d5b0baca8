"""Queries over files made from the driver's tables, each with the SQL that the plain tables answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import header as H
from ..operators import headers, images, memory, tables
from ..streaming import streams
from . import bridge

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Tables


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, epoch_us(l_shipdate) AS l_shipdate FROM lineitem")
def table_scan_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_table(spark, bridge.table_files(_table(spark, sf_dir, "lineitem")))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL")
def table_aggregate_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables.read_table(spark, bridge.table_files(_table(spark, sf_dir, "lineitem")), columns=["l_returnflag", "l_linestatus", "l_quantity"])
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def table_project_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_table(spark, bridge.table_files(_table(spark, sf_dir, "orders")), columns=["o_orderkey", "o_totalprice", "o_orderstatus"])


@query("SELECT row_nr, s_suppkey, s_acctbal FROM (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS row_nr, s_suppkey, s_acctbal FROM supplier) WHERE row_nr >= 3 AND row_nr < 40")
def table_row_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = bridge.table_files(_table(spark, sf_dir, "supplier").orderBy("s_suppkey"), one=True)
    return tables.read_table(spark, path, columns=["s_suppkey", "s_acctbal"], rows=(3, 40)).withColumnRenamed("_row", "row_nr")


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 1 OFFSET 5")
def table_row_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = bridge.table_files(_table(spark, sf_dir, "supplier").orderBy("s_suppkey"), one=True)
    return tables.row_at(spark, path, 5).select("s_suppkey", "s_name")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem")
def table_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = bridge.table_files(_table(spark, sf_dir, "lineitem"))
    return headers.table_rows(headers.hdus(spark, path)).agg(F.sum("n_rows").alias("n"))


@query("SELECT l_orderkey, l_quantity, l_extendedprice, CAST(CAST(l_discount AS FLOAT) AS DOUBLE) AS l_discount FROM lineitem")
def table_typed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", F.col("l_discount").cast("float").alias("l_discount"))
    record = T._parse_datatype_string("l_orderkey long, l_quantity double, l_extendedprice double, l_discount float")
    return tables.read_records(spark, bridge.table_files(made), record).withColumn("l_discount", F.col("l_discount").cast("double"))


@query("SELECT c_custkey, trim(c_name) AS c_name, trim(c_mktsegment) AS c_mktsegment FROM customer")
def table_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("  "), "c_name", F.lit("   ")).alias("c_name"), "c_mktsegment")
    return tables.read_table(spark, bridge.table_files(made))


@query("SELECT s_suppkey, i, trim(substr(rpad(s_name, 20, ' '), 5 * i + 1, 5)) AS piece FROM supplier, (SELECT unnest(generate_series(0, 3)) AS i)")
def table_string_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = bridge.table_header("BINTABLE", 28, 1, [{"TTYPE": "'s_suppkey'", "TFORM": "'1K'"}, {"TTYPE": "'pieces'", "TFORM": "'20A5'"}])
    data = F.concat(bridge.big_endian(F.col("s_suppkey"), 8), F.rpad("s_name", 20, " ").cast("binary"))
    made = bridge.spread(_table(spark, sf_dir, "supplier")).select(F.lit("memory").alias("path"), bridge.content(head, data).alias("content"))
    df = memory.relation(made, "table", "s_suppkey long, pieces array<string>")
    return df.select("s_suppkey", F.posexplode("pieces").alias("i", "piece")).withColumn("i", F.col("i").cast("long"))


@query("SELECT vec_id, unnest(generate_series(0, 63)) AS x, CAST(unnest(embedding) AS DOUBLE) AS p FROM embeddings")
def table_array_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    df = tables.read_table(spark, bridge.table_files(made))
    return df.select("vec_id", F.posexplode("embedding").alias("x", "p")).select("vec_id", F.col("x").cast("long").alias("x"), F.col("p").cast("double").alias("p"))


@query("""SELECT p_partkey, CAST(p_size AS BIGINT) AS b, CAST(-p_size AS BIGINT) AS s, CAST(-300 * p_size AS BIGINT) AS i, CAST(40000 + p_size AS BIGINT) AS u,
  CAST(-p_partkey AS BIGINT) AS j, 3000000000 + p_partkey AS v, -5000000000 * p_partkey AS k FROM part""")
def table_small_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"p_partkey": ("K", 8, F.col("p_partkey")), "b": ("B", 1, F.col("p_size")), "s": ("S", 1, -F.col("p_size")), "i": ("I", 2, -300 * F.col("p_size")), "u": ("U", 2, 40000 + F.col("p_size")), "j": ("J", 4, -F.col("p_partkey")), "v": ("V", 4, F.lit(3000000000) + F.col("p_partkey")), "k": ("K", 8, F.lit(-5000000000) * F.col("p_partkey"))}
    head = bridge.table_header("BINTABLE", sum(n for _, n, _ in values.values()), 1, [{"TTYPE": f"'{c}'", "TFORM": f"'1{letter}'"} for c, (letter, _, _) in values.items()])
    data = F.concat(*(bridge.big_endian(v, n) for _, n, v in values.values()))
    made = bridge.spread(_table(spark, sf_dir, "part")).select(F.lit("memory").alias("path"), bridge.content(head, data).alias("content"))
    df = memory.relation(made, "table", "p_partkey long, b short, s byte, i short, u int, j int, v long, k long")
    return df.select(*(F.col(c).cast("long").alias(c) for c in values))


@query("SELECT p_partkey, i, (p_size >> (9 - i)) & 1 = 1 AS bit FROM part, (SELECT unnest(generate_series(0, 9)) AS i)")
def table_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = bridge.table_header("BINTABLE", 10, 1, [{"TTYPE": "'p_partkey'", "TFORM": "'K'"}, {"TTYPE": "'bits'", "TFORM": "'10X'"}])
    data = F.concat(bridge.big_endian(F.col("p_partkey"), 8), bridge.big_endian(F.col("p_size") * 64, 2))
    made = bridge.spread(_table(spark, sf_dir, "part")).select(F.lit("memory").alias("path"), bridge.content(head, data).alias("content"))
    df = memory.relation(made, "table", "p_partkey long, bits array<boolean>")
    return df.select("p_partkey", F.posexplode("bits").alias("i", "bit")).withColumn("i", F.col("i").cast("long"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS returned, CASE WHEN l_linestatus = 'O' THEN true END AS open_or_null FROM lineitem")
def table_logical(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("returned"), F.when(F.col("l_linestatus") == "O", True).alias("open_or_null"))
    return tables.read_table(spark, bridge.table_files(made))


@query("SELECT l_orderkey, l_linenumber, true AS returned FROM lineitem")
def table_logical_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("returned"))
    return tables.read_table(spark, bridge.table_files(made), mode="reference")


@query("SELECT s_suppkey, 0.0 + 0.01 * CAST(round(s_acctbal * 100) AS DOUBLE) AS balance, CASE WHEN s_nationkey <> 7 THEN s_nationkey + 32768 END AS nation FROM supplier")
def table_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _table(spark, sf_dir, "supplier").select("s_suppkey", F.round(F.col("s_acctbal") * 100).cast("int").alias("balance"), F.col("s_nationkey").cast("smallint").alias("nation"))
    path = bridge.table_files(made, header="TSCAL2=0.01\nTZERO3=32768\nTNULL3=7")
    return tables.read_table(spark, path, scaling=True, nulls=True)


@query("SELECT s_suppkey, s_name, s_acctbal, CAST(s_nationkey AS BIGINT) AS s_nationkey FROM supplier")
def table_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [("s_suppkey", "I10", 1), ("s_name", "A30", 12), ("s_acctbal", "F20.2", 43), ("s_nationkey", "I5", 64)]
    head = bridge.table_header("TABLE", 68, 1, [{"TTYPE": f"'{c}'", "TFORM": f"'{f}'", "TBCOL": str(at)} for c, f, at in columns])
    data = F.concat(F.lpad(F.col("s_suppkey").cast("string"), 10, " "), F.lit(" "), F.rpad("s_name", 30, " "), F.lit(" "), F.lpad(F.format_string("%.2f", "s_acctbal"), 20, " "), F.lit(" "), F.lpad(F.col("s_nationkey").cast("string"), 5, " ")).cast("binary")
    made = bridge.spread(_table(spark, sf_dir, "supplier")).select(F.lit("memory").alias("path"), bridge.content(head, data).alias("content"))
    return memory.relation(made, "ascii", "s_suppkey long, s_name string, s_acctbal double, s_nationkey long")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def memory_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = bridge.table_files(_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"))
    return memory.relation(memory.binary_files(spark, path), "table", "c_custkey long, c_name string, c_acctbal double")


@query("SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey FROM supplier")
def memory_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = memory.encode_tables(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey").withColumn("nr", F.col("s_nationkey")), "nr")
    df = memory.relation(made, "table", "s_suppkey long, s_name string, s_nationkey int", path_col="nr")
    return df.withColumn("s_nationkey", F.col("s_nationkey").cast("long"))


@query("""SELECT n_name, count(*) AS n, CAST(sum(CAST(s_acctbal AS DECIMAL(18, 2))) AS DOUBLE) AS balance, rank() OVER (ORDER BY count(*) DESC, n_name) AS place
  FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name ORDER BY n DESC, n_name LIMIT 10""")
def sql_join_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("nation", "supplier"):
        tables.read_table(spark, bridge.table_files(_table(spark, sf_dir, name))).createOrReplaceTempView(f"decoded_{name}")
    return spark.sql("""SELECT n_name, count(*) AS n, CAST(sum(CAST(s_acctbal AS DECIMAL(18, 2))) AS DOUBLE) AS balance, CAST(rank() OVER (ORDER BY count(*) DESC, n_name) AS BIGINT) AS place
        FROM decoded_supplier JOIN decoded_nation ON s_nationkey = n_nationkey GROUP BY n_name ORDER BY n DESC, n_name LIMIT 10""")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def stream_arriving_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = bridge.table_files(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))
    df = streams.arriving(spark, path, "table", "o_orderkey long, o_custkey long, o_totalprice double")
    out = bridge.shared_folder(spark)
    df.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


# Headers


@query("""WITH t AS (SELECT 1 AS hdu_index, 'REGION' AS extname, count(*) AS n_rows, 2 AS n_fields, 4 + max(octet_length(encode(r_name))) AS row_bytes FROM region
  UNION ALL SELECT 2, 'NATION', count(*), 3, 8 + max(octet_length(encode(n_name))) FROM nation
  UNION ALL SELECT 3, 'SUPPLIER', count(*), 4, 20 + max(octet_length(encode(s_name))) FROM supplier)
SELECT hdu_index, 'BINTABLE' AS kind, extname, CAST(n_rows AS BIGINT) AS n_rows, CAST(n_fields AS BIGINT) AS n_fields, CAST(row_bytes AS BIGINT) AS row_bytes, CAST(n_rows * row_bytes AS BIGINT) AS data_bytes,
  CAST((n_rows * row_bytes + 2879) // 2880 * 2880 AS BIGINT) AS padded_bytes FROM t""")
def hdu_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [bridge.table_files(_table(spark, sf_dir, n), one=True, extname=n.upper()) for n in ("region", "nation", "supplier")]
    catalog = headers.hdus(spark, bridge.joined(spark, parts))
    return headers.extensions(catalog).select("hdu_index", "kind", "extname", "n_rows", F.col("n_fields").cast("long").alias("n_fields"), "row_bytes", "data_bytes", "padded_bytes")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def hdu_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [bridge.table_files(_table(spark, sf_dir, n), one=True, extname=n.upper()) for n in ("region", "nation", "supplier")]
    return tables.read_table(spark, bridge.joined(spark, parts), hdu="NATION").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")


def _supplier_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header a supplier, as rows of cards."""
    card, quote = bridge.text_card, bridge.quoted
    exp = F.concat(F.col("s_nationkey").cast("string"), F.lit(".5D1 / seconds"))
    cards = F.array(
        card("SIMPLE", "T / standard"), card("BITPIX", "-32"), card("NAXIS", "2"), card("NAXIS1", F.col("s_suppkey").cast("string")), card("NAXIS2", "7"),
        card("OBJECT", F.concat(quote(F.concat("s_name", F.lit("'s"))), F.lit(" / a/b"))), card("EXPTIME", exp), card("BZERO", "32768"), card("GAIN", F.col("s_acctbal").cast("decimal(18,2)").cast("string")),
        card("DATE-OBS", F.lit("'2024-01-02T03:04:05'")), card("IMAGETYP", "'masterdark'"), card("BAYERPAT", "'grbg'"), card("YORGSUBF", "7"), F.rpad(F.lit("COMMENT nothing of note"), 80, " "), card("OBJECT", "'second'"), F.rpad(F.lit("END"), 80, " "),
    )
    return bridge.spread(_table(spark, sf_dir, "supplier"), bridge.UNITS_A_TASK).select(F.col("s_suppkey").cast("string").alias("path"), F.lit(0).alias("hdu_index"), "s_suppkey", F.posexplode(cards).alias("card_index", "card"))


def _all_cards(rows: list[tuple[str, str, str, str]]) -> str:
    return "\n  UNION ALL ".join(f"SELECT s_suppkey, '{k}' AS keyword, '{kind}' AS kind, {value} AS value, {said} AS comment FROM supplier" for k, kind, value, said in rows)


_NUMBER = "CAST(CAST({} AS DOUBLE) AS VARCHAR)"


@query(_all_cards([
    ("SIMPLE", "logical", "'T'", "'standard'"), ("BITPIX", "integer", "'-32'", "NULL"), ("NAXIS", "integer", "'2'", "NULL"), ("NAXIS1", "integer", "CAST(s_suppkey AS VARCHAR)", "NULL"), ("NAXIS2", "integer", "'7'", "NULL"),
    ("OBJECT", "string", "s_name || '''s'", "'a/b'"), ("EXPTIME", "float", _NUMBER.format("s_nationkey * 10 + 5"), "'seconds'"), ("BZERO", "integer", "'32768'", "NULL"), ("GAIN", "float", _NUMBER.format("s_acctbal"), "NULL"),
    ("DATE-OBS", "string", "'2024-01-02T03:04:05'", "NULL"), ("IMAGETYP", "string", "'masterdark'", "NULL"), ("BAYERPAT", "string", "'grbg'", "NULL"), ("YORGSUBF", "integer", "'7'", "NULL"),
    ("COMMENT", "comment", "''", "'nothing of note'"), ("OBJECT", "string", "'second'", "NULL"), ("END", "end", "''", "NULL"),
]))
def header_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = headers.parse(_supplier_cards(spark, sf_dir))
    c = F.struct("string", "bool", "int", "float", "re", "im")
    return parsed.select("s_suppkey", "keyword", "kind", H.as_text(c).alias("value"), "comment")


@query("SELECT s_suppkey, s_name AS object, CAST(NULL AS VARCHAR) AS comment FROM supplier UNION ALL SELECT s_suppkey, 'second', NULL FROM supplier")
def header_cards_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = headers.parse(_supplier_cards(spark, sf_dir), "reference")
    return headers.raw_card(parsed, "OBJECT").select("s_suppkey", F.col("string").alias("object"), "comment")


@query("""SELECT s_suppkey, s_name || '''s' AS object, CAST(-32 AS BIGINT) AS bitpix, CAST(s_suppkey AS BIGINT) AS width, CAST((s_nationkey + 0.5) * 10 AS DOUBLE) AS exposure_seconds, CAST(32768 AS DOUBLE) AS bzero,
  'MasterDark' AS image_type, 'GRBG' AS bayer_pattern, CAST(7 AS BIGINT) AS subframe_y, epoch_us(TIMESTAMP '2024-01-02 03:04:05') AS observed FROM supplier""")
def header_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = headers.images_exposure_time(headers.typed_header(headers.parse(_supplier_cards(spark, sf_dir))))
    return typed.select(
        F.col("path").cast("long").alias("s_suppkey"), "object", "bitpix", F.element_at("naxis_n", 1).alias("width"), F.col("images_exposure_time").alias("exposure_seconds"), "bzero", "image_type", "bayer_pattern",
        F.col("subframe_y_position_in_binned_pixels").alias("subframe_y"), F.unix_micros("date_observed").alias("observed"),
    )


@query("SELECT s_suppkey, CAST(1 AS BIGINT) AS nth, s_name || '''s' AS object FROM supplier UNION ALL SELECT s_suppkey, 2, 'second' FROM supplier")
def raw_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = headers.raw_card(headers.parse(_supplier_cards(spark, sf_dir)), "OBJECT")
    return found.select("s_suppkey", F.row_number().over(Window.partitionBy("s_suppkey").orderBy("card_index")).cast("long").alias("nth"), F.col("string").alias("object"))


@query("SELECT s_suppkey, CAST(16 AS BIGINT) AS n_cards, CAST(2880 AS BIGINT) AS header_bytes, CAST(28 * s_suppkey AS BIGINT) AS data_bytes FROM supplier")
def header_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _supplier_cards(spark, sf_dir).groupBy("s_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("card_index", "card"))), lambda c: c["card"]), "").alias("text"))
    n = F.size(H.split_cards(F.col("text"))).cast("long")
    return text.select("s_suppkey", n.alias("n_cards"), H.header_bytes(n).alias("header_bytes"), H.data_bytes(F.lit(-32), F.array(F.col("s_suppkey").cast("bigint"), F.lit(7).cast("bigint"))).alias("data_bytes"))


@query("""SELECT DISTINCT CAST(p_size AS BIGINT) AS repeat, letter, CAST(CASE letter WHEN 'X' THEN (p_size + 7) // 8 WHEN 'A' THEN p_size WHEN 'I' THEN 2 * p_size WHEN 'E' THEN 4 * p_size WHEN 'D' THEN 8 * p_size ELSE 16 * p_size END AS BIGINT) AS bytes
  FROM part, (SELECT unnest(['X', 'A', 'I', 'E', 'D', 'M']) AS letter)""")
def format_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = _table(spark, sf_dir, "part").select("p_size").distinct().select(F.explode(F.array(*(F.concat(F.col("p_size").cast("string"), F.lit(x)) for x in "XAIEDM"))).alias("tform"))
    f = forms.withColumn("f", H.parse_format(F.col("tform")))
    return f.select(F.col("f.repeat").cast("long").alias("repeat"), "f.letter", H.format_bytes(F.col("f")).cast("long").alias("bytes"))


# Images: the embeddings as an image of 64 columns and a row a vector

PX = "px AS (SELECT vec_id AS y, unnest(generate_series(0, 63)) AS x, CAST(unnest(embedding) AS DOUBLE) AS p FROM embeddings)"
#: BITPIX, the sample in Spark and in SQL, and z and s; 8- and 32-bit samples are never 0.
KINDS: dict[str, tuple[int, str, str, str, float, float]] = {
    "u8": (8, "cast(pmod(cast(floor(p * 1000) as int), 250) + 1 as smallint)", "smallint", "CAST(((CAST(floor(p * 1000) AS INTEGER) % 250) + 250) % 250 + 1 AS BIGINT)", 0.0, 1.0),
    "i16": (16, "cast(floor(p * 1000) as smallint)", "smallint", "CAST(floor(p * 1000) AS BIGINT)", 32768.0, 1.0),
    "i32": (32, "cast(floor(p * 1000000) * 2 + 1 as int)", "int", "CAST(floor(p * 1000000) * 2 + 1 AS BIGINT)", 0.0, 1.0),
    "f32": (-32, "cast(p as float)", "float", "CAST(CAST(p AS FLOAT) AS DOUBLE)", 0.0, 1.0),
    "f64": (-64, "cast(p as double)", "double", "CAST(p AS DOUBLE)", 0.0, 1.0),
}


def _image(spark: SparkSession, sf_dir: str, kind: str, rows_a_plane: int | None = None, **more: object) -> str:
    bitpix, expr, _, _, z, s = KINDS[kind]
    px = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode(F.col("embedding").cast("array<double>")).alias("x", "p"))
    plane, y = (F.floor(F.col("y") / rows_a_plane), F.col("y") % rows_a_plane) if rows_a_plane else (F.lit(0).cast("bigint"), F.col("y"))
    samples = px.select(plane.alias("plane"), y.alias("y"), F.col("x").cast("bigint").alias("x"), F.expr(expr).alias("raw"))
    if rows_a_plane:
        more = more | {"height": rows_a_plane}
    return bridge.image_file(samples, bitpix=bitpix, bzero=z, bscale=s, **more)


def _raw(kind: str) -> None:
    out = "bigint" if KINDS[kind][0] > 0 else "double"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return images.read_image(spark, _image(spark, sf_dir, kind)).select("y", "x", F.col("raw").cast(out).alias("raw"))

    run.__name__ = f"image_raw_{kind}"
    query(f"WITH {PX} SELECT y, x, {KINDS[kind][3]} AS raw FROM px")(run)


def _normalize(kind: str, mode: str) -> None:
    bitpix, _, _, sql, z, s = KINDS[kind]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return images.normalized(images.read_image(spark, _image(spark, sf_dir, kind)), bitpix, mode).select("y", "x", "value")

    if bitpix < 0:
        value = sql
    else:
        most = {8: 255.0, 16: 32767.0, 32: 2147483647.0}[bitpix]
        a, b = f"(CAST({sql} AS DOUBLE) + CAST({z} AS DOUBLE)) * CAST({s} AS DOUBLE)", f"(CAST({most} AS DOUBLE) + CAST({z} AS DOUBLE))"
        value = f"{b} / ({a})" if mode == "reference" and bitpix in (8, 32) else f"({a}) / {b}"
    run.__name__ = f"image_normalize_{kind}" + ("_reference" if mode == "reference" else "")
    query(f"WITH {PX} SELECT y, x, {value} AS value FROM px")(run)


def _superpixel(kind: str, pattern: str, mode: str = "standard", pairs: bool = False) -> None:
    bitpix, _, _, sql, z, s = KINDS[kind]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _image(spark, sf_dir, kind, bayer=pattern)
        f, layout = (images.superpixel_pairs, "pairs") if pairs else (images.superpixel, "pixels")
        return f(images.read_image(spark, path, layout=layout), bitpix, mode=mode).select("y", "x", "r", "g", "b")

    places = images.PLACES[pattern]
    most = {8: 255.0, 16: 32767.0, 32: 2147483647.0}.get(bitpix, 1.0) + z
    at = lambda k: f"max(CASE WHEN x % 2 = {places[k][0]} AND y % 2 = {places[k][1]} THEN v END)"
    one = (lambda k: at(k)) if mode == "reference" or bitpix < 0 else (lambda k: f"((CAST({at(k)} AS DOUBLE) + CAST({z} AS DOUBLE)) * CAST({s} AS DOUBLE))")
    if mode == "reference" and bitpix == 8:  # wraps at 256
        r, g, b = (f"CAST({most} AS DOUBLE) * CAST({x} AS DOUBLE)" for x in (one(0), f"((({one(1)}) + ({one(2)})) % 256) // 2", one(3)))
    elif mode == "reference" and bitpix == 32:
        r, g, b = (f"CAST({most} AS DOUBLE) * CAST({x} AS DOUBLE)" for x in (one(0), f"trunc((({one(1)}) + ({one(2)})) / 2.0)", one(3)))
    elif bitpix == -32:
        r, g, b = one(0), f"CAST((CAST({one(1)} AS FLOAT) + CAST({one(2)} AS FLOAT)) / CAST(2 AS FLOAT) AS DOUBLE)", one(3)
    else:
        r, g, b = (x if bitpix < 0 else f"{x} / CAST({most} AS DOUBLE)" for x in (one(0), f"(({one(1)}) + ({one(2)})) / 2", one(3)))
    run.__name__ = f"image_superpixel_{kind}_{pattern.lower()}" + ("_reference" if mode == "reference" else "") + ("_pairs" if pairs else "")
    query(f"WITH {PX}, v AS (SELECT y, x, {sql} AS v FROM px) SELECT y // 2 AS y, x // 2 AS x, {r} AS r, {g} AS g, {b} AS b FROM v WHERE y < (SELECT (max(y) + 1) // 2 * 2 FROM v) GROUP BY y // 2, x // 2")(run)


for _kind in KINDS:
    _raw(_kind)
    _normalize(_kind, "standard")
for _kind in ("u8", "i32"):
    _normalize(_kind, "reference")
for _pattern in images.PLACES:
    _superpixel("i16", _pattern)
for _kind in ("u8", "i32", "f32", "f64"):
    _superpixel(_kind, "RGGB")
for _kind in ("u8", "i32"):
    _superpixel(_kind, "RGGB", "reference")
_superpixel("i16", "GBRG", pairs=True)

_GREY = "CAST(least(greatest(trunc(255.0 * CAST(p AS DOUBLE)), 0), 255) AS BIGINT)"


@query(f"WITH {PX} SELECT y, x, {_GREY} AS r, {_GREY} AS g, {_GREY} AS b FROM px")
def image_rgb_grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = images.rgb(images.read_image(spark, _image(spark, sf_dir, "f64")), -64)
    return out.select("y", "x", *(F.col(c).cast("long").alias(c) for c in "rgb"))


def _byte(x: str) -> str:
    return f"CAST(least(greatest(trunc(255.0 * ({x} / 65535.0)), 0), 255) AS BIGINT)"


@query(f"""WITH {PX}, v AS (SELECT y, x, CAST(floor(p * 1000) AS DOUBLE) + 32768.0 AS v FROM px),
  c AS (SELECT y // 2 AS y, x // 2 AS x, max(CASE WHEN x % 2 = 0 AND y % 2 = 0 THEN v END) AS r, (max(CASE WHEN x % 2 = 1 AND y % 2 = 0 THEN v END) + max(CASE WHEN x % 2 = 0 AND y % 2 = 1 THEN v END)) / 2 AS g,
    max(CASE WHEN x % 2 = 1 AND y % 2 = 1 THEN v END) AS b FROM v WHERE y < (SELECT (max(y) + 1) // 2 * 2 FROM v) GROUP BY y // 2, x // 2)
  SELECT y, x, {_byte('r')} AS r, {_byte('g')} AS g, {_byte('b')} AS b FROM c""")
def image_rgb_bayer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = images.rgb(images.read_image(spark, _image(spark, sf_dir, "i16", bayer="RGGB"), layout="pairs"), 16)
    return out.select("y", "x", *(F.col(c).cast("long").alias(c) for c in "rgb"))


@query(f"WITH {PX} SELECT y // 50 AS plane, y % 50 AS y, x, CAST(floor(p * 1000) AS BIGINT) AS raw FROM px")
def image_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.read_image(spark, _image(spark, sf_dir, "i16", rows_a_plane=50)).select("plane", "y", "x", F.col("raw").cast("long").alias("raw"))


@query(f"WITH {PX} SELECT y % 50 AS y, x, CAST(floor(p * 1000) AS BIGINT) AS raw FROM px WHERE y // 50 = 3")
def image_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.read_image(spark, _image(spark, sf_dir, "i16", rows_a_plane=50), plane=3).select("y", "x", F.col("raw").cast("long").alias("raw"))


@query("SELECT CAST(16 AS BIGINT) AS bitpix, CAST(64 AS BIGINT) AS width, CAST(50 AS BIGINT) AS height, CAST(count(*) // 50 AS BIGINT) AS n_planes, CAST(6400 AS BIGINT) AS plane_bytes, 32768.0::DOUBLE AS bzero, 'RGGB' AS bayer_pattern FROM embeddings")
def image_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = headers.hdus(spark, _image(spark, sf_dir, "i16", rows_a_plane=50, bayer="RGGB"))
    return headers.primary(catalog).select(F.col("bitpix").cast("long").alias("bitpix"), "width", "height", "n_planes", "plane_bytes", "bzero", "bayer_pattern")


@query(f"WITH {PX} SELECT y, x, 32768.0 + 1.0 * CAST(floor(p * 1000) AS DOUBLE) AS value FROM px")
def image_physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.physical(images.read_image(spark, _image(spark, sf_dir, "i16"))).select("y", "x", "value")


@query(f"WITH {PX} SELECT y, CAST(sum(CAST(floor(p * 1000) AS BIGINT)) AS BIGINT) AS total FROM px GROUP BY y")
def image_row_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = images.read_image(spark, _image(spark, sf_dir, "i16"), layout="rows")
    return rows.select("y", F.aggregate("raw", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))
