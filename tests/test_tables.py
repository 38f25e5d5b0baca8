import gzip
import struct

import fixtures as fx
import pytest
from astraframe.layout import Format, is_data_file, padded, parse_format, unique_names
from astraframe.operators import headers, memory, tables
from pyspark.sql import functions as F
from pyspark.sql import types as T

KDDE = [("source_id", "K"), ("ra", "D"), ("dec", "D"), ("mag", "E")]


def star(i):
    return struct.pack(">qddf", i, i + 0.5, -i - 1.5, 0.25)


def put(tmp_path, name, data):
    p = tmp_path / name
    p.write_bytes(data)
    return str(p)


def test_layout():
    assert [padded(n) for n in (0, 1, 2880, 2881)] == [0, 2880, 2880, 5760]
    assert [is_data_file(p) for p in ("a.fit", "a.fits.gz", "a.fts", "a.FITS", "a.txt", "a.gz")] == [True, True, True, False, False, False]
    assert parse_format("3J") == Format(3, "J") and parse_format("K") == Format(1, "K") and parse_format("20A5 x") == Format(20, "A", 5)
    assert parse_format("1PE(20)") == Format(1, "P", heap="E")
    assert [parse_format(f).width() for f in ("10X", "2C", "2M", "20A5", "3U")] == [2, 16, 32, 20, 6]
    assert [parse_format(f).width("reference") for f in ("10X", "2C", "2M", "20A5")] == [10, 8, 16, 100]
    for bad in ("", "Z", "1PP"):
        with pytest.raises(ValueError):
            parse_format(bad)
    assert [str(parse_format(f)) for f in ("3J", "K", "20A5")] == ["3J", "1K", "20A5"]
    assert unique_names(["a", "b", "A", "a"]) == ["a", "b", "A_2", "a_3"]


def test_golden_row(spark, tmp_path):
    row = bytes.fromhex("0000000000000001" "3ff8000000000000" "c004000000000000" "3e800000")
    path = put(tmp_path, "a.fits", fx.PRIMARY + fx.table(KDDE, [row], 28))
    df = tables.read_table(spark, path)
    assert df.schema.simpleString() == "struct<source_id:bigint,ra:double,dec:double,mag:float>"
    assert [tuple(r) for r in df.collect()] == [(1, 1.5, -2.5, 0.25)]


def test_ranges_projection_and_ordinals(spark, tmp_path):
    path = put(tmp_path, "a.fits", fx.PRIMARY + fx.table(KDDE, [star(i) for i in range(1000)], 28))
    whole = tables.read_table(spark, path, partitionBytes=5000, meta=True)
    assert whole.rdd.getNumPartitions() > 3
    assert [r[0] for r in whole.orderBy("_row").select("source_id").collect()] == list(range(1000))
    assert tables.read_table(spark, path, columns=["mag", "source_id"]).columns == ["mag", "source_id"]
    assert [tuple(r) for r in tables.read_table(spark, path, columns=["source_id"], rows=(10, 13)).collect()] == [(10, 10), (11, 11), (12, 12)]
    assert tables.row_at(spark, path, 1000).count() == 0 and tables.row_at(spark, path, 999).first()["source_id"] == 999
    assert whole.where("source_id >= 990").count() == 10
    assert tables.read_table(spark, path).count() == 1000
    with pytest.raises(ValueError):
        tables.read_table(spark, path, columns=["nothing"])


def test_records(spark, tmp_path):
    path = put(tmp_path, "a.fits", fx.PRIMARY + fx.table([("a", "K"), ("b", "3E")], [struct.pack(">q3f", 7, 1, 2, 3)], 20))
    assert tuple(tables.read_records(spark, path, T._parse_datatype_string("b float, a long")).first()) == (1.0, 7)
    with pytest.raises(TypeError):
        tables.read_records(spark, path, T._parse_datatype_string("a int"))
    with pytest.raises(ValueError):
        tables.read_records(spark, path, T._parse_datatype_string("c int"))


ALL = [("a", "8A"), ("l", "3L"), ("x", "10X"), ("b", "B"), ("s", "S"), ("i", "I"), ("u", "U"), ("j", "J"), ("v", "V"), ("k", "K"), ("e", "E"), ("d", "D"), ("c", "C"), ("m", "M"), ("i3", "3I"), ("z", "0J"), (None, "10A5")]
ALL_ROW = b"  hi \0\0\0" + b"TF\0" + bytes([0b10100000, 0b01000000]) + bytes([200, 200]) + struct.pack(">hHiIqfdffdd3h", -2, 65535, -3, 4000000000, -5, 1.5, 2.5, 1, 2, 3, 4, 7, 8, 9) + b"abc  de\0\0\0"


def test_every_letter(spark, tmp_path):
    path = put(tmp_path, "a.fits", fx.PRIMARY + fx.table(ALL, [ALL_ROW], len(ALL_ROW)))
    r = tables.read_table(spark, path).first()
    assert r["a"] == "hi" and r["l"] == [True, False, None]
    assert r["x"] == [True, False, True, False, False, False, False, False, False, True]
    assert (r["b"], r["s"], r["i"], r["u"], r["j"], r["v"], r["k"], r["e"], r["d"]) == (200, -56, -2, 65535, -3, 4000000000, -5, 1.5, 2.5)
    assert tuple(r["c"]) == (1, 2) and tuple(r["m"]) == (3, 4) and r["i3"] == [7, 8, 9] and r["z"] == [] and r["col17"] == ["abc", "de"]
    always = tables.read_table(spark, path, arrays=True).first()
    assert always["k"] == [-5] and always["a"] == "hi"


def test_reference_layout(spark, tmp_path):
    row = b"TF" + bytes([1, 0, 0]) + b"abcd" + struct.pack(">h", 5)
    path = put(tmp_path, "a.fits", fx.PRIMARY + fx.table([("l", "2L"), ("x", "3X"), ("w", "2A2"), ("i", "I")], [row], len(row)))
    r = tables.read_table(spark, path, mode="reference").first()
    assert r["l"] == [True, True] and r["x"] == [True, False, False] and r["w"] == ["ab", "cd"] and r["i"] == 5


def test_scaling_and_nulls(spark, tmp_path):
    rows = [struct.pack(">hihB", v, 150, 9, 1) for v in (-32768, 0, 7)]
    more = ("TZERO1  = 32768", "TSCAL2  = 0.01", "TNULL3  = 9", "TZERO4  = -128")
    path = put(tmp_path, "a.fits", fx.PRIMARY + fx.table([("u", "I"), ("j", "J"), ("n", "I"), ("b", "B")], rows, 9, *more))
    assert [tuple(r) for r in tables.read_table(spark, path).collect()] == [(-32768, 150, 9, 1), (0, 150, 9, 1), (7, 150, 9, 1)]
    assert [tuple(r) for r in tables.read_table(spark, path, scaling=True, nulls=True).collect()] == [(0, 1.5, None, -127), (32768, 1.5, None, -127), (32775, 1.5, None, -127)]


def test_heap_and_what_follows(spark, tmp_path):
    heap = struct.pack(">3f", 1, 2, 3) + b"text"
    rows = [struct.pack(">iiii", 2, 0, 4, 12), struct.pack(">iiii", 1, 8, 0, 0)]
    data = fx.PRIMARY + fx.table([("f", "1PE(2)"), ("t", "1PA(4)")], rows, 16, pcount=len(heap), heap=heap) + fx.table(KDDE, [star(3)], 28, extname="SECOND")
    path = put(tmp_path, "a.fits", data)
    assert [(r["f"], r["t"]) for r in tables.read_table(spark, path).collect()] == [([1.0, 2.0], "text"), ([3.0], "")]
    assert tables.read_table(spark, path, hdu="SECOND").first()["source_id"] == 3
    assert tables.read_table(spark, path, hdu=2).first()["source_id"] == 3


def test_no_extname_duplicates_and_other_units(spark, tmp_path):
    other = fx.header("XTENSION= 'FOREIGN'", "BITPIX  = 8", "NAXIS   = 1", "NAXIS1  = 100") + fx.pad(b"x" * 100)
    data = fx.PRIMARY + other + fx.table([("a", "J"), ("a", "J")], [struct.pack(">ii", 1, 2)], 8, extname=None)
    path = put(tmp_path, "a.fits", data)
    assert tuple(tables.read_table(spark, path).select("a", "a_2").first()) == (1, 2)
    rows = headers.hdus(spark, path).orderBy("hdu_index").collect()
    assert [(r.kind, r.data_bytes) for r in rows] == [("IMAGE", 0), ("OTHER", 100), ("BINTABLE", 8)]
    assert headers.extension_count(headers.hdus(spark, path)).first()["n_extensions"] == 2


def test_gzip_suffixes_and_folders(spark, tmp_path):
    data = fx.PRIMARY + fx.table(KDDE, [star(i) for i in range(10)], 28)
    for name in ("b.fits", "c.fts"):
        put(tmp_path, name, data)
    put(tmp_path, "a.fits.gz", gzip.compress(data))
    put(tmp_path, "d.FITS", data)
    put(tmp_path, "e.txt", data)
    df = tables.read_table(spark, str(tmp_path), meta=True)
    assert df.count() == 30 and df.select("_path").distinct().count() == 3
    assert tables.read_table(spark, f"{tmp_path}/*.gz").count() == 10
    with pytest.raises(Exception, match="not a .fit"):
        tables.read_table(spark, f"{tmp_path}/e.txt").count()


def test_truncated_and_malformed(spark, tmp_path):
    good = fx.PRIMARY + fx.table(KDDE, [star(i) for i in range(200)], 28)
    (tmp_path / "cut").mkdir()
    path = put(tmp_path, "cut/a.fits", good[: 2880 * 2 + 2880])
    for parse in ("PERMISSIVE", "FAILFAST"):
        with pytest.raises(Exception, match="ends early"):
            tables.read_table(spark, path, parse=parse).count()
    assert tables.read_table(spark, path, parse="DROPMALFORMED").count() == 0
    for name, data in {"simple.fits": fx.header("SIMPLE  = F", "NAXIS   = 0"), "none.fits": fx.header("BITPIX  = 8"), "noend.fits": fx.PRIMARY[:160].ljust(2880)}.items():
        path = put(tmp_path, name, data)
        assert headers.hdus(spark, path).where("error is not null").count() == 1
        with pytest.raises(Exception, match="SIMPLE|primary"):
            headers.hdus(spark, path, parse="FAILFAST").count()
    with pytest.raises(Exception, match="none of"):
        tables.read_table(spark, path, mode="odd").count()


def test_ascii_table(spark, tmp_path):
    row = b"   12 Vega      1.5D1  "
    more = ("TBCOL1  = 1", "TBCOL2  = 7", "TBCOL3  = 14", "TNULL1  = '-9'")
    data = fx.PRIMARY + fx.table([("n", "I5"), ("name", "A6"), ("x", "D10.3")], [row, b"   -9" + b" " * 18], len(row), *more, kind="TABLE")
    path = put(tmp_path, "a.fits", data)
    assert [tuple(r) for r in tables.read_table(spark, path, relation="ascii").collect()] == [(12, "Vega", 15.0), (None, "", None)]


def test_memory(spark, tmp_path):
    data = fx.PRIMARY + fx.table(KDDE, [star(i) for i in range(5)], 28)
    df = spark.createDataFrame([("a", data), ("b", gzip.compress(data)), ("c", None)], "path string, content binary")
    assert memory.relation(df).count() == 10
    assert memory.relation(df, "hdus").where("kind = 'BINTABLE'").agg(F.sum("n_rows")).first()[0] == 10
    assert memory.cards(df).where("keyword = 'EXTNAME'").select("string").distinct().collect()[0][0] == "T"


@pytest.mark.parametrize("drop", [True, False])
def test_files_of_one_header(spark, monkeypatch, drop):
    """A header that files in a row have in common is parsed once; rows, their order and errors are those of each file by itself."""
    import pyarrow as pa
    from astraframe.sources import source

    whole = [fx.PRIMARY + fx.table(KDDE, [star(10 * k + i) for i in range(2)], 28) for k in range(300)]
    other = fx.PRIMARY + fx.table(KDDE, [star(7)], 28)
    short = fx.PRIMARY + fx.table(KDDE, [star(1), star(2)], 28)[: 2880 + 40]
    files = [*whole[:100], other, *whole[100:200], *([short, b"nothing"] if drop else []), None, *whole[200:]]
    batches = [pa.record_batch([pa.array([str(k) for k in range(len(part))]), pa.array(part, pa.binary())], names=["path", "content"]) for part in (files[:150], files[150:])]
    schema = T._parse_datatype_string("source_id long, mag float, _path string, _hdu int, _row long")
    s = source.Settings(drop=drop)
    calls, pick = [], source.pick
    monkeypatch.setattr(source, "pick", lambda *a: calls.append(1) or pick(*a))
    got = [tuple(r.values()) for b in source.decode_bytes(iter(batches), schema, s) for r in b.to_pylist()]
    assert len(calls) < (205 if drop else 8)
    want = [tuple(r.values()) for b in batches for p, c in zip(*(x.to_pylist() for x in b.columns)) if c is not None for x in source._one_file(p, source.open_bytes(c, p), schema, s) for r in x.to_pylist()]
    assert got == want and len(got) == 601
    if not drop:
        with pytest.raises(ValueError, match="ends early"):
            list(source.decode_bytes(iter([pa.record_batch([["a", "b"], [whole[0], short]], names=["path", "content"])]), schema, s))


@pytest.mark.parametrize("one", [True, False])
def test_round_trip(spark, tmp_path, one):
    df = spark.createDataFrame([(1, "é", True, 1.5, [1, 2], None), (2, "", None, float("-inf"), [3, 4], 5)], "k long, s string, b boolean, d double, a array<int>, n int")
    path = str(tmp_path / "out")
    tables.write_table(df.coalesce(1) if one else df.repartition(2), path, extname="X")
    got = tables.read_table(spark, path, hdu="X").orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "é", True, 1.5, [1, 2], 0), (2, "", None, float("-inf"), [3, 4], 5)]
    tables.write_table(df.where("k = 1"), path, mode="append")
    assert tables.read_table(spark, path).count() == 3
    tables.write_table(df.where("k = 2").coalesce(1), path)
    assert tables.read_table(spark, path).count() == 1
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_temporary")]


def test_writing_holds_few_batches(spark, monkeypatch):
    """Of 64 MB no more than a few MB are in memory, and what was laid aside is what is written."""
    import numpy as np
    import pyarrow as pa
    from astraframe.sources import writer

    monkeypatch.setattr(writer, "HELD_BYTES", 4 << 20)
    base, most = pa.total_allocated_bytes(), 0

    def batches():
        nonlocal most
        for k in range(64):
            most = max(most, pa.total_allocated_bytes() - base)
            yield pa.record_batch([pa.array(np.arange(k << 16, (k + 1) << 16)), pa.array([f"{k:>{k % 7 + 1}}"] * (1 << 16))], names=["k", "s"])

    with writer.Aside(T._parse_datatype_string("k long, s string")) as held:
        held.take(batches())
        forms, at = held.forms(), 0
        assert forms == ["1K", "7A"] and held.rows == 64 << 16
        for c in writer.table_rows(held.again(), held.schema, forms):
            most = max(most, pa.total_allocated_bytes() - base)
            rows = np.frombuffer(c, np.dtype([("k", ">i8"), ("s", "S7")]))
            assert rows["k"][0] == at and rows["k"][-1] == at + len(rows) - 1 and int(rows["s"][-1]) == (at + len(rows) - 1) >> 16
            at += len(rows)
    assert at == 64 << 16 and most < 16 << 20


def test_rows_laid_aside_in_a_file(spark, monkeypatch):
    """A file is the same byte by byte, whether its rows were held in memory or not."""
    import pyarrow as pa
    from astraframe.sources import writer

    schema = T._parse_datatype_string("k long, s string, b boolean, d double, a array<int>, t timestamp, n short")
    columns = [[1, None, -3], ["é", "", None], [True, None, False], [1.5, None, float("-inf")], [[1, 2], [3, 4], [5, 6]], [0, None, 10**15], [None, 2, 3]]
    kinds = [pa.int64(), pa.string(), pa.bool_(), pa.float64(), pa.list_(pa.int32()), pa.timestamp("us", "UTC"), pa.int16()]
    batch = pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=schema.names)
    made = []
    for most in (0, 1 << 20):
        monkeypatch.setattr(writer, "HELD_BYTES", most)
        made.append(b"".join(writer.table_bytes([batch, batch.slice(1, 2), batch.slice(0, 0), batch], schema, "T", [])))
    assert made[0] == made[1] and len(made[0]) % 2880 == 0
    row = struct.pack(">q2s1sd2iqh", 1, "é".encode(), b"T", 1.5, 1, 2, 0, 0)
    assert row in made[0] and made[0].count(struct.pack(">q2s1sd2iqh", -3, b"  ", b"F", float("-inf"), 5, 6, 10**15, 3)) == 3


def test_addressed_rows_plan_their_ranges_only(spark, tmp_path):
    from astraframe.sources import source

    data = fx.PRIMARY + fx.table(KDDE, [star(i) for i in range(5000)], 28)
    path, s = put(tmp_path, "a.fits", data), source.Settings(partition_bytes=2880, meta=True)
    schema = T._parse_datatype_string("source_id long, _row long")
    for low, high in ((100, 1100), (0, 1), (4999, 5000), (0, 5000), (4990, 9000), (6000, 7000)):
        reader = source.PushdownReader(path, schema, s, False)
        reader.low, reader.high = low, high
        planned = [p for p in reader.partitions() if p.pieces]
        assert [r["_row"] for p in planned for b in reader.read(p) for r in b.to_pylist()] == list(range(low, min(high, 5000)))
        assert len(planned) <= (min(high, 5000) - low) * 28 // 2880 + 4 or low > 5000 and not planned


def test_single_file_of_many_tasks(spark, tmp_path):
    """In the order of partitions, with text as wide as the widest of any task; partitions without rows too."""
    df = spark.range(1000, numPartitions=7).where("id >= 300").select("id", F.when(F.col("id") % 10 > 0, F.lpad(F.lit("é"), (F.col("id") / 100).cast("int"), "x")).alias("s"), F.array(F.col("id"), F.lit(1)).alias("a"))
    path = str(tmp_path / "out")
    tables.write_table(df, path, single=True, extname="ONE")
    assert len([p for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")]) == 1
    got = tables.read_table(spark, path, hdu="ONE", meta="true").orderBy("_row").select("id", "s", "a").collect()
    assert [(r[0], r[1] or None, r[2]) for r in got] == [tuple(r) for r in df.collect()] and len(got) == 700
    tables.write_table(df.where("id < 0"), path, single=True)
    assert headers.table_rows(headers.hdus(spark, path)).first()["n_rows"] == 0
    with pytest.raises(Exception, match="as many in each row"):
        tables.write_table(df.select(F.expr("if(id < 600, array(1), array(1, 2))").alias("a")), path, single=True)


def test_encode_in_memory(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 6, "bc"), (2, 7, "d")], "k int, v long, s string")
    files = memory.encode_tables(df, "k", extname="E")
    assert files.count() == 2
    assert sorted(tuple(r) for r in memory.relation(files, path_col="k", hdu="E").collect()) == [(5, "a"), (6, "bc"), (7, "d")]


def test_unwritable(spark, tmp_path):
    with pytest.raises(Exception, match="can't be written"):
        tables.write_table(spark.createDataFrame([({"a": 1},)], "m map<string,int>"), str(tmp_path / "x"))


def test_largest_asserted_workload(spark, tmp_path):
    import numpy as np

    n = 2_482_633
    rows = np.zeros(n, np.dtype([("i", ">i8"), ("ra", ">f8"), ("dec", ">f8"), ("m", ">f4")]))
    rows["i"], rows["ra"] = np.arange(n), 1.0
    path = tmp_path / "big.fits"
    head = fx.table(KDDE, [], 28).replace(b"NAXIS2  = 0".ljust(80), f"NAXIS2  = {n}".ljust(80).encode())
    path.write_bytes(fx.PRIMARY + head + fx.pad(rows.tobytes()))
    assert path.stat().st_size == 69_520_320
    record = T._parse_datatype_string("source_id long, ra double, dec double, mag float")
    assert tables.read_records(spark, str(path), record, partitionBytes=16 << 20).agg(F.count("*"), F.sum("source_id"), F.sum("ra")).first()[:] == (n, n * (n - 1) // 2, float(n))
    assert headers.table_rows(headers.hdus(spark, str(path))).first()["n_rows"] == n
