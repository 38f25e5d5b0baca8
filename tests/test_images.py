import math
import struct

import fixtures as fx
import pytest
from astraframe.functions import image as I
from astraframe.operators import headers, images
from astraframe.streaming import streams
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLES = {8: "B", 16: "h", 32: "i", 64: "q", -32: "f", -64: "d"}
GRID = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16]


def put(tmp_path, data, name="a.fits"):
    p = tmp_path / name
    p.write_bytes(data)
    return str(p)


@pytest.mark.parametrize("bitpix", SAMPLES)
def test_raw(spark, tmp_path, bitpix):
    path = put(tmp_path, fx.image(GRID, SAMPLES[bitpix], bitpix, (4, 4)))
    df = images.read_image(spark, path)
    assert [r[0] for r in df.orderBy("y", "x").select("raw").collect()] == GRID
    r = df.first()
    assert (r["bitpix"], r["bzero"], r["bscale"], r["bayer_pattern"]) == (bitpix, 0.0, 1.0, None)
    rows = images.read_image(spark, path, layout="rows").orderBy("y").collect()
    assert [r["raw"] for r in rows] == [GRID[i : i + 4] for i in range(0, 16, 4)]


def one(spark, e):
    return spark.range(1).select(e).first()[0]


def test_normalize_goldens(spark):
    n = lambda p, b, z, mode: one(spark, I.normalize(F.lit(p), b, F.lit(z), F.lit(1.0), mode))
    for mode in ("standard", "reference"):
        assert [n(p, 16, 32768.0, mode) for p in (-32768, 0, 32767)] == [0.0, 32768 / 65535, 1.0]
    assert n(51, 8, 0.0, "reference") == 5.0 and n(51, 8, 0.0, "standard") == 0.2
    assert n(0, 8, 0.0, "reference") == math.inf and n(0, 8, 0.0, "standard") == 0.0
    assert n(1, 32, 0.0, "reference") == 2147483647.0 and n(1, 32, 0.0, "standard") == 1 / 2147483647
    assert n(2.5, -64, 9.0, "standard") == 2.5
    assert one(spark, I.physical(F.lit(3), F.lit(10.0), F.lit(2.0))) == 16.0
    assert one(spark, I.blank(F.lit(3), F.lit(3))) is None


def test_superpixel_goldens(spark, tmp_path):
    path = put(tmp_path, fx.image([-32768, 0, 0, 32767], "h", 16, (2, 2), "BZERO   = 32768", "BSCALE  = 1", "BAYERPAT= 'RGGB'"))
    for mode in ("standard", "reference"):
        assert tuple(images.superpixel(images.read_image(spark, path), mode=mode).select("r", "g", "b").first()) == (0.0, 32768 / 65535, 1.0)
    path = put(tmp_path, fx.image([10, 200, 100, 5], "B", 8, (2, 2), "BAYERPAT= 'RGGB'"), "b.fits")
    df = images.read_image(spark, path)
    assert tuple(images.superpixel(df, mode="reference").select("r", "g", "b").first()) == (2550.0, 255.0 * ((200 + 100) % 256 // 2), 5 * 255.0)
    assert tuple(images.superpixel(df).select("r", "g", "b").first()) == (10 / 255, 150 / 255, 5 / 255)


@pytest.mark.parametrize("pairs", [False, True])
@pytest.mark.parametrize("pattern", images.PLACES)
def test_patterns_and_odd_sizes(spark, tmp_path, pattern, pairs):
    path = put(tmp_path, fx.image(range(15), "d", -64, (5, 3), f"BAYERPAT= '{pattern.lower()}'"))
    f = images.superpixel_pairs if pairs else images.superpixel
    df = images.read_image(spark, path, layout="pairs" if pairs else "pixels")
    got = [tuple(r) for r in f(df).orderBy("y", "x").select("y", "x", "r", "g", "b").collect()]
    at = lambda bx, p: float((p[1]) * 5 + bx * 2 + p[0])
    pr, g1, g2, pb = images.PLACES[pattern]
    assert got == [(0, bx, at(bx, pr), (at(bx, g1) + at(bx, g2)) / 2, at(bx, pb)) for bx in (0, 1)]
    other = f(df, mode="reference").first()
    assert (other["r"], other["g"], other["b"]) == (0.0, 0.0, 0.0) or pattern == "RGGB"


def test_pairs_of_odd_planes(spark, tmp_path):
    path = put(tmp_path, fx.image(range(18), "h", 16, (2, 3, 3), "BAYERPAT= 'RGGB'"))
    df = images.read_image(spark, path, layout="pairs", partitionBytes=2900)
    assert [(r["plane"], r["y"], r["even"], r["odd"]) for r in df.orderBy("plane").collect()] == [(p, 0, [6 * p, 6 * p + 1], [6 * p + 2, 6 * p + 3]) for p in range(3)]
    pixels = images.superpixel(images.read_image(spark, path)).orderBy("plane").collect()
    assert images.superpixel_pairs(df).orderBy("plane").collect() == pixels


def test_no_pattern(spark, tmp_path):
    path = put(tmp_path, fx.image(GRID, "h", 16, (4, 4)))
    with pytest.raises(Exception, match="non rgb image"):
        images.superpixel(images.read_image(spark, path)).collect()
    with pytest.raises(ValueError):
        images.superpixel(images.read_image(spark, path), pattern="XYZ")


def test_rgb(spark, tmp_path):
    path = put(tmp_path, fx.image([0.5, 1.2, -0.1, math.nan], "d", -64, (4, 1)))
    got = images.rgb(images.read_image(spark, path)).orderBy("x").collect()
    assert [r["r"] for r in got] == [127, 255, 0, 0] and all(r["r"] == r["g"] == r["b"] for r in got)
    path = put(tmp_path, fx.image([0.5, 1.0, 0.0, 2.0], "d", -64, (2, 2), "BAYERPAT= 'RGGB'"), "b.fits")
    assert tuple(images.rgb(images.read_image(spark, path)).select("r", "g", "b").first()) == (127, 127, 255)


def test_cube_planes_and_catalog(spark, tmp_path):
    path = put(tmp_path, fx.image(range(24), "h", 16, (4, 2, 3), "EXPTIME = 600", "IMAGETYP= 'Light'"))
    row = headers.hdus(spark, path).first()
    assert (row.width, row.height, row.n_planes, row.plane_bytes, row.image_type, row.exposure_seconds) == (4, 2, 3, 16, "Light", 600.0)
    assert [r["raw"] for r in images.read_image(spark, path, plane=2).orderBy("y", "x").collect()] == list(range(16, 24))
    assert images.read_image(spark, path, plane=3).count() == 0
    assert images.read_image(spark, path, partitionBytes=2900).count() == 24


def test_empty_primary_and_image_extension(spark, tmp_path):
    path = put(tmp_path, fx.PRIMARY)
    assert images.read_image(spark, path).count() == 0
    path = put(tmp_path, fx.PRIMARY + fx.image(GRID, "h", 16, (4, 4), "EXTNAME = 'SCI'", primary=False), "b.fits")
    assert images.read_image(spark, path).count() == 16 and images.read_image(spark, path, hdu="SCI").count() == 16


@pytest.mark.parametrize("bitpix", SAMPLES)
def test_write_images(spark, tmp_path, bitpix):
    kind = {8: "smallint", 16: "smallint", 32: "int", 64: "bigint", -32: "float", -64: "double"}[bitpix]
    df = spark.range(30).select(F.floor(F.col("id") / 15).alias("plane"), F.floor(F.col("id") % 15 / 5).alias("y"), (F.col("id") % 5).alias("x"), F.col("id").cast(kind).alias("raw"))
    path = str(tmp_path / "out")
    images.write_images(df, path, bitpix=bitpix, bzero=2.0, bscale=0.5, bayer="BGGR", header="OBJECT=M31\nGAIN=2.5\nFLAG=T")
    back = images.read_image(spark, path)
    assert [r["raw"] for r in back.orderBy("plane", "y", "x").collect()] == list(range(30))
    assert back.first()["bzero"] == 2.0 and back.first()["bayer_pattern"] == "BGGR"
    raw = next(p for p in (tmp_path / "out").iterdir() if p.suffix == ".fits").read_bytes()
    assert len(raw) % 2880 == 0 and raw[2880 : 2880 + abs(bitpix) // 8 * 2] == struct.pack(f">2{SAMPLES[bitpix]}", 0, 1)
    head = headers.typed_header(headers.cards(spark, path), keywords=["OBJECT", "NAXIS"]).first()
    assert head["object"] == "M31" and head["naxis_n"] == {1: 5, 2: 3, 3: 2}


def test_streams(spark, tmp_path):
    path = put(tmp_path, fx.image([0, 1, 2, 3], "h", 16, (2, 2), "BZERO   = 32768", "BSCALE  = 1"))
    got = list(streams.stream_normalized_image(spark, path))
    assert sorted(got) == sorted((x, y, (2 * y + x + 32768) / 65535) for y in (0, 1) for x in (0, 1))
    rows = struct.pack(">q", 5)
    (tmp_path / "in").mkdir()
    one = put(tmp_path, fx.PRIMARY + fx.table([("k", "K")], [rows], 8), "in/a.fits")
    assert [r["k"] for r in streams.stream_rows(spark, one)] == [5]
    df = streams.arriving(spark, str(tmp_path / "in"), "table", "k long")
    q = df.writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select * from arrived").count() == 1


def test_last_plane_not_full(spark, tmp_path):
    """13 rows of 4 in planes of 5: two whole planes, and 3 rows in an extension."""
    df = spark.range(52).select(F.floor(F.col("id") / 20).alias("plane"), F.floor(F.col("id") % 20 / 4).alias("y"), (F.col("id") % 4).alias("x"), F.col("id").cast("smallint").alias("raw"))
    path = str(tmp_path / "out")
    with pytest.raises(Exception, match="don't fill"):
        images.write_images(df, path, bitpix=16)
    images.write_images(df, path, bitpix=16, bzero=1.0, bayer="RGGB", height=5)
    for size in (2900, 1 << 20):
        back = images.read_image(spark, path, partitionBytes=size)
        assert sorted(map(tuple, back.select("plane", "y", "x", "raw").collect())) == sorted(map(tuple, df.collect()))
        assert {r["bzero"] for r in back.collect()} == {1.0}
        assert [r["raw"] for r in images.read_image(spark, path, plane=2, layout="rows", partitionBytes=size).orderBy("y").collect()] == [list(range(40 + 4 * k, 44 + 4 * k)) for k in range(3)]
        assert images.read_image(spark, path, plane=3, partitionBytes=size).count() == 0
        pairs = images.superpixel_pairs(images.read_image(spark, path, layout="pairs", partitionBytes=size)).orderBy("plane", "y", "x").collect()
        assert pairs == images.superpixel(back).orderBy("plane", "y", "x").collect() and len(pairs) == 10
    catalog = headers.hdus(spark, path)
    assert [(r.width, r.height, r.n_planes) for r in catalog.orderBy("hdu_index").collect()] == [(4, 5, 2), (4, 3, 1)]
    images.write_images(df.where("raw < 8"), path, bitpix=16, height=5)
    one = headers.primary(headers.hdus(spark, path)).first()
    assert (one.width, one.height, one.n_planes) == (4, 5, 0) and images.read_image(spark, path, plane=0).count() == 8


def test_superpixels_sort_no_pixels(spark, tmp_path):
    """Aggregated in hash maps (which no text buffer allows); a task's pixels are few, and small files share one."""
    from astraframe.sources import source

    path = put(tmp_path, fx.image(GRID, "h", 16, (4, 4), "BAYERPAT= 'GRBG'"))
    plan = images.superpixel(images.read_image(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan
    wide = fx.image([0] * 8_000_000, "B", 8, (4000, 2000))
    (tmp_path / "many").mkdir()
    put(tmp_path, wide, "many/a.fits")
    for k in range(32):
        put(tmp_path, fx.image(GRID, "h", 16, (4, 4)), f"many/b{k}.fits")
    s = source.Settings.of({"relation": "image"})
    reader = source.Reader(str(tmp_path / "many"), T.StructType(source.image_fields(8, s)), s, False)
    planned = reader.partitions()
    assert [len(p.pieces) for p in planned] == [1, 1, 16, 16]
    batches = list(reader.read(planned[0]))
    assert sum(b.num_rows for b in batches) == 4_000_000 and max(b.nbytes for b in batches) < 32 << 20


def test_writing_an_image_holds_its_samples(spark, tmp_path, monkeypatch):
    import numpy as np
    import pyarrow as pa
    from astraframe.sources import writer

    base, most = pa.total_allocated_bytes(), 0
    monkeypatch.setattr(writer, "HELD_BYTES", 1 << 20)

    def batches():
        nonlocal most
        for y in range(200):
            most = max(most, pa.total_allocated_bytes() - base)
            x = np.arange(5000)
            yield pa.record_batch([np.full(5000, y // 100), np.full(5000, y % 100), x, (x + y).astype(np.int16)], names=["plane", "y", "x", "raw"])

    with writer.Aside(T._parse_datatype_string("plane long, y long, x long, raw short")) as held:
        held.take(batches())
        planes, rest = writer.stack(held)
    assert planes.shape == (2, 100, 5000) and not len(rest) and planes[1, 7, 9] == 107 + 9 and planes.dtype == np.int16
    assert most < 8 << 20
