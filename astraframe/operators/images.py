"""Operators over images: planes, normalized samples, superpixels, RGB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import image as I
from ..layout import BAYER_PATTERNS
from ..sources.source import register

# The places (x, y) of red, both greens and blue in a 2 by 2 block.
PLACES = {
    "RGGB": ((0, 0), (1, 0), (0, 1), (1, 1)),
    "BGGR": ((1, 1), (1, 0), (0, 1), (0, 0)),
    "GRBG": ((1, 0), (0, 0), (1, 1), (0, 1)),
    "GBRG": ((0, 1), (0, 0), (1, 1), (1, 0)),
}
NO_PATTERN = "Can not perform superpixel demosaic on a non rgb image: it has no Bayer pattern that is known, and none was given"


def read_image(spark: SparkSession, path: str, plane: int | None = None, layout: str = "pixels", schema: T.StructType | str | None = None, **options: object) -> DataFrame:
    """Samples (plane, y, x, raw) with their image's constants, or rows of samples.

    Of a plane only its own bytes are read; one that isn't there is empty.
    """
    if plane is not None:
        options = options | {"plane": plane}
    r = register(spark).read.format("starfile").option("relation", "image").option("layout", layout)
    for k, v in options.items():
        r = r.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    return (r.schema(schema) if schema is not None else r).load(path)


def bitpix_of(df: DataFrame) -> int:
    """BITPIX by the type of raw; 8- and 16-bit samples have one type, and the first row tells."""
    kind = df.schema["raw"].dataType
    kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
    known = {"int": 32, "bigint": 64, "float": -32, "double": -64}
    if kind.simpleString() in known:
        return known[kind.simpleString()]
    first = df.select("bitpix").first()
    return first[0] if first else 16


def normalized(df: DataFrame, bitpix: int | None = None, mode: str = "standard") -> DataFrame:
    """Pixels with ``value``, the normalized sample."""
    return df.withColumn("value", I.normalize(F.col("raw"), bitpix or bitpix_of(df), F.col("bzero"), F.col("bscale"), mode))


def physical(df: DataFrame, blank: int | None = None) -> DataFrame:
    """Pixels with ``value``, the physical value; null where the sample is blank."""
    raw = F.col("raw") if blank is None else I.blank(F.col("raw"), F.lit(blank))
    return df.withColumn("value", I.physical(raw, F.col("bzero"), F.col("bscale")))


def superpixel(df: DataFrame, bitpix: int | None = None, pattern: str | None = None, mode: str = "standard", key: tuple[str, ...] = ("plane",)) -> DataFrame:
    """(plane, y, x, r, g, b) of 2 by 2 blocks of pixels; odd last rows and columns are left out.

    The pattern is the image's, or the one given; without one it is an error. In reference mode
    patterns other than RGGB give zeros.
    """
    bitpix = bitpix or bitpix_of(df)
    if pattern is not None and pattern.upper() not in PLACES:
        raise ValueError(f"{pattern!r} is none of {', '.join(BAYER_PATTERNS)}")
    bayer = F.lit(pattern.upper()) if pattern else F.col("bayer_pattern")
    known = F.coalesce(*(F.when(bayer == name, i) for i, name in enumerate(PLACES)), F.lit(-1))  # a number, as text would make Spark sort all pixels
    df = df.where((F.col("x") < F.floor(F.col("width") / 2) * 2) & (F.col("y") < F.floor(F.col("height") / 2) * 2))
    at = lambda x, y: F.max(F.when((F.col("x") % 2 == x) & (F.col("y") % 2 == y), F.col("raw")))
    names = {(0, 0): "p00", (1, 0): "p10", (0, 1): "p01", (1, 1): "p11"}
    blocks = df.groupBy(*key, F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).agg(
        *(at(*xy).alias(n) for xy, n in names.items()), F.first(known).alias("bayer"), F.first("bzero").alias("bzero"), F.first("bscale").alias("bscale")
    )
    blocks = blocks.withColumn("bayer", F.coalesce(*(F.when(F.col("bayer") == i, name) for i, name in enumerate(PLACES))))
    return _channels(blocks, names, bitpix, mode).select(*key, "y", "x", "r", "g", "b")


def _channels(blocks: DataFrame, names: dict[tuple[int, int], str], bitpix: int, mode: str) -> DataFrame:
    z, s = F.col("bzero"), F.col("bscale")

    def channel(k: int) -> Column:
        out = F.when(F.col("bayer").isNull(), F.raise_error(F.lit(NO_PATTERN)).cast("double"))
        for name, places in PLACES.items():
            if mode == "reference" and name != "RGGB":
                value: Column = F.lit(0.0)
            elif k == 1:
                value = I.superpixel_channel(F.col(names[places[1]]), bitpix, z, s, F.col(names[places[2]]), mode)
            else:
                value = I.superpixel_channel(F.col(names[places[0 if k == 0 else 3]]), bitpix, z, s, None, mode)
            out = out.when(F.col("bayer") == name, value)
        return out.otherwise(F.raise_error(F.lit(NO_PATTERN)).cast("double"))

    return blocks.withColumns({"r": channel(0), "g": channel(1), "b": channel(2)})


def superpixel_pairs(df: DataFrame, bitpix: int | None = None, pattern: str | None = None, mode: str = "standard") -> DataFrame:
    """superpixel() over pairs of rows, as layout="pairs" reads them: nothing is shuffled."""
    bitpix = bitpix or bitpix_of(df.select(F.get("even", F.lit(0)).alias("raw"), "bitpix"))
    bayer = F.lit(pattern.upper()) if pattern else F.col("bayer_pattern")
    blocks = df.where("width >= 2").select("plane", "y", bayer.alias("bayer"), "bzero", "bscale", "even", "odd", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("width") / 2) - 1)).alias("x"))
    names = {(0, 0): "p00", (1, 0): "p10", (0, 1): "p01", (1, 1): "p11"}
    take = lambda c, k: F.get(F.col(c), (F.col("x") * 2 + k).cast("int"))
    blocks = blocks.withColumns({n: take("odd" if xy[1] else "even", xy[0]) for xy, n in names.items()})
    return _channels(blocks, names, bitpix, mode).select("plane", "y", "x", "r", "g", "b")


def rgb(df: DataFrame, bitpix: int | None = None, pattern: str | None = None, bayer: bool | None = None, mode: str = "standard") -> DataFrame:
    """(plane, y, x, r, g, b) as bytes: superpixels where there is a Bayer pattern, else grey.

    Pairs of rows, as layout="pairs" reads them, give superpixels without a shuffle.
    """
    if "even" in df.columns:
        return superpixel_pairs(df, bitpix, pattern, mode).select("plane", "y", "x", *(I.byte_channel(F.col(c)).alias(c) for c in "rgb"))
    if bayer is None:
        first = None if pattern else df.select("bayer_pattern").first()
        bayer = bool(pattern) or bool(first and first[0])
    if bayer:
        out = superpixel(df, bitpix, pattern, mode)
        return out.select("plane", "y", "x", *(I.byte_channel(F.col(c)).alias(c) for c in "rgb"))
    grey = I.byte_channel(F.col("value"))
    return normalized(df, bitpix, mode).select("plane", "y", "x", *(grey.alias(c) for c in "rgb"))


def write_images(df: DataFrame, path: str, mode: str = "overwrite", **options: object) -> None:
    """(plane, y, x, raw) or rows of samples to one image file, whose planes one task holds; no rows give an empty file set."""
    register(df.sparkSession)
    w = df.coalesce(1).write.format("starfile").mode(mode).option("kind", "image")
    for k, v in options.items():
        w = w.option(k, str(v))
    w.save(path)
