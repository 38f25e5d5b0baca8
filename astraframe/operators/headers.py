"""Operators over the hdus and cards relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import header as H
from ..layout import FAMILIES, KEYWORDS
from ..sources.source import register

KEY = ("path", "hdu_index")


def _read(spark: SparkSession, path: str, relation: str, **options: object) -> DataFrame:
    r = register(spark).read.format("starfile").option("relation", relation)
    for k, v in options.items():
        r = r.option(k, str(v))
    return r.load(path)


def hdus(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """One row a header-data unit: places, sizes, kind, shape; only headers are read."""
    return _read(spark, path, "hdus", **options)


def primary(catalog: DataFrame) -> DataFrame:
    return catalog.where("hdu_index = 0")


def extensions(catalog: DataFrame) -> DataFrame:
    return catalog.where("hdu_index > 0")


def extension(catalog: DataFrame, index: int) -> DataFrame:
    """The extension of a zero-based index in each file; no row where there is none."""
    return catalog.where(F.col("hdu_index") == index + 1)


def extension_count(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("path").agg(F.count_if(F.col("hdu_index") > 0).alias("n_extensions"))


def table_rows(catalog: DataFrame) -> DataFrame:
    """Rows of each table, from headers alone."""
    return catalog.where(F.col("kind").isin("BINTABLE", "TABLE")).select(*KEY, "extname", "n_rows", "table_bytes")


def cards(spark: SparkSession, path: str, mode: str = "standard", **options: object) -> DataFrame:
    """One row a card: path, hdu_index, card_index, card, and its parsed fields."""
    return parse(_read(spark, path, "cards", **options).where("card is not null"), mode)


def parse(df: DataFrame, mode: str = "standard", card_col: str = "card") -> DataFrame:
    """Rows with a card of 80 characters, and its parsed fields (H.PARSED), which replace columns of their names."""
    kept = [c for c in df.columns if c not in H.PARSED]
    df = df.select(*kept)
    for step in H.card_steps(df[card_col], mode):
        df = df.withColumns(step)
    return df.select(*kept, *H.PARSED)


def failfast(parsed: DataFrame) -> DataFrame:
    """The cards, or an error that names the first card that can't be parsed."""
    said = F.concat(F.lit("card "), F.col("card_index"), F.lit(": "), F.coalesce("error", F.concat(F.lit("invalid value of "), F.col("keyword"))))
    bad = F.col("error").isNotNull() | (F.col("kind") == "invalid")
    return parsed.withColumn("card", F.when(bad, F.raise_error(said)).otherwise(F.col("card")))


def stitch(parsed: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Long text: a string that ends with & and the CONTINUE cards after it become one card."""
    by = Window.partitionBy(*key).orderBy("card_index")
    goes_on = (F.col("keyword") == "CONTINUE") & F.coalesce(F.lag(F.col("string").endswith("&")).over(by), F.lit(False))
    df = parsed.withColumn("__goes_on", goes_on).withColumn("__head", F.sum((~F.col("__goes_on")).cast("int")).over(by))
    parts = F.array_sort(F.collect_list(F.struct("card_index", F.regexp_replace("string", "&$", "").alias("s"))))
    long = df.groupBy(*key, "__head").agg(F.array_join(F.transform(parts, lambda x: x["s"]), "").alias("__text"), F.count("*").alias("__n"))
    df = df.where("not __goes_on").join(long, [*key, "__head"])
    return df.withColumn("string", F.when(F.col("__n") > 1, F.col("__text")).otherwise(F.col("string"))).select(*parsed.columns)


def raw_card(parsed: DataFrame, keyword: str) -> DataFrame:
    """All cards of a keyword, in order of card_index within a unit."""
    return parsed.where(F.col("keyword") == keyword)


def _typed(kind: str, integers_too: bool = True) -> Column:
    number = F.coalesce(F.col("float"), F.col("int").cast("double"))
    return {
        "string": F.coalesce(F.col("string"), F.col("int").cast("string")), "int": F.col("int"), "bool": F.col("bool"), "float": number, "time": H.timestamp(F.col("string")),
        "bayer": H.bayer_pattern(F.col("string")), "xtension": H.extension(F.col("string")), "imagetype": H.image_type(F.col("string")),
    }[kind]


def typed_header(parsed: DataFrame, key: tuple[str, ...] = KEY, keywords: list[str] | None = None) -> DataFrame:
    """One row a unit: a typed column a keyword, named by its accessor, and a map a family of indexed ones.

    The first card of a keyword counts, and a value of another type than the keyword's is null;
    integers are taken for floats, and TNULL also as an integer. Maps are from one-based indexes.
    """
    stem, n = H.family_of(F.col("keyword"))
    parsed = parsed.withColumns({"__stem": stem, "__n": n})
    one = []
    for k, name, kind in KEYWORDS:
        if keywords is None or k in keywords:
            hit = F.col("keyword") == k
            one.append(F.min_by(F.struct(_typed(kind).alias("v")), F.when(hit, F.col("card_index")))["v"].alias(name))
    for family, name, kind in FAMILIES:
        if keywords is None or family in keywords:
            n = F.col("__n")
            entries = F.array_sort(F.collect_list(F.when(F.col("__stem") == family, F.struct(n.alias("n"), F.col("card_index").alias("at"), _typed(kind).alias("v")))))
            firsts = F.filter(entries, lambda e, i: (i == 0) | (F.get(entries, i - 1)["n"] != e["n"]))
            one.append(F.map_from_entries(F.transform(firsts, lambda e: F.struct(e["n"], e["v"]))).alias(name))
    return parsed.groupBy(*key).agg(*one)


def images_exposure_time(header: DataFrame) -> DataFrame:
    """Seconds of EXPOSURE, else of EXPTIME."""
    return header.withColumn("images_exposure_time", F.coalesce("exposure", "exposure_time"))


def render(parsed: DataFrame) -> DataFrame:
    """A line of text a card."""
    c = F.struct(*(F.col(n) for n in ("keyword", "kind", "int", "float", "bool", "string", "re", "im", "comment")))
    return parsed.withColumn("line", H.pretty(c))
