"""Files made from tables at run time, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..layout import BLOCK, padded
from ..operators import images, tables
from ..sources.headers import units
from ..sources.storage import file_system, list_files, open_file


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where it is unset on one machine, a local folder of this session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="astraframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/astraframe/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def drop_shared(spark: SparkSession) -> None:
    """Remove what this session has put into the shared folder."""
    fs, inner = file_system(shared_folder(spark).rsplit("/", 1)[0])
    if fs.get_file_info(inner).type == pafs.FileType.Directory:
        fs.delete_dir(inner)


def table_files(df: DataFrame, one: bool = False, **options: object) -> str:
    """The table as files, one a partition or one in all, in the order of df; their folder."""
    path = shared_folder(df.sparkSession)
    tables.write_table(df, path, **(options | {"single": "true"} if one else options))
    return path


def image_file(df: DataFrame, **options: object) -> str:
    path = shared_folder(df.sparkSession)
    images.write_images(df, path, **options)
    return path


def joined(spark: SparkSession, folders: list[str]) -> str:
    """One file with the table of each folder (of one file each) as an extension; its folder."""
    out = shared_folder(spark)
    fs, inner = file_system(out)
    fs.create_dir(inner, recursive=True)
    with fs.open_output_stream(f"{inner}/all.fits") as f:
        for k, folder in enumerate(folders):
            file = open_file(list_files(folder)[0][0])
            first = 0 if k == 0 else next(u for u in units(file) if u.index == 1).offset
            for at in range(first, file.size, 8 << 20):
                f.write(file.at(at, min(8 << 20, file.size - at)))
            file.close()
    return out


def text_card(keyword: str, value: Column | str) -> Column:
    """A card of 80 characters as an expression; value as it is to stand."""
    value = F.lit(value) if isinstance(value, str) else value
    return F.rpad(F.concat(F.lit(f"{keyword:<8}= "), value), 80, " ")


def quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def header(cards: list[Column]) -> Column:
    n = padded(80 * (len(cards) + 1))
    return F.rpad(F.concat(*cards, F.lit("END")), n, " ")


def primary() -> Column:
    return header([text_card("SIMPLE", "T"), text_card("BITPIX", "8"), text_card("NAXIS", "0")])


def table_header(kind: str, row_bytes: int, rows: int, columns: list[dict[str, str]], more: list[Column] = []) -> Column:  # noqa: B006
    """A table's header: a dictionary a column of keyword stems and values as they stand."""
    cards = [text_card("XTENSION", f"'{kind}'"), text_card("BITPIX", "8"), text_card("NAXIS", "2"), text_card("NAXIS1", str(row_bytes)), text_card("NAXIS2", str(rows)), text_card("PCOUNT", "0"), text_card("GCOUNT", "1"), text_card("TFIELDS", str(len(columns)))]
    cards += [text_card(f"{k}{i}", v) for i, c in enumerate(columns, 1) for k, v in c.items()]
    return header(cards + more)


#: Headers that a task makes of a table's rows; Spark sorts their cards to aggregate them.
UNITS_A_TASK = 2_000


def spread(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """The rows in tasks of about so many: those of a small table become whole files, or headers of many cards."""
    return df.repartition(max(1, -(-df.count() // rows)))


def big_endian(value: Column, size: int) -> Column:
    """An integer's last size bytes."""
    return F.unhex(F.right(F.lpad(F.hex(value.cast("bigint")), 16, "0"), F.lit(2 * size)))


def content(head: Column, data: Column) -> Column:
    """A file of an empty primary unit and one extension of at most a block of data."""
    return F.concat(F.concat(primary(), head).cast("binary"), F.rpad(data, BLOCK, bytes(1)))
