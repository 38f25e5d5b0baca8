"""Headline timings: prints one JSON line. Files are encoded first; what is timed is reading and computing.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 5; the median counts, after a warm-up, of fewer
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
SF, CPUS, RUNS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "5"))


def head(*cards: str) -> bytes:
    data = "".join(f"{c:<80}" for c in (*cards, "END")).encode()
    return data.ljust(-(-len(data) // 2880) * 2880)


def write_frame(folder: str, w: int = 6000, h: int = 4000) -> str:
    """A 16-bit RGGB frame, made by hand."""
    import numpy as np

    os.makedirs(folder)
    with open(f"{folder}/frame.fits", "wb") as f:
        f.write(head("SIMPLE  = T", "BITPIX  = 16", "NAXIS   = 2", f"NAXIS1  = {w}", f"NAXIS2  = {h}", "BZERO   = 32768.0", "BSCALE  = 1.0", "BAYERPAT= 'RGGB'"))
        f.write((np.arange(w * h) % 65536 - 32768).astype(">i2").tobytes().ljust(-(-2 * w * h // 2880) * 2880, b"\0"))
    return folder


def write_small_files(folder: str, n: int = 10_000) -> str:
    """Small files of one table each, made by hand."""
    os.makedirs(folder)
    primary = head("SIMPLE  = T", "BITPIX  = 8", "NAXIS   = 0")
    table = head("XTENSION= 'BINTABLE'", "BITPIX  = 8", "NAXIS   = 2", "NAXIS1  = 8", "NAXIS2  = 20", "PCOUNT  = 0", "GCOUNT  = 1", "TFIELDS = 1", "TTYPE1  = 'ID'", "TFORM1  = '1K'", "EXTNAME = 'T'")
    for k in range(n):
        with open(f"{folder}/{k:05d}.fits", "wb") as f:
            f.write(primary + table + bytes(2880))
    return folder


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from astraframe.operators import headers, images, tables
    from astraframe.plans import bridge

    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    done = lambda df: df.write.format("noop").mode("overwrite").save()
    lineitem = bridge.table_files(read("lineitem").repartition(int(CPUS)))
    stars = bridge.table_files(spark.range(0, 2_482_633, numPartitions=1).select(F.col("id").alias("source_id"), (F.col("id") * 1e-4).alias("ra"), (F.col("id") * -1e-5).alias("dec"), F.lit(12.5).cast("float").alias("mag")))
    own = tempfile.mkdtemp(prefix="bench-")
    frame, small = write_frame(f"{own}/frame"), write_small_files(f"{own}/small")
    queries = {
        "star_count_and_sum": lambda: tables.read_table(spark, stars, partitionBytes=8 << 20).agg(F.count("*"), F.sum("source_id"), F.sum("ra")).collect(),
        "star_metadata_count": lambda: headers.table_rows(headers.hdus(spark, stars)).agg(F.sum("n_rows")).collect(),
        "lineitem_full_decode": lambda: done(tables.read_table(spark, lineitem)),
        "lineitem_one_column": lambda: done(tables.read_table(spark, lineitem, columns=["l_quantity"])),
        "lineitem_aggregate": lambda: tables.read_table(spark, lineitem, columns=["l_returnflag", "l_linestatus", "l_quantity"]).groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity")).collect(),
        "frame_normalize": lambda: images.normalized(images.read_image(spark, frame, partitionBytes=2 << 20), 16).agg(F.sum("value")).collect(),
        "frame_rgb": lambda: images.rgb(images.read_image(spark, frame, layout="pairs", partitionBytes=2 << 20), 16).agg(F.sum("g")).collect(),
        "frame_superpixel": lambda: images.superpixel_pairs(images.read_image(spark, frame, layout="pairs", partitionBytes=2 << 20), 16).agg(F.sum("g")).collect(),
        "header_catalogue_10000_files": lambda: headers.hdus(spark, small).count(),
    }
    try:
        from astraframe.llm.queries import QUERIES

        queries |= {name: (lambda f=f: done(f(spark, SF))) for name, f in QUERIES.items()}
    except ImportError:
        pass
    took = {}
    for name, run in queries.items():
        times = []
        for k in range(RUNS + 1):
            began = time.perf_counter()
            run()
            times.append(time.perf_counter() - began)
            if sum(times) > 60 and k:
                break
        took[name] = round(median(times[1:]), 3)
    print(json.dumps({"metric": "sum of median seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF.rstrip("/")), "cpus": int(CPUS), "runs": RUNS}), flush=True)
    os._exit(0)


if __name__ == "__main__":
    main()
