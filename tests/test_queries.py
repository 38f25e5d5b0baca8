import os
import shutil
import subprocess
import sys

import astraframe.plans.coverage  # noqa: F401
import duckdb
import pytest
from astraframe.operators import images
from astraframe.plans import bridge, coverage, queries
from astraframe.plans.queries import ORACLES, QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    found = con.sql(ORACLES[name])
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(found.columns)
    assert sorted(map(repr, map(tuple, df.select(*found.columns).collect()))) == sorted(map(repr, found.fetchall()))


@pytest.mark.parametrize("name", ["image_catalog", "image_plane", "image_plane_index", "image_planes", "stream_pixels"])
@pytest.mark.parametrize("rows", [163, 507])
def test_planes_of_any_number_of_rows(spark, tmp_path, name, rows):
    """Vectors that don't fill their planes."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * FROM (SELECT * FROM '{SF}/embeddings.parquet' UNION ALL SELECT vec_id + 500, embedding, label FROM '{SF}/embeddings.parquet') WHERE vec_id < {rows}) TO '{tmp_path}/embeddings.parquet'")
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    found = con.sql(ORACLES[name])
    df = QUERIES[name](spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, df.select(*found.columns).collect()))) == sorted(map(repr, found.fetchall()))


@pytest.mark.parametrize("name, tasks", [("table_small_ints", 4), ("table_bits", 4), ("table_string_arrays", 1), ("table_ascii", 1)])
def test_rows_that_become_files_are_spread(spark, monkeypatch, name, tasks):
    monkeypatch.setattr(bridge.spread, "__defaults__", (60,))
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() == tasks


@pytest.mark.parametrize("name", ["image_superpixel_i16_bggr", "image_superpixel_i16_gbrg", "image_superpixel_i16_grbg", "image_superpixel_i16_rggb", "image_superpixel_i32_rggb", "image_superpixel_i32_rggb_reference", "image_superpixel_u8_rggb", "image_superpixel_u8_rggb_reference", "image_superpixel_f32_rggb", "image_superpixel_f64_rggb"])
def test_pixels_are_not_sorted(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan


def test_pixels_of_errors_are_not_sorted(spark):
    grey = images.read_image(spark, queries._image(spark, SF, "i16"))
    plan = images.superpixel(grey, 16).agg(F.sum("r"))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan


@pytest.mark.parametrize("made", [coverage._headers_of_suppliers, queries._supplier_cards])
def test_headers_of_a_task_are_few(spark, monkeypatch, made):
    """A small table's rows become many cards each, which one task doesn't sort."""
    monkeypatch.setattr(bridge, "UNITS_A_TASK", 3)
    assert made(spark, SF).rdd.getNumPartitions() == 4


def test_entry_without_training_data_operators(tmp_path):
    """A copy of the repository without them: the entry and all other queries are there."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 70 and set(e.oracle_sql()) == set(e.queries()); assert not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True, timeout=120)


def test_no_shuffle_of_pixels(spark):
    plan = QUERIES["image_rgb_bayer"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 6
