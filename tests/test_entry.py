"""The registry, with and without the corpus operators, and the queries against their SQL."""

import glob
import os
import subprocess
import sys

import pytest

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Cheap queries of every kind; the driver compares them all.
NAMES = ["raster_events", "raster_embeddings", "image_file_source", "lab_convert", "lab_f_table", "spatial_lut_euclid", "seed_grid", "seed_window", "even_split", "tile_grid", "assign_once", "update_once", "iterate_n3_stride3", "segment_stats", "segment_many_images"]


def normal(frame):
    columns = sorted(frame.columns)
    rows = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(str([int(v) if isinstance(v, float) and v == int(v) else v for v in r]) for r in rows.values.tolist())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    base = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        base.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    assert normal(entry.queries()[name](spark, DATA).toPandas()) == normal(base.execute(entry.oracle_sql()[name]).df())


def test_every_oracle_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_without_the_corpus_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['pixeloom.llm'] = None\nimport __spark_entry__ as e; assert e.queries() and not [n for n in e.queries() if n.startswith('op')]"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
