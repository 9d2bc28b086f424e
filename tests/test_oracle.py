"""Every registered query against its SQL statement on the smallest driver tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from panelscope.plans.stages import INTERNAL, TABLES
from tests.compare import assert_same

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


PANEL = sorted(n for n in ("raw_clicks", "google_trends", *TABLES) if n not in INTERNAL)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def test_every_table_of_the_analysis_has_a_statement():
    assert set(PANEL) <= set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", PANEL)
def test_query(spark, con, name):
    df = entry_module.queries()[name](spark, SF_DIR)
    assert_same(df, con, entry_module.oracle_sql()[name])


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["brand", "entry_source", "visits", "pct_of_brand_visits"]
    assert df.count() > 0
