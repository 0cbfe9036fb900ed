"""A few registered queries against DuckDB on the smallest tables; tools_check.py runs all."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from tools_check import TABLES, compare

SF_DIR = "/root/testdata/sf0.001"
CHOSEN = [
    "recode_map", "inclusion_filter", "outer_merge", "snapshot_round_trip", "csv_round_trip", "crosstab_many",
    "weighted_boxplot", "flux", "predictor_store", "stream_inclusion", "class_stats",
]


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return db


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_its_text(spark, duck, name):
    ours = entry_module.queries()[name](spark, SF_DIR).toArrow()
    truth = duck.execute(entry_module.oracle_sql()[name]).to_arrow_table()
    assert compare(ours, truth).startswith("ok")


def test_entry_and_registry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
