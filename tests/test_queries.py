"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SMALL, plan_of
from sediment.plans.catalog import catalog
from sediment.plans.loading import TABLES
from sediment.plans.oracle_sql import ORACLES


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


#: Their results are read from what they wrote before, in part by stateful streams, which run in Python.
WRITES_FIRST = {
    "stream_equals_batch", "stream_hourly_clicks", "stream_first_arrivals", "stream_late_clicks", "stream_newest_wins", "two_sources",
    "message_stream_bounds", "load_to_folders", "error_gate", "replayed_batch", "pause_and_resume", "job_status", "file_stream_rows",
    "load_files_once", "nightly_batch", "physical_removal_check", "day_table_upsert", "day_table_retention", "compact_partition",
    "delete_user", "folder_delete_user", "folder_compact", "folder_removal_proof", "folder_audit", "table_lifecycle", "rebucket",
    "roundtrip_formats", "colocated_join", "bucket_shuffle_join", "sized_bucket_join",
}


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


def test_every_query_has_its_sql():
    assert set(catalog()) == set(ORACLES)
    assert set(catalog()) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog()))
def test_query_equals_sql(spark, db, name):
    frame = entry.queries()[name](spark, SMALL)
    result = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert bag(frame.columns, frame.collect()) == bag(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog()))
def test_no_cross_product_and_no_python_in_the_plan(spark, name):
    if name in WRITES_FIRST:
        pytest.skip("writes tables first; checked by the query test")
    plan = plan_of(entry.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan
