"""Every registered query beside its SQL on the smallest scale, and the shape of the plans."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, rows_of

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="session")
def db(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    got = [tuple(row) for row in frame.collect()]
    if name in ORACLES:
        want = db.sql(ORACLES[name])
        assert sorted(frame.columns) == sorted(want.columns)
        assert rows_of(frame.columns, got) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", [
    "flagship_connected_per_zone", "agg05_connected_zones", "join10_proximity_pairs", "join12_label_overlaps", "join09_co_occurrence",
    "join01_edge_ends", "set04_snapshot_diff", "win07_zone_top_lists", "join25_zone_scores", "top08_priority_review",
])
def test_no_product_and_no_nested_loop(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_what_is_asked(spark, sf_dir):
    plan = QUERIES["src02_projected_read"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(l_returnflag" in plan and "l_extendedprice" not in plan


def test_unused_year_join_is_dropped(spark, sf_dir):
    from evigraph.plans import views

    plan = views.entities(spark, sf_dir).select("id", "zone")._jdf.queryExecution().executedPlan().toString()
    assert "o_orderdate" not in plan
