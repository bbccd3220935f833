"""Every registered query that the lake has, against its SQL in DuckDB."""

import math

import duckdb
import pytest

from fernlake.plans import lake_queries, registry, relational

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for t in relational.TABLES:
        connection.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    return repr(round(float(value), 6)) if isinstance(value, (int, float)) else str(value)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, oracle, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    if name not in registry.oracle_sql():
        assert rows
        return
    want = oracle.sql(registry.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert sorted([plain(r[c]) for c in columns] for r in rows) == sorted([plain(r[i]) for i in order] for r in want.fetchall())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(lake_queries.queries()) <= set(entry.queries())


@pytest.mark.parametrize("keys", [[], [1, 2, 2], [1, None]])
def test_not_in_has_nulls_as_in_sql(spark, keys):
    rows, keys = spark.createDataFrame([(1,), (3,), (3,), (None,)], "x int"), spark.createDataFrame([(k,) for k in keys], "k int")
    rows.createOrReplaceTempView("not_in_rows")
    keys.createOrReplaceTempView("not_in_keys")
    want = spark.sql("SELECT x FROM not_in_rows WHERE x NOT IN (SELECT k FROM not_in_keys)").collect()
    assert sorted(map(str, relational.not_in(rows, "x", keys, "k").collect())) == sorted(map(str, want))


def test_subquery_in_broadcasts_no_keys(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = relational.queries()["subquery_in"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "LeftAnti" in plan and "BroadcastHashJoin" not in plan


def test_compaction_to_several_files(spark, oracle, monkeypatch):
    monkeypatch.setattr(lake_queries.maintain, "TARGET_BYTES", 10_000)
    rows = lake_queries.queries()["compaction_parity"](spark, SF).collect()
    want = oracle.sql(registry.oracle_sql()["compaction_parity"]).fetchall()
    assert sorted(r["event_id"] for r in rows) == sorted(r[0] for r in want)
