"""Queries over lake tables: each builds a lake from a test table, works on it, and returns what a reader sees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlake.functions import json as J
from fernlake.operators import maintain
from fernlake.plans.front import Lake
from fernlake.sources.scratch import scratch


def source(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lake_of(spark: SparkSession, sf_dir: str, partition_by: str = "event_id", parts: int = 1, columns: list[str] | None = None) -> Lake:
    """A lake with table events, in as many batches by range of event_id as asked for."""
    lake, df = Lake(spark, scratch(spark)), source(spark, sf_dir)
    df = df.select(*columns) if columns else df
    lake.create_table("events", df.schema, partition_cols=[partition_by])
    if parts == 1:
        lake.insert("events", df)
    else:
        top = df.agg(F.max("event_id")).first()[0] + 1
        for i in range(parts):
            lake.insert("events", df.where((F.col("event_id") * parts >= i * top) & (F.col("event_id") * parts < (i + 1) * top)).coalesce(1))
    return lake


NULLS = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-minute count and sum by type, after an append that adds a column and a DELETE."""
    lake = Lake(spark, scratch(spark))
    df = source(spark, sf_dir)
    old = df.where("event_id % 2 = 0").select("event_id", "ts", "user_id", "event_type", "value")
    lake.create_table("events", old.schema, partition_cols=["ts"])
    lake.insert("events", old)
    lake.insert("events", df.where("event_id % 2 = 1"))  # brings props
    lake.delete("events", "event_type = 'error' AND value < 50")
    return lake.sql("SELECT CAST(date_trunc('MINUTE', ts) AS TIMESTAMP_NTZ) AS minute, event_type, COUNT(*) AS n, COUNT(props) AS with_props, CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")


FLAGSHIP_SQL = "SELECT date_trunc('minute', ts) AS minute, event_type, COUNT(*) AS n, COUNT(CASE WHEN event_id % 2 = 1 THEN props END) AS with_props, CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events WHERE NOT (event_type = 'error' AND value < 50) GROUP BY 1, 2"


def agg_pushdown_global(spark, sf_dir):
    return lake_of(spark, sf_dir, parts=3).sql("SELECT COUNT(*) AS n, COUNT(user_id) AS c, SUM(user_id) AS s, MIN(event_type) AS lo, MAX(event_id) AS hi FROM events")


def agg_pushdown_grouped(spark, sf_dir):
    return lake_of(spark, sf_dir, parts=3).sql("SELECT event_type, user_id, COUNT(*) AS n, SUM(event_id) AS s, MIN(event_id) AS lo FROM events GROUP BY event_type, user_id")


def agg_pushdown_nullgroup(spark, sf_dir):
    lake = Lake(spark, scratch(spark))
    df = source(spark, sf_dir).select("event_id", F.expr(NULLS).alias("s"))
    lake.create_table("t", df.schema)
    lake.insert("t", df)
    return lake.sql("SELECT s, COUNT(*) AS n, COUNT(s) AS c, SUM(event_id) AS total FROM t GROUP BY s")


def agg_pushdown_filtered(spark, sf_dir):
    return lake_of(spark, sf_dir, parts=3).sql("SELECT event_type, COUNT(*) AS n, MAX(user_id) AS hi FROM events WHERE (event_id >= 200 AND 700 > event_id OR user_id = 7) AND event_type IS NOT NULL GROUP BY event_type")


def dv_delete_visible(spark, sf_dir):
    lake = lake_of(spark, sf_dir, parts=2)
    lake.sql("DELETE FROM events WHERE event_type = 'view' AND value > 20")
    lake.sql("DELETE FROM events WHERE user_id % 10 = 3")  # a second vector on the same files
    return lake.table("events")


def delete_null_predicate(spark, sf_dir):
    """Only rows for which the predicate is true go; null keeps."""
    lake = Lake(spark, scratch(spark))
    df = source(spark, sf_dir).select("event_id", F.expr(NULLS).alias("s"))
    lake.create_table("t", df.schema)
    lake.insert("t", df)
    lake.delete("t", "s <> 'click'")
    return lake.table("t")


def update_where(spark, sf_dir):
    lake = lake_of(spark, sf_dir, parts=2, columns=["event_id", "user_id", "event_type"])
    lake.sql("UPDATE events SET user_id = user_id + 1000, event_type = concat(event_type, '!') WHERE event_id % 5 = 0 AND user_id < 90")
    return lake.table("events")


def update_twice(spark, sf_dir):
    lake = lake_of(spark, sf_dir, columns=["event_id", "user_id"])
    lake.update("events", {"user_id": "-1"}, "event_id < 100")
    lake.update("events", {"user_id": "event_id"}, "user_id = -1 AND event_id % 2 = 0")
    return lake.table("events")


def truncate_then_insert(spark, sf_dir):
    lake = lake_of(spark, sf_dir, parts=2)
    lake.sql("TRUNCATE TABLE events")
    lake.insert("events", source(spark, sf_dir).where("event_id % 11 = 0"))
    return lake.table("events")


def drop_shard(spark, sf_dir):
    lake = Lake(spark, scratch(spark))
    df = source(spark, sf_dir)
    lake.create_table("events", df.schema)
    for shard in ("a", "b"):
        lake.insert("events", df.where(f"event_id % 2 = {int(shard == 'b')}"), shard=shard)
    lake.drop_shard("events", "a")
    return lake.table("events")


def snapshot_time_travel(spark, sf_dir):
    lake = lake_of(spark, sf_dir, parts=2)
    version = lake.log.snapshot().version
    lake.delete("events", "value > 10")
    lake.truncate("events")
    return lake.table("events", version=version)


def changes_since(spark, sf_dir):
    lake = lake_of(spark, sf_dir, parts=3)
    version = lake.log.snapshot().version
    lake.insert("events", source(spark, sf_dir).where("event_id < 50"))
    rows = sum(f["rows"] for f in lake.log.snapshot().files_since(version, "public.events"))
    return spark.createDataFrame([(rows,)], "n bigint")


def schema_evolve_add_column(spark, sf_dir):
    lake = lake_of(spark, sf_dir, columns=["event_id", "user_id"])
    lake.insert("events", source(spark, sf_dir).select("event_id", "event_type").where("event_id % 4 = 1"))
    return lake.table("events")


def schema_evolve_widen(spark, sf_dir):
    lake = Lake(spark, scratch(spark))
    df = source(spark, sf_dir).select("event_id", F.col("user_id").cast("int").alias("v"))
    lake.create_table("t", df.schema)
    lake.insert("t", df)
    lake.insert("t", df.select("event_id", (F.col("v").cast("bigint") + 3_000_000_000).alias("v")))
    lake.insert("t", df.select("event_id", (F.col("v") / 2).cast("double").alias("v")))
    return lake.table("t")


def alter_add_drop(spark, sf_dir):
    lake = lake_of(spark, sf_dir, columns=["event_id", "user_id", "event_type"])
    lake.sql("ALTER TABLE events ADD COLUMN note TEXT")
    lake.sql("ALTER TABLE events DROP COLUMN user_id")
    lake.sql("INSERT INTO events (event_id, note) VALUES (-1, 'new')")
    return lake.table("events")


def insert_values_types(spark, sf_dir):
    lake = Lake(spark, scratch(spark))
    lake.sql("CREATE TABLE t (i INT NOT NULL, u BIGINT UNSIGNED, d DECIMAL(10,2), f DOUBLE, s VARCHAR(20), b BOOLEAN, dt DATE, ts TIMESTAMP)")
    lake.sql("INSERT INTO t VALUES (1, 9000000000000000000, 12.34, 1.5e1, 'it''s', TRUE, '2024-02-29', '2021-03-04T05:06:07Z'), (-2, NULL, -0.5, .25, '', FALSE, NULL, 1500)")
    lake.sql("INSERT INTO t (s, i) VALUES ('part', 3)")
    return lake.sql("SELECT i, CAST(u AS DOUBLE) AS u, CAST(d AS DOUBLE) AS d, f, s, b, dt, ts FROM t")


INSERT_VALUES_SQL = """SELECT * FROM (VALUES
 (1, 9000000000000000000::DOUBLE, 12.34::DOUBLE, 15.0::DOUBLE, 'it''s', TRUE, DATE '2024-02-29', TIMESTAMP '2021-03-04 05:06:07'),
 (-2, NULL, -0.5::DOUBLE, 0.25::DOUBLE, '', FALSE, NULL, TIMESTAMP '1970-01-01 00:00:01.5'),
 (3, NULL, NULL, NULL, 'part', NULL, NULL, NULL)) AS v(i, u, d, f, s, b, dt, ts)"""


def insert_select_cast(spark, sf_dir):
    lake = lake_of(spark, sf_dir, columns=["event_id", "user_id", "event_type"])
    lake.sql("CREATE TABLE small (k BIGINT NOT NULL, cost INT, txt TEXT)")
    lake.sql("INSERT INTO small SELECT event_id, user_id, user_id FROM events WHERE event_type = 'click'")
    return lake.table("small")


def idempotent_replay(spark, sf_dir):
    lake = Lake(spark, scratch(spark))
    df = source(spark, sf_dir)
    lake.create_table("events", df.schema, require_key=True)
    for attempt in range(2):
        for i in range(3):
            receipt = lake.insert("events", df.where(f"event_id % 3 = {i}"), key=f"load#{i}")
            assert receipt.duplicate == (attempt == 1)
    return lake.table("events")


def minute_window_partition(spark, sf_dir):
    """Rows by the minute they belong to; files carry the minute of their least timestamp."""
    lake = lake_of(spark, sf_dir, partition_by="ts", parts=4)
    windows = {f["time_window"] for f in lake.log.snapshot().visible("public.events")}
    assert len(windows) == 4
    return lake.sql("SELECT CAST(date_trunc('MINUTE', ts) AS TIMESTAMP_NTZ) AS w, COUNT(*) AS n FROM events GROUP BY 1")


def prune_parity_range(spark, sf_dir):
    lake = lake_of(spark, sf_dir, parts=5)
    found = lake.sql_partial("SELECT event_id, user_id FROM events WHERE event_id >= 100 AND event_id < 150")
    (info,) = found.scans.values()
    assert len(info.pruned) >= 3
    return found.df


def prune_parity_eq(spark, sf_dir):
    """An even id is looked up among odd ones' neighbours: in range of one file, in no row group."""
    lake = Lake(spark, scratch(spark))
    df = source(spark, sf_dir).where("event_id % 2 = 0").orderBy("event_id")
    lake.create_table("events", df.schema, partition_cols=["event_id"])
    lake.insert("events", df)
    return lake.sql("SELECT event_id, event_type FROM events WHERE event_id = 501 OR event_id = 502")


def compaction_parity(spark, sf_dir):
    lake = lake_of(spark, sf_dir, parts=6)
    lake.delete("events", "event_id % 13 = 0")
    size = sum(f["bytes"] for f in lake.log.snapshot().visible("public.events"))
    assert lake.compact("events")
    state = lake.log.snapshot()
    assert len(state.visible("public.events")) <= max(1, -(-size // maintain.TARGET_BYTES)) and not state.live_vectors()
    return lake.table("events")


def garbage_parity(spark, sf_dir):
    lake = lake_of(spark, sf_dir, parts=5)
    lake.delete("events", "event_id % 17 = 1")
    lake.compact("events")
    assert lake.collect_garbage(grace_seconds=-10)
    return lake.table("events")


def stream_exactly_once(spark, sf_dir):
    """A stream of files, ended and started again: every row once."""
    lake = Lake(spark, scratch(spark))
    df = source(spark, sf_dir)
    lake.create_table("events", df.schema)
    folder, checkpoint = f"{scratch(spark)}/in", f"{scratch(spark)}/checkpoint"
    for i in range(2):
        df.where(f"event_id % 2 = {i}").write.mode("append").parquet(folder)
        lake.write_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(folder), "events", "load", checkpoint).awaitTermination()
    return lake.table("events")


def stream_tumbling_window(spark, sf_dir):
    lake = lake_of(spark, sf_dir)
    return lake.table("events").groupBy(F.window("ts", "1 minute").start.alias("w"), "event_type").agg(F.count("*").alias("n"))


def json_get_int(spark, sf_dir):
    return lake_of(spark, sf_dir).sql("SELECT event_id, json_get_int(props, 'k') AS k, json_get_str(props, 'k') AS s, json_get_int(props, 'none') AS missing FROM events")


def json_paths(spark, sf_dir):
    doc = """'{"a":{"b":7,"c":"x"},"a.b":9,"arr":[10,20,{"z":true}],"n":null,"f":1.5}'"""
    return Lake(spark, scratch(spark)).sql(
        f"SELECT json_get_int({doc}, 'a', 'b') AS nested, json_get_int({doc}, 'a.b') AS dotted, json_get_int({doc}, 'arr', 1) AS item, json_get_int('[10,20,30]', 1) AS root, json_get_bool({doc}, 'arr', 2, 'z') AS flag, "
        f"json_get_float({doc}, 'f') AS f, json_get_int({doc}, 'a', 'c') AS not_int, json_get_str({doc}, 'a', 'b') AS not_str, json_length({doc}, 'arr') AS len, json_length({doc}) AS size, json_contains({doc}, 'a', 'b') AS has, json_contains({doc}, 'x') AS hasnt, json_as_text({doc}, 'a', 'c') AS txt, json_get_json({doc}, 'a', 'c') AS js"
    )


JSON_PATHS_SQL = "SELECT 7::BIGINT AS nested, 9::BIGINT AS dotted, 20::BIGINT AS item, 20::BIGINT AS root, TRUE AS flag, 1.5::DOUBLE AS f, NULL::BIGINT AS not_int, NULL::VARCHAR AS not_str, 3::BIGINT AS len, 5::BIGINT AS size, TRUE AS has, FALSE AS hasnt, 'x' AS txt, '\"x\"' AS js"


def json_columns(spark, sf_dir):
    """The same functions as column builders."""
    return source(spark, sf_dir).select("event_id", J.json_get_int("props", "k").alias("k"), J.json_as_text("props", "k").alias("t"), J.json_length("props").alias("n"), J.json_contains("props", "k").alias("has"))


def show_tables(spark, sf_dir):
    lake = lake_of(spark, sf_dir)
    lake.sql("CREATE TABLE copy LIKE events")
    return lake.sql("SHOW TABLES")


def show_columns(spark, sf_dir):
    return lake_of(spark, sf_dir).sql("DESCRIBE events").select("Field", "Type", "Null")


def information_schema(spark, sf_dir):
    return lake_of(spark, sf_dir).sql("SELECT table_name, column_name, ordinal_position FROM information_schema.columns")


def show_create(spark, sf_dir):
    return lake_of(spark, sf_dir).sql("SHOW CREATE TABLE events")


def explain_shape(spark, sf_dir):
    return lake_of(spark, sf_dir).sql("EXPLAIN SELECT COUNT(*) FROM events").select("plan_type")


def create_like(spark, sf_dir):
    lake = lake_of(spark, sf_dir)
    lake.sql("CREATE TABLE copy LIKE events")
    lake.sql("INSERT INTO copy SELECT * FROM events WHERE event_id < 10")
    return lake.table("copy")


def two_schemas(spark, sf_dir):
    lake = Lake(spark, scratch(spark))
    lake.sql("CREATE SCHEMA other")
    for name, row in (("public.t", "(1, 100)"), ("other.t", "(9, 900)")):
        lake.sql(f"CREATE TABLE {name} (ts BIGINT, amt BIGINT)")
        lake.sql(f"INSERT INTO {name} VALUES {row}")
    return lake.sql("SELECT a.amt AS a, b.amt AS b FROM t a CROSS JOIN other.t b")


def prepared(spark, sf_dir):
    lake = lake_of(spark, sf_dir)
    return lake.execute_prepared(lake.prepare("SELECT event_id FROM events WHERE event_type = ? AND event_id < ?"), ["view", 500])


def generate_series(spark, sf_dir):
    return Lake(spark, scratch(spark)).sql("SELECT value AS x FROM generate_series(3, abs(-9))")


def series_in_string(spark, sf_dir):
    """A string that looks like a call stays a string."""
    return lake_of(spark, sf_dir, columns=["event_id"]).sql("SELECT event_id, 'generate_series(1, 2)' AS s FROM events")


def cte_named_like_table(spark, sf_dir):
    """The CTE hides the table after its definition, and reads the table inside it."""
    lake = lake_of(spark, sf_dir, columns=["event_id", "user_id"])
    return lake.sql("WITH events AS (SELECT event_id + 1 AS event_id FROM events WHERE user_id < 50) SELECT event_id FROM events WHERE event_id % 2 = 0")


def prune_nested_field(spark, sf_dir):
    """A field of a struct that is named like a column is not weighed by the column's statistics."""
    lake, df = Lake(spark, scratch(spark)), source(spark, sf_dir).select("event_id", F.struct((F.col("event_id") + 1000000).alias("event_id")).alias("m"))
    lake.create_table("nested", df.schema, partition_cols=["event_id"])
    lake.insert("nested", df)
    lake.delete("nested", "m.event_id < 1000100")
    return lake.sql("SELECT event_id FROM nested WHERE m.event_id >= 1000050 AND nested.event_id < 500")


def update_with_comparison(spark, sf_dir):
    """A SET list whose expressions compare."""
    lake = lake_of(spark, sf_dir, columns=["event_id", "user_id", "event_type"])
    lake.sql("UPDATE events SET user_id = CASE WHEN user_id > 50 THEN 50 ELSE user_id END, event_type = 'capped' WHERE event_id % 3 = 0")
    return lake.sql("SELECT * FROM events")


def lake_join(spark, sf_dir):
    """Several lake tables in one statement, with a CTE, under one snapshot."""
    lake = lake_of(spark, sf_dir)
    for t in ("nation", "region"):
        df = source(spark, sf_dir, t)
        lake.create_table(t, df.schema)
        lake.insert(t, df)
    return lake.sql('WITH b AS (SELECT user_id % 25 AS k, COUNT(*) AS n FROM events GROUP BY 1) SELECT n_name AS "name", r_name, n FROM b JOIN nation ON k = n_nationkey JOIN region ON n_regionkey = r_regionkey')


def imported(kind: str):
    def run(spark, sf_dir):
        lake, df = Lake(spark, scratch(spark)), source(spark, sf_dir).select("event_id", "user_id", "event_type", "value")
        lake.create_table("t", df.select("event_type", "event_id", "user_id").schema)
        folder = f"{scratch(spark)}/{kind}"
        writer = df.write
        {"csv": lambda: writer.option("header", True).csv(folder), "json": lambda: writer.json(folder), "parquet": lambda: writer.parquet(folder)}[kind]()
        lake.import_file("t", folder, kind)
        return lake.table("t")

    return run


def partial_allow(spark, sf_dir):
    """With a file gone and the policy "allow" the rest answers, and is marked."""
    lake = lake_of(spark, sf_dir, parts=2)
    state = lake.log.snapshot()
    lost = min(state.visible("public.events"), key=lambda f: f["stats"]["event_id"]["min"])
    lake.log.files.delete(lost["path"])
    lake.missing = "allow"
    found = lake.read("events")
    assert found.partial
    return found.df


def task_list(spark, sf_dir):
    lake = lake_of(spark, sf_dir, parts=3)
    return spark.createDataFrame([(t["table"], t["shard"], t["files"], t["rows"]) for t in lake.tasks()], "name string, shard string, files bigint, n bigint")


HALF = "(SELECT MAX(event_id) + 1 FROM events)"
ENTRIES: dict[str, tuple] = {
    "flagship": (flagship, FLAGSHIP_SQL),
    "agg_pushdown_global": (agg_pushdown_global, "SELECT COUNT(*) AS n, COUNT(user_id) AS c, CAST(SUM(user_id) AS BIGINT) AS s, MIN(event_type) AS lo, MAX(event_id) AS hi FROM events"),
    "agg_pushdown_grouped": (agg_pushdown_grouped, "SELECT event_type, user_id, COUNT(*) AS n, CAST(SUM(event_id) AS BIGINT) AS s, MIN(event_id) AS lo FROM events GROUP BY event_type, user_id"),
    "agg_pushdown_nullgroup": (agg_pushdown_nullgroup, f"SELECT s, COUNT(*) AS n, COUNT(s) AS c, CAST(SUM(event_id) AS BIGINT) AS total FROM (SELECT event_id, {NULLS} AS s FROM events) GROUP BY s"),
    "agg_pushdown_filtered": (agg_pushdown_filtered, "SELECT event_type, COUNT(*) AS n, MAX(user_id) AS hi FROM events WHERE (event_id >= 200 AND 700 > event_id OR user_id = 7) AND event_type IS NOT NULL GROUP BY event_type"),
    "dv_delete_visible": (dv_delete_visible, "SELECT * FROM events WHERE NOT (event_type = 'view' AND value > 20) AND user_id % 10 <> 3"),
    "delete_null_predicate": (delete_null_predicate, f"SELECT event_id, {NULLS} AS s FROM events WHERE NOT COALESCE({NULLS} <> 'click', FALSE)"),
    "update_where": (update_where, "SELECT event_id, CASE WHEN event_id % 5 = 0 AND user_id < 90 THEN user_id + 1000 ELSE user_id END AS user_id, CASE WHEN event_id % 5 = 0 AND user_id < 90 THEN event_type || '!' ELSE event_type END AS event_type FROM events"),
    "update_twice": (update_twice, "SELECT event_id, CASE WHEN event_id < 100 THEN CASE WHEN event_id % 2 = 0 THEN event_id ELSE -1 END ELSE user_id END AS user_id FROM events"),
    "truncate_then_insert": (truncate_then_insert, "SELECT * FROM events WHERE event_id % 11 = 0"),
    "drop_shard": (drop_shard, "SELECT * FROM events WHERE event_id % 2 = 1"),
    "snapshot_time_travel": (snapshot_time_travel, "SELECT * FROM events"),
    "changes_since": (changes_since, "SELECT COUNT(*) AS n FROM events WHERE event_id < 50"),
    "schema_evolve_add_column": (schema_evolve_add_column, "SELECT event_id, user_id, NULL::VARCHAR AS event_type FROM events UNION ALL SELECT event_id, NULL, event_type FROM events WHERE event_id % 4 = 1"),
    "schema_evolve_widen": (schema_evolve_widen, "SELECT event_id, user_id::DOUBLE AS v FROM events UNION ALL SELECT event_id, (user_id + 3000000000)::DOUBLE FROM events UNION ALL SELECT event_id, user_id / 2 FROM events"),
    "alter_add_drop": (alter_add_drop, "SELECT event_id, event_type, NULL::VARCHAR AS note FROM events UNION ALL SELECT -1, NULL, 'new'"),
    "insert_values_types": (insert_values_types, INSERT_VALUES_SQL),
    "insert_select_cast": (insert_select_cast, "SELECT event_id AS k, user_id::INT AS cost, user_id::VARCHAR AS txt FROM events WHERE event_type = 'click'"),
    "idempotent_replay": (idempotent_replay, "SELECT * FROM events"),
    "minute_window_partition": (minute_window_partition, "SELECT date_trunc('minute', ts) AS w, COUNT(*) AS n FROM events GROUP BY 1"),
    "prune_parity_range": (prune_parity_range, "SELECT event_id, user_id FROM events WHERE event_id >= 100 AND event_id < 150"),
    "prune_parity_eq": (prune_parity_eq, "SELECT event_id, event_type FROM events WHERE event_id = 502"),
    "compaction_parity": (compaction_parity, "SELECT * FROM events WHERE event_id % 13 <> 0"),
    "garbage_parity": (garbage_parity, "SELECT * FROM events WHERE event_id % 17 <> 1"),
    "stream_exactly_once": (stream_exactly_once, "SELECT * FROM events"),
    "tumbling_window": (stream_tumbling_window, "SELECT date_trunc('minute', ts) AS w, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2"),
    "json_get_int": (json_get_int, "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, NULL::VARCHAR AS s, NULL::BIGINT AS missing FROM events"),
    "json_paths": (json_paths, JSON_PATHS_SQL),
    "json_columns": (json_columns, "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, props->>'$.k' AS t, 1::BIGINT AS n, TRUE AS has FROM events"),
    "show_tables": (show_tables, "SELECT 'lake' AS table_catalog, 'public' AS table_schema, t AS table_name FROM (VALUES ('copy'), ('events')) v(t)"),
    "show_columns": (show_columns, "SELECT * FROM (VALUES ('event_id', 'bigint', 'YES'), ('ts', 'timestamp', 'YES'), ('user_id', 'bigint', 'YES'), ('event_type', 'text', 'YES'), ('value', 'double', 'YES'), ('props', 'text', 'YES')) v(\"Field\", \"Type\", \"Null\")"),
    "information_schema": (information_schema, "SELECT 'events' AS table_name, c AS column_name, i AS ordinal_position FROM (VALUES ('event_id', 1), ('ts', 2), ('user_id', 3), ('event_type', 4), ('value', 5), ('props', 6)) v(c, i)"),
    "show_create": (show_create, None),
    "explain_shape": (explain_shape, "SELECT t AS plan_type FROM (VALUES ('logical_plan'), ('physical_plan')) v(t)"),
    "create_like": (create_like, "SELECT * FROM events WHERE event_id < 10"),
    "two_schemas": (two_schemas, "SELECT 100::BIGINT AS a, 900::BIGINT AS b"),
    "prepared": (prepared, "SELECT event_id FROM events WHERE event_type = 'view' AND event_id < 500"),
    "generate_series": (generate_series, "SELECT generate_series AS x FROM generate_series(3, 9)"),
    "series_in_string": (series_in_string, "SELECT event_id, 'generate_series(1, 2)' AS s FROM events"),
    "cte_named_like_table": (cte_named_like_table, "SELECT event_id + 1 AS event_id FROM events WHERE user_id < 50 AND (event_id + 1) % 2 = 0"),
    "prune_nested_field": (prune_nested_field, "SELECT event_id FROM events WHERE event_id >= 100 AND event_id < 500"),
    "update_with_comparison": (update_with_comparison, "SELECT event_id, CASE WHEN event_id % 3 = 0 AND user_id > 50 THEN 50 ELSE user_id END AS user_id, CASE WHEN event_id % 3 = 0 THEN 'capped' ELSE event_type END AS event_type FROM events"),
    "lake_join": (lake_join, "SELECT n_name AS name, r_name, n FROM (SELECT user_id % 25 AS k, COUNT(*) AS n FROM events GROUP BY 1) JOIN nation ON k = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "import_csv": (imported("csv"), "SELECT event_type, event_id, user_id FROM events"),
    "import_json": (imported("json"), "SELECT event_type, event_id, user_id FROM events"),
    "import_parquet": (imported("parquet"), "SELECT event_type, event_id, user_id FROM events"),
    "partial_allow": (partial_allow, f"SELECT * FROM events WHERE event_id * 2 >= {HALF}"),
    "task_list": (task_list, "SELECT 'public.events' AS name, '0' AS shard, 3::BIGINT AS files, COUNT(*) AS n FROM events"),
}


def queries() -> dict:
    return {name: run for name, (run, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql}
