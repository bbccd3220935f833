"""Appending to a table: schema evolution, keys, minute windows, statistics, Parquet, commit."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernlake.errors import Conflict, Incompatible
from fernlake.functions.types import wider
from fernlake.operators.scan import aligned, as_nullable
from fernlake.plans.prune import stored
from fernlake.sources.log import Log
from fernlake.sources.snapshot import Snapshot

ROW_GROUP = 65_536
LONGEST_KEY = 256


@dataclass
class Receipt:
    batch_id: str
    rows: int
    version: int
    duplicate: bool = False


def part_key(base: str, i: int) -> str:
    """The key of one batch of a keyed series; the base is cut so that all of it fits."""
    tail = f"#{i}"
    return base[: LONGEST_KEY - len(tail)] + tail


def evolution(own: T.StructType, new: T.StructType) -> tuple[T.StructType, str] | None:
    """One step that takes the table's schema towards a batch's: a column added, or widened; None if it fits."""
    have = {f.name.lower(): f for f in own}
    for f in new:
        held = have.get(f.name.lower())
        if held is None:
            return T.StructType([*own, T.StructField(f.name, f.dataType, True)]), f"add {f.name}"
        if as_nullable(T.StructType([T.StructField("c", held.dataType)])) == as_nullable(T.StructType([T.StructField("c", f.dataType)])):
            continue
        if not wider(held.dataType, f.dataType):
            raise Incompatible(f"column {f.name} is {held.dataType.simpleString()} and cannot take {f.dataType.simpleString()}")
        return T.StructType([T.StructField(x.name, f.dataType if x.name == held.name else x.dataType, x.nullable, x.metadata) for x in own]), f"widen {held.name}"
    return None


def evolve_to(log: Log, table: str, new: T.StructType, retries: int = 32) -> Snapshot:
    """Evolve step by step, each against the schema version it was made for, until the batch fits."""
    for attempt in range(retries):
        state = log.snapshot()
        step = evolution(state.schema_of(table), new)
        if step is None:
            return state
        expected = state.table(table)["schema_version"]

        def build(now: Snapshot, step=step, expected=expected) -> list[dict]:
            return [{"op": "evolve", "table": table, "expected": expected, "schema": step[0].json(), "change": step[1]}]

        try:
            log.commit(build)
        except Conflict:
            time.sleep(min(0.001 * 2**attempt, 0.05))
    raise Conflict(f"the schema of {table} keeps changing")


def stat_columns(snapshot: Snapshot, table: str) -> list[str]:
    schema = snapshot.schema_of(table)
    names = snapshot.table(table)["partition_cols"] or [f.name for f in schema if f.name == "event_time"]
    return [f.name for f in schema if f.name in names and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]


def window_of(value, arrived: float) -> str:
    """The minute a batch belongs to: that of its least timestamp, else of its arrival."""
    if hasattr(value, "strftime") and hasattr(value, "hour"):
        return value.strftime("%Y-%m-%dT%H:%M")
    if isinstance(value, int) and not isinstance(value, bool):  # epoch milliseconds
        arrived = value / 1000
    return time.strftime("%Y-%m-%dT%H:%M", time.gmtime(arrived))


def write_data(spark: SparkSession, log: Log, snapshot: Snapshot, table: str, df: DataFrame, shard: str, batch_id: str, files: int | None = None) -> tuple[list[dict], int]:
    """Write a batch's Parquet files and describe them; nothing sees them before the commit."""
    schema = snapshot.schema_of(table)
    rows = aligned(df, schema)
    if files:
        rows = rows.coalesce(files)
    required = [f.name for f in schema if not f.nullable]
    target = f"{log.root}/{table.replace('.', '/')}/shard={shard}/{batch_id}"
    columns = stat_columns(snapshot, table)
    writer = rows.write.mode("error").option("compression", "zstd").option("parquet.block.row.count.limit", ROW_GROUP)
    for c in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(target)
    there = {p: n for p, n, _ in log.files.list(target) if p.endswith(".parquet")}
    back = spark.read.schema(as_nullable(schema)).parquet(target)
    # One narrow pass: statistics per file, and nulls where none may be.
    exprs = [F.count("*").alias("rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"missing_{i}") for i, c in enumerate(required)]]
    for i, c in enumerate(columns):
        exprs += [F.min(f"`{c}`").alias(f"min_{i}"), F.max(f"`{c}`").alias(f"max_{i}"), F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{i}")]
    found = back.groupBy(F.col("_metadata.file_path").alias("path")).agg(*exprs).collect()
    for i, c in enumerate(required):
        if any(r[f"missing_{i}"] for r in found):
            log.files.delete(target)
            raise Incompatible(f"column {c} cannot be null")
    out, now = [], time.time()
    firsts = [r["min_0"] for r in found if columns and r["min_0"] is not None]
    window = window_of(min(firsts) if firsts else None, now)
    sizes = {p.split(":", 1)[-1].lstrip("/"): n for p, n in there.items()}
    for r in found:
        stats = {c: {"min": stored(r[f"min_{i}"]), "max": stored(r[f"max_{i}"]), "nulls": r[f"null_{i}"]} for i, c in enumerate(columns)}
        out.append({"path": r["path"], "table": table, "batch_id": batch_id, "schema_version": snapshot.table(table)["schema_version"], "shard": shard, "time_window": window, "rows": r["rows"], "bytes": sizes.get(r["path"].split(":", 1)[-1].lstrip("/"), 0), "stats": stats})
    return out, sum(r["rows"] for r in found)


def append(spark: SparkSession, log: Log, table: str, df: DataFrame, *, key: str | None = None, shard: str = "0", evolve: bool = True, also: list[dict] | None = None) -> Receipt:
    """Add a batch in one commit; a key that was used makes it a duplicate of no rows."""
    state = log.snapshot()
    if state.table(table)["require_key"] and not key:
        raise Incompatible(f"table {table} needs an idempotency key")
    if key and len(key) > LONGEST_KEY:
        raise Incompatible(f"a key has at most {LONGEST_KEY} characters")
    if key and state.has_key(key):
        return Receipt(state.keys[key]["batch_id"], 0, state.version, duplicate=True)
    if evolve:
        state = evolve_to(log, table, df.schema)
    else:
        _no_wider(state.schema_of(table), df.schema)
    batch_id = uuid.uuid4().hex
    files, rows = write_data(spark, log, state, table, df, shard, batch_id)
    twice = None

    def build(now: Snapshot) -> list[dict]:
        nonlocal twice
        if key and now.has_key(key):
            twice = now.keys[key]["batch_id"]
            return []
        now.table(table)
        keyed = [{"op": "key", "key": key, "batch_id": batch_id, "at": time.time()}] if key else []
        return [*keyed, *({"op": "add", "file": f} for f in files), *(also or [])]

    after = log.commit(build)
    if twice:  # our files are orphans now, for the garbage collector
        return Receipt(twice, 0, after.version, duplicate=True)
    return Receipt(batch_id, rows, after.version)


def _no_wider(own: T.StructType, new: T.StructType) -> None:
    step = evolution(own, new)
    if step is not None:
        raise Incompatible(f"the batch would change the schema: {step[1]}")


def read_import(spark: SparkSession, path: str, kind: str, schema: T.StructType) -> DataFrame:
    """A CSV, JSON lines or Parquet file aligned by name; a column that is missing is an error, others are ignored."""
    if kind == "csv":
        df = spark.read.option("header", True).csv(path)
    elif kind in ("json", "jsonl"):
        df = spark.read.schema(as_nullable(schema)).json(path)
        there = {c.lower() for c in spark.read.json(path).columns}
        missing = [f.name for f in schema if f.name.lower() not in there]
        if missing:
            raise Incompatible(f"columns missing in {path}: {', '.join(missing)}")
    elif kind == "parquet":
        df = spark.read.parquet(path)
    else:
        raise Incompatible(f"{kind} files cannot be imported")
    missing = [f.name for f in schema if f.name.lower() not in {c.lower() for c in df.columns}]
    if missing:
        raise Incompatible(f"columns missing in {path}: {', '.join(missing)}")
    return aligned(df, schema)


def schema_json(schema: T.StructType) -> str:
    return json.dumps(schema.jsonValue())
