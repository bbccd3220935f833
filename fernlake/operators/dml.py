"""DELETE, UPDATE, TRUNCATE: located on one snapshot, committed only if that is still what the files are."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlake.errors import Conflict, Incompatible, SyntaxRefused
from fernlake.operators.scan import FILE, ROW, scan
from fernlake.sources.log import Log
from fernlake.sources.snapshot import Snapshot
from fernlake.sources.write import write_data


def _vectors(spark: SparkSession, log: Log, found: DataFrame, table: str) -> list[dict]:
    """Write the positions and describe them, one vector per file; the rows stay on the executors."""
    vector_id = uuid.uuid4().hex
    path = f"{log.root}/{table.replace('.', '/')}/_deleted/{vector_id}"
    found.select(F.col(FILE).alias("file"), F.col(ROW).alias("row")).write.option("compression", "zstd").parquet(path)
    counts = spark.read.schema("file string, row long").parquet(path).groupBy("file").count().collect()
    if not counts:
        log.files.delete(path)
    return [{"id": vector_id, "file": r["file"], "path": path, "card": r["count"]} for r in counts]


def _unchanged(now: Snapshot, then: Snapshot, table: str) -> None:
    """What was located must still hold: a file or deletion that came between means doing it over."""
    before = {f["path"] for f in then.visible(table)}
    if {f["path"] for f in now.visible(table)} != before:
        raise Conflict(f"{table} changed during the statement")
    files = before
    if {k for k, v in now.vectors.items() if v["file"] in files and not v["revoked_at"]} != {k for k, v in then.vectors.items() if v["file"] in files and not v["revoked_at"]}:
        raise Conflict(f"rows of {table} were deleted during the statement")
    if now.table(table)["schema_version"] != then.table(table)["schema_version"]:
        raise Conflict(f"the schema of {table} changed during the statement")


def _repeat(statement, attempts: int = 8):
    for attempt in range(attempts):
        try:
            return statement()
        except Conflict:
            if attempt == attempts - 1:
                raise


def delete(spark: SparkSession, log: Log, table: str, where: str | None, *, pruning: bool = True) -> int:
    """Delete the rows for which where is true; how many there were."""
    if where is None:
        return truncate(spark, log, table)

    def once() -> int:
        then = log.snapshot()
        found, _ = scan(spark, then, table, where, pruning=pruning, positions=True)
        vectors = _vectors(spark, log, found, table)
        if not vectors:
            return 0

        def build(now: Snapshot) -> list[dict]:
            _unchanged(now, then, table)
            return [{"op": "vector", "vector": v} for v in vectors]

        log.commit(build)
        return sum(v["card"] for v in vectors)

    return _repeat(once)


def update(spark: SparkSession, log: Log, table: str, assignments: list[tuple[str, str]], where: str | None, *, shard: str = "0", pruning: bool = True) -> int:
    """Set columns of the rows for which where is true: old rows and new file change in one commit."""
    if where is None:
        raise SyntaxRefused("UPDATE needs a WHERE clause")
    names = [c.lower() for c, _ in assignments]
    if len(set(names)) < len(names):
        raise SyntaxRefused("a column is set twice")

    def once() -> int:
        then = log.snapshot()
        schema = then.schema_of(table)
        own = {f.name.lower(): f for f in schema}
        unknown = [c for c in names if c not in own]
        if unknown:
            raise Incompatible(f"unknown column {unknown[0]}")
        found, _ = scan(spark, then, table, where, pruning=pruning, positions=True)
        vectors = _vectors(spark, log, found, table)
        if not vectors:
            return 0
        put = {own[c].name: F.expr(e).cast(own[c].dataType) for c, (_, e) in zip(names, assignments, strict=True)}
        # All right sides see the old row.
        fresh = found.select(*[put[f.name].alias(f.name) if f.name in put else F.col(f"`{f.name}`") for f in schema])
        batch_id = uuid.uuid4().hex
        files, rows = write_data(spark, log, then, table, fresh, shard, batch_id)
        gone = sum(v["card"] for v in vectors)
        if rows != gone:
            raise Conflict(f"{gone} rows were located but {rows} written")

        def build(now: Snapshot) -> list[dict]:
            _unchanged(now, then, table)
            return [*({"op": "vector", "vector": v} for v in vectors), *({"op": "add", "file": f} for f in files)]

        log.commit(build)
        return gone

    return _repeat(once)


def truncate(spark: SparkSession, log: Log, table: str, shard: str | None = None) -> int:
    """Delete all files of a table, or of a shard; the rows that were still visible in them."""
    gone = 0

    def build(now: Snapshot) -> list[dict]:
        nonlocal gone
        now.table(table)
        files = now.visible(table, shard)
        deleted = {f["path"]: sum(v["card"] for v in now.live_vectors(f["path"])) for f in files}
        gone = sum(f["rows"] - deleted[f["path"]] for f in files)
        return [{"op": "remove", "path": f["path"]} for f in files]

    log.commit(build)
    return gone
