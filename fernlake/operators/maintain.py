"""Compaction and garbage collection."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fernlake.errors import Conflict
from fernlake.operators.scan import scan
from fernlake.sources.log import Log
from fernlake.sources.snapshot import Snapshot
from fernlake.sources.write import write_data

TARGET_BYTES = 128 << 20


def compact(spark: SparkSession, log: Log, table: str, shard: str = "0", *, least_files: int = 5, part: float = 0.10, rows: int = 1000) -> bool:
    """Rewrite a shard of many files, or of many deleted rows, without the latter; whether it was done."""
    then = log.snapshot()
    files = then.visible(table, shard)
    gone = sum(v["card"] for f in files for v in then.live_vectors(f["path"]))
    total = sum(f["rows"] for f in files)
    if len(files) < least_files and not (gone >= rows and gone >= part * total):
        return False
    df, _ = scan(spark, then, table, shard=shard)
    wanted = max(1, -(-sum(f["bytes"] for f in files) // TARGET_BYTES))
    order = [c for c in then.table(table)["partition_cols"] if c in df.columns] or [c for c in df.columns if c == "event_time"]
    # Sorted by range, so that the files' statistics tell them apart.
    df = df.repartitionByRange(wanted, *[F.col(f"`{c}`").asc_nulls_first() for c in order]).sortWithinPartitions(*[f"`{c}`" for c in order]) if order else df.coalesce(wanted)
    out, left = write_data(spark, log, then, table, df, shard, uuid.uuid4().hex)
    if left != total - gone:
        raise Conflict(f"compaction read {left} rows of {total - gone}")
    inputs, vectors = {f["path"] for f in files}, {k for k, v in then.vectors.items() if not v["revoked_at"]}

    def build(now: Snapshot) -> list[dict]:
        if not inputs <= {f["path"] for f in now.visible(table, shard)}:
            raise Conflict("an input of the compaction is gone")
        if {k for k, v in now.vectors.items() if not v["revoked_at"] and v["file"] in inputs} - vectors:
            raise Conflict("rows were deleted during the compaction")
        return [*({"op": "remove", "path": p} for p in sorted(inputs)), *({"op": "add", "file": f} for f in out)]

    try:
        log.commit(build)
    except Conflict:
        return False
    return True


def compact_round(spark: SparkSession, log: Log, most: int = 8) -> int:
    """One round over the task list, at most so many merges."""
    done = 0
    for task in log.snapshot().tasks()[:most]:
        done += compact(spark, log, task["table"], task["shard"])
    return done


def collect_garbage(spark: SparkSession, log: Log, grace_seconds: float = 3600.0) -> list[str]:
    """Delete data files that no version in reach names, and tombstoned ones, once they are older than the grace time.

    A file that is not in the manifest but young may belong to a commit under way.
    """
    state = log.snapshot()
    live = {p for p, f in state.files.items() if not f["deleted_at"]}
    folders = {v["path"] for v in state.live_vectors()}
    strip = lambda p: p.split(":", 1)[-1].lstrip("/")  # noqa: E731  file:/x and file:///x are one file
    kept, kept_folders = {strip(p) for p in live}, {strip(p) for p in folders}
    before = (time.time() - grace_seconds) * 1000
    gone = []
    for path, _, changed in log.files.list(log.root):
        bare = strip(path)
        if "/_log/" in path or changed > before or bare in kept or any(bare.startswith(f + "/") for f in kept_folders):
            continue
        log.files.delete(path)
        gone.append(path)
    names = {strip(p) for p in gone}
    dead = [p for p, f in state.files.items() if f["deleted_at"] and strip(p) in names]
    if dead:
        log.commit(lambda now: [{"op": "purge", "paths": [p for p in dead if p in now.files]}])
    return gone
