"""Exact repeats of fixed-length windows: hashed in tasks, counted by hash in Spark.

A task hashes the windows of some MB of documents at once, and settles repeats
among those itself.  Of each distinct hash it sends on only the first place, in
blobs by hash bucket: a window that stands in a third of all documents reaches
its bucket once per task group, not once per document.  A bucket's reader finds
the places that are not the first of their hash and sends them back, again in
blobs, by document.

A place is (k, c, p): document key, number of the text under that key, offset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlake.llm.common import give_back, materialise, parted

MASK64 = (1 << 64) - 1
#: Multiplier of the rolling hash: odd, 5 modulo 8.
BASE = 0x9E3779B97F4A7C15 & ~7 | 5
GROUP_BYTES = 6 << 20
#: Text bytes for which one bucket is made.
BUCKET_BYTES = 8 << 20
BLOB = "bucket int, repeats boolean, blob binary"
BLOB_SCHEMA = pa.schema([("bucket", pa.int32()), ("repeats", pa.bool_()), ("blob", pa.binary())])


def rolling(units: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of all windows of width units, modulo 2**64, by doubling: sum of u[i+j] B**(width-1-j)."""
    n = len(units) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, size, hashed = BASE, 1, units.astype(np.uint64)
    out, done = None, 0
    left = width
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if out is None:
                    out, done = hashed.copy(), size
                else:  # what is done stands before this block
                    m = len(units) - done - size + 1
                    out = out[:m] * np.uint64(power) + hashed[done : done + m]
                    done += size
            left >>= 1
            if left:
                m = len(units) - 2 * size + 1
                hashed = hashed[:m] * np.uint64(power) + hashed[size : size + m]
                power, size = power * power & MASK64, 2 * size
        out = out[:n]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def firsts(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each hash is the first of its value, and how many the value has, by place."""
    order = np.argsort(hashes, kind="quicksort")
    ordered = hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else np.zeros(0, np.int64)
    first = np.zeros(len(hashes), bool)
    if len(order):
        first[np.minimum.reduceat(order, starts)] = True
    many = np.zeros(len(hashes), bool)
    sizes = np.diff(np.append(starts, len(order)))
    many[order] = np.repeat(sizes > 1, sizes)
    return first, many


# --- blobs -------------------------------------------------------------------


def planes(values: np.ndarray) -> bytes:
    """Differences, byte plane by byte plane, compressed: slowly growing numbers take about a byte each."""
    delta = np.diff(values.astype(np.int64), prepend=0).astype("<i8")
    delta = (delta << 1) ^ (delta >> 63)
    return zlib.compress(np.ascontiguousarray(delta.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unplanes(raw: bytes, n: int) -> np.ndarray:
    delta = np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, n).T).view("<u8").reshape(-1)
    return np.cumsum((delta >> np.uint64(1)).astype(np.int64) ^ -(delta & np.uint64(1)).astype(np.int64))


def pack(k: np.ndarray, c: np.ndarray, p: np.ndarray, h: np.ndarray | None = None) -> bytes:
    parts = [planes(k), planes(c), planes(p), b"" if h is None else h.astype("<u8").tobytes()]
    return np.array([len(k), *map(len, parts)], "<u8").tobytes() + b"".join(parts)


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, *sizes = np.frombuffer(raw, "<u8", 5).tolist()
    at, parts = 40, []
    for size in sizes:
        parts.append(raw[at : at + size])
        at += size
    return *(unplanes(x, n) for x in parts[:3]), np.frombuffer(parts[3], "<u8")


def places_in(raw: bytes) -> int:
    return int(np.frombuffer(raw, "<u8", 1)[0])


def unpack_all(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    found = [unpack(b) for b in blobs]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))


def blob_rows(bucket: np.ndarray, repeats: bool, k: np.ndarray, c: np.ndarray, p: np.ndarray, h: np.ndarray | None = None) -> Iterator[tuple[int, bool, bytes]]:
    if not len(bucket):
        return
    order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 1 << 16 else bucket, kind="stable")
    ordered = bucket[order]
    cuts = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    for at in np.split(order, cuts):
        yield int(bucket[at[0]]), repeats, pack(k[at], c[at], p[at], None if h is None else h[at])


def doc_bucket(k: np.ndarray, c: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (k.astype(np.uint64) + c.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)) * np.uint64(BASE)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def hash_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def batch_of(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), BLOB_SCHEMA, strict=True)], schema=BLOB_SCHEMA)


def bucket_count(docs: DataFrame, text: str = "text") -> int:
    """Grows with the text, so that a bucket's places always fit a task."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(16, min(total // BUCKET_BYTES + 1, 1 << 20))


def not_first(k: np.ndarray, c: np.ndarray, p: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places that come after another place of their hash; equal places (a row given twice) are one."""
    order = np.lexsort((p, c, k, h))
    k, c, p, h = k[order], c[order], p[order], h[order]
    start = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(start, np.arange(len(h)), 0))
    later = (k != k[first]) | (c != c[first]) | (p != p[first])
    out = np.zeros(len(h), bool)
    out[order] = later
    return out


def shared(k: np.ndarray, c: np.ndarray, p: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places whose hash also stands at another place."""
    order = np.lexsort((p, c, k, h))
    hs, ks, cs, ps = h[order], k[order], c[order], p[order]
    start = np.concatenate([[True], hs[1:] != hs[:-1]]) if len(h) else np.zeros(0, bool)
    group = np.cumsum(start) - 1
    differs = np.concatenate([[False], ~start[1:] & ((ks[1:] != ks[:-1]) | (cs[1:] != cs[:-1]) | (ps[1:] != ps[:-1]))]) if len(h) else start
    many = np.zeros(int(group[-1]) + 1 if len(h) else 0, bool)
    many[group[differs]] = True
    out = np.zeros(len(h), bool)
    out[order] = many[group] if len(h) else out
    return out


def settle(blobs: DataFrame, buckets: int, verdict=not_first) -> DataFrame:
    """Blobs of hashed places and of places already settled -> blobs of settled places by document bucket."""

    def run(key, group):
        rows = list(zip(group.column("repeats").to_pylist(), group.column("blob").to_pylist(), strict=True))
        out = []
        k, c, p, _ = unpack_all([b for done, b in rows if done])
        out += blob_rows(doc_bucket(k, c, buckets), True, k, c, p)
        k, c, p, h = unpack_all([b for done, b in rows if not done])
        found = verdict(k, c, p, h)
        k, c, p = k[found], c[found], p[found]
        # In the order of their documents, places take a byte or two each.
        order = np.lexsort((p, c, k))
        k, c, p = k[order], c[order], p[order]
        out += blob_rows(doc_bucket(k, c, buckets), True, k, c, p)
        del rows, k, c, p, h, found, order
        give_back()
        return pa.Table.from_batches([batch_of(out)] if out else [], BLOB_SCHEMA)

    return blobs.groupBy("bucket").applyInArrow(run, BLOB)


def places_by_document(settled: DataFrame) -> DataFrame:
    """(k, c, places): sorted distinct offsets of each document as little-endian 64-bit numbers, packed."""
    schema = pa.schema([("k", pa.int64()), ("c", pa.int32()), ("places", pa.binary())])

    def run(key, group):
        k, c, p, _ = unpack_all(group.column("blob").to_pylist())
        order = np.lexsort((p, c, k))
        k, c, p = k[order], c[order], p[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
        starts = np.flatnonzero(new)
        parts = [planes(np.unique(x)) for x in np.split(p, starts[1:])]
        k, c = k[starts], c[starts].astype(np.int32)
        del p, order, new
        give_back()
        return pa.table([pa.array(k), pa.array(c), pa.array(parts, pa.binary())], schema=schema)

    return settled.groupBy("bucket").applyInArrow(run, "k long, c int, places binary")


def places(raw: bytes | None) -> np.ndarray:
    if raw is None:
        return np.zeros(0, np.int64)
    return unplanes(raw, len(zlib.decompress(raw)) // 8)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n units are covered by windows of width units that begin at starts."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:n]) > 0


def with_places(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs and the columns of found, null where it has no row; only documents that may have one are dealt out."""
    found = materialise(found, "places")
    may, rest = parted(docs, found, "k")
    own = [F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema if f.name not in ("k", "c")]
    return rest.select("*", *own).unionByName(may.join(found, ["k", "c"], "left"))
