"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, all of them.

Candidates come from two sides.  SimHash fingerprints of the sets that lie
within two bits of each other meet by ball hashing (`simhash`).  Two sets of
similarity 0.8 often differ in more bits than any ball can hold, so the others
come from prefix filtering: sets as similar as that share a shingle among the
first n - ceil(0.8 n) + 1 of each, whatever the order, as long as it is the same
for both.  Shingles are ordered by the number of sets that hold them, then by
hash.  So a set's own shingles, which meet nothing, come first, and documents
that only share a passage seldom meet.  The numbers are counted over all sets, in
blobs dealt out by hash; only shingles of two sets or more are sent back.  Sets
that are equal count as one.

A candidate pair is first held against the sets' parity bitmaps, of about a bit
a shingle: two bitmaps differ in no more bits than the sets have elements that
are not shared, so no similar pair is lost.  Only pairs that pass are compared
exactly, shingle by shingle, and those alike are linked.

Up to SMALL documents that meet at a shingle are all compared.  More are first
compared with NEAR neighbours and NEAR leaders; then those of them that are not
connected yet are compared too, by their bitmaps, a block of BLOCK documents with
another at a time, and only pairs that pass become rows.  So no pair is left out,
and copies of one document, however many, cost no square.

Words and their folding are those of simhash; a text of fewer words is one
shingle.  Shingles are held as 64-bit hashes.  Texts without words are copies
of each other.  doc_ids are unique and not null; an empty table gives no row;
a long text is one row of its batch; columns other than doc_id and text are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlake.llm import simhash
from fernlake.llm.common import groups_by_size, materialise, parted, rows_of, without_keys
from fernlake.llm.components import components
from fernlake.llm.windows import BLOB, BLOB_SCHEMA, batch_of, blob_rows, bucket_count, doc_bucket, hash_bucket, rolling, unpack_all

WIDTH = 5
GROUP_BYTES = 4 << 20
SMALL = 32
NEAR = 4
BLOCK = 4096


def shingle_set(text: bytes | None) -> np.ndarray:
    """Distinct hashed shingles, sorted."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(rolling(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), min(WIDTH, len(words))))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is 0.8 or more."""
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * shared >= 4 * (len(x) + len(y) - shared)


def bitmap(shingles: np.ndarray) -> bytes:
    """For each of a power of two of bits, at least the set's size, whether an odd number of its shingles falls on it."""
    bits = max(64, 1 << (len(shingles) - 1).bit_length()) if len(shingles) else 64
    at = (shingles & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    """In how many bits two bitmaps differ; the longer is folded, which keeps it a bitmap of its set."""
    a, b = (np.frombuffer(v, "<u8") for v in (x, y))
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def sets_of(docs: DataFrame) -> DataFrame:
    """doc_id and its shingles, packed."""
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_by_size(rows_of(batches, "doc_id", "text"), lambda r: len(r[1] or b"") + 64, GROUP_BYTES):
            yield pa.record_batch([pa.array([d for d, _ in group], pa.int64()), pa.array([shingle_set(t).tobytes() for _, t in group], pa.binary())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles binary")


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id; digest, size, fingerprint and bitmap of its set."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("fp", pa.int64()), ("bits", pa.binary())])

    def one(doc_id: int, text: bytes | None) -> tuple:
        s = shingle_set(text)
        return doc_id, xxhash.xxh3_128_digest(s.tobytes()), len(s), int(np.uint64(simhash.fingerprint(s)).view(np.int64)), bitmap(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_by_size(rows_of(batches, "doc_id", "text"), lambda r: len(r[1] or b"") + 64, GROUP_BYTES):
            columns = zip(*(one(d, t) for d, t in group), strict=True)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, n long, fp long, bits binary")


def dealt(docs: DataFrame, buckets: int) -> DataFrame:
    """Blobs of (document, 0, size of its set, shingle), all shingles of all documents, by bucket of the shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_by_size(rows_of(batches, "doc_id", "text"), lambda r: len(r[1] or b"") + 64, GROUP_BYTES):
            group = sorted(group, key=lambda r: r[0])
            sets = [shingle_set(t) for _, t in group]
            sizes = np.array([len(s) for s in sets], np.int64)
            k, n, h = np.repeat(np.array([d for d, _ in group], np.int64), sizes), np.repeat(sizes, sizes), np.concatenate(sets)
            del sets
            for part in groups_by_size(blob_rows(hash_bucket(h, buckets), False, k, np.zeros(len(k), np.int64), n, h), lambda r: len(r[2]), 1 << 20):
                yield batch_of(part)

    return docs.select("doc_id", "text").mapInArrow(run, BLOB)


def counted(blobs: DataFrame, buckets: int) -> DataFrame:
    """Blobs of (document, sets that hold the shingle, size of its set, shingle) by document, of shingles of two sets or more."""

    def run(key, group):
        k, _, n, h = unpack_all(group.column("blob").to_pylist())
        order = np.argsort(h, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]])) if len(h) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(h)))
        held = np.zeros(len(h), np.int64)
        held[order] = np.repeat(sizes, sizes)
        order = np.flatnonzero(held > 1)
        order = order[np.argsort(k[order], kind="stable")]
        k, held, n, h = k[order], held[order], n[order], h[order]
        out = list(blob_rows(doc_bucket(k, np.zeros(len(k), np.int64), buckets), True, k, held, n, h))
        return pa.Table.from_batches([batch_of(out)] if out else [], BLOB_SCHEMA)

    return blobs.groupBy("bucket").applyInArrow(run, BLOB)


def prefixes(blobs: DataFrame, buckets: int) -> DataFrame:
    """Blobs of (document, 0, size of its set, shingle of its prefix) by bucket of the shingle."""

    def run(key, group):
        k, held, n, h = unpack_all(group.column("blob").to_pylist())
        order = np.lexsort((h, held, k))
        k, n, h = k[order], n[order], h[order]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(k)))
        # The set's other shingles, which no other set holds, come first in its prefix.
        own = n - np.repeat(sizes, sizes)
        place = own + np.arange(len(k)) - np.repeat(starts, sizes)
        first = place < n - (4 * n + 4) // 5 + 1
        k, n, h = k[first], n[first], h[first]
        out = list(blob_rows(hash_bucket(h, buckets), False, k, np.zeros(len(k), np.int64), n, h))
        return pa.Table.from_batches([batch_of(out)] if out else [], BLOB_SCHEMA)

    return blobs.groupBy("bucket").applyInArrow(run, BLOB)


def pairs_of(k: np.ndarray, n: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs to compare (two arrays of documents), and which places belong to more than SMALL documents; places are sorted by shingle, then document."""
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(h)))
    size, first, end = (np.repeat(x, sizes) for x in (sizes, starts, starts + sizes))
    many = size > SMALL
    place = np.arange(len(h))
    left, right = [place[:0]], [place[:0]]
    for step in range(1, SMALL):
        at = place[(place + step < end) & (~many | (step <= NEAR))]
        left.append(at)
        right.append(at + step)
    for leader in range(NEAR):
        at = place[many & (place > first + leader)]
        left.append(first[at] + leader)
        right.append(at)
    a, b = np.concatenate(left), np.concatenate(right)
    fits = 5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b])
    pairs = np.unique(np.stack([k[a[fits]], k[b[fits]]]), axis=1)
    return pairs[0], pairs[1], many


def meetings(blobs: DataFrame) -> DataFrame:
    """Pairs (a, b), shingle null; and where more than SMALL documents meet, (document, size of its set, shingle)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shingle", pa.int64())])

    def run(key, group):
        k, _, n, h = unpack_all(group.column("blob").to_pylist())
        order = np.lexsort((k, h))
        k, n, h = k[order], n[order], h[order]
        a, b, many = pairs_of(k, n, h)
        shingle = pa.array(np.concatenate([np.zeros(len(a), np.int64), h[many].view(np.int64)]), mask=np.arange(len(a) + many.sum()) < len(a))
        return pa.table([pa.array(np.concatenate([a, k[many]])), pa.array(np.concatenate([b, n[many]])), shingle], schema=schema)

    return blobs.groupBy("bucket").applyInArrow(run, "a long, b long, shingle long")


def near_fingerprints(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents whose fingerprints are equal or within two bits, by way of the least document of each fingerprint."""
    least = materialise(distinct.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    own = distinct.select("fp", "doc_id").join(least, "fp").where("doc_id <> least").select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
    x, y = (least.select(F.col("fp").alias(c), F.col("least").alias(f"least_{c}")) for c in "ab")
    other = simhash.links(least).join(x, "a").join(y, "b").select(F.least("least_a", "least_b").alias("a"), F.greatest("least_a", "least_b").alias("b"))
    return own.union(other)


def may_be_similar(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """The pairs that their bitmaps don't rule out."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Of two similar sets at most a ninth of all elements are not shared.
            keep = [9 * bits_apart(x, y) <= n for x, y, n in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(keep, pa.bool_()))

    x, y = (distinct.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    held = pairs.join(x, "a").join(y, "b").where("5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)")
    return held.select("a", "b", "bits_a", "bits_b", (F.col("n_a") + F.col("n_b")).alias("n")).mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose sets are similar: those their bitmaps leave, compared exactly."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    left = materialise(may_be_similar(pairs, distinct), "left")
    need = materialise(left.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "need")
    sets = materialise(sets_of(parted(docs, need, "doc_id")[0].join(need, "doc_id", "left_semi")), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(s.as_buffer(), np.uint64) for s in batch.column(i)] for i in (2, 3))
            yield pa.record_batch([batch.column(0), batch.column(1)], schema=schema).filter(pa.array([similar(*p) for p in zip(x, y, strict=True)], pa.bool_()))

    held = left.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    return materialise(held.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "similar")


def folded(bits: bytes, words: int) -> np.ndarray:
    """A bitmap folded to at most so many 64-bit words."""
    a = np.frombuffer(bits, "<u8")
    while len(a) > words:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a


def passing(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) of documents of x and of y, each (ids, sizes, labels, bitmaps), that have different labels and may be similar."""
    (xi, xn, xl, xb), (yi, yn, yl, yb) = x, y
    found = [np.zeros((2, 0), np.int64)]
    for i in range(0, len(xi), 32):
        s = slice(i, i + 32)
        apart = np.bitwise_count(xb[s, None, :] ^ yb[None, :, :]).sum(axis=2, dtype=np.int64)
        low, high = np.minimum(xn[s, None], yn[None, :]), np.maximum(xn[s, None], yn[None, :])
        at, bt = np.nonzero((9 * apart <= low + high) & (5 * low >= 4 * high) & (xl[s, None] != yl[None, :]))
        found.append(np.stack([np.minimum(xi[s][at], yi[bt]), np.maximum(xi[s][at], yi[bt])]))
    return tuple(np.unique(np.concatenate(found, axis=1), axis=1))


def unconnected(own: DataFrame, distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of the documents (shingle, doc_id, n, label) of one shingle that have different labels and may be similar."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    blocks = own.groupBy("shingle").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    rows = own.join(distinct.select("doc_id", "bits"), "doc_id").join(blocks, "shingle").withColumn("own", F.pmod(F.xxhash64("doc_id"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("shingle", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "doc_id", "n", "label", "bits")

    def run(key, group):
        low, high = key[1].as_py(), key[2].as_py()
        own, ids, n, label = (group.column(c).to_numpy() for c in ("own", "doc_id", "n", "label"))
        maps = [folded(b, 16) for b in group.column("bits").to_pylist()]
        words = np.array([len(m) for m in maps])

        def side(block: int, size: int, to: int) -> tuple[np.ndarray, ...]:
            at = np.flatnonzero((own == block) & (words == size))
            return ids[at], n[at], label[at], np.array([folded(maps[i].tobytes(), to) for i in at], np.uint64).reshape(len(at), to)

        pairs = [np.zeros((2, 0), np.int64)]
        # Similar sets differ little in size, so their bitmaps by a factor of two at most.
        for small in np.unique(words).tolist():
            for x, y in {(low, high), (high, low)}:
                pairs += [np.stack(passing(side(x, small, small), side(y, size, small))) for size in (small, 2 * small)]
        a, b = np.unique(np.concatenate(pairs, axis=1), axis=1)
        return pa.table([pa.array(a), pa.array(b)], schema=schema)

    return rows.groupBy("shingle", "low", "high").applyInArrow(run, "a long, b long").distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id and component_id, the least doc_id of those connected by similar pairs; doc_ids are unique and not null."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialise(sketches(docs), "sketches")
    firsts = materialise(found.groupBy("digest").agg(F.min("doc_id").alias("first")), "firsts")
    copies = materialise(found.select("doc_id", "digest").join(firsts, "digest").where("doc_id <> first").select("doc_id"), "copies")
    distinct = materialise(without_keys(found.select("doc_id", "n", "fp", "bits"), copies, "doc_id"), "distinct")
    buckets = bucket_count(docs)
    shared = counted(dealt(without_keys(docs, copies, "doc_id"), buckets), buckets)
    met = materialise(meetings(prefixes(shared, buckets)), "meetings")
    pairs = materialise(met.where("shingle is null").select("a", "b").union(near_fingerprints(distinct)).distinct(), "pairs")
    links = verified(pairs, distinct, docs)
    labels = components(links)
    many = met.where("shingle is not null").select("shingle", F.col("a").alias("doc_id"), F.col("b").alias("n"))
    if not many.isEmpty():
        own = many.join(labels, many.doc_id == labels.node, "left").select("shingle", "doc_id", "n", F.coalesce("label", "doc_id").alias("label"))
        apart = own.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("shingle")
        own = materialise(own.join(apart, "shingle", "left_semi"), "apart")
        rest = unconnected(own, distinct)
        rest = materialise(rest.join(pairs, ["a", "b"], "left_anti"), "rest")
        if not rest.isEmpty():
            labels = components(links.union(verified(rest, distinct, docs)))
    grouped = firsts.join(labels, firsts["first"] == labels.node, "left").select("digest", F.coalesce("label", "first").alias("component_id"))
    return found.select("doc_id", "digest").join(grouped, "digest").select("doc_id", "component_id")
