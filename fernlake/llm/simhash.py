"""SimHash fingerprints and near-duplicate groups by meet-in-the-middle ball hashing.

Two fingerprints at most two bits apart have a common variant within one bit of
each.  Every distinct fingerprint emits its variants within one bit (1 + 64); fingerprints that meet at a variant are
checked and linked.  A variant's group can't hold more than the variants of one
fingerprint (65), whatever the number of documents, and all its members lie
within the radius of each other, so linking each to the least one loses no
connection.  Documents enter only through their distinct fingerprint.

Null texts have no words; a text without words has fingerprint zero, which
links like any other.  Repeated rows give repeated rows.  The least doc_id of a
group that has only null ids is null.  A long text is summed in slices.  An
empty table gives no row.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlake.llm.common import groups_by_size, join_split, materialise, rows_of
from fernlake.llm.components import components

SEED = 42
GROUP_BYTES = 1 << 20
SLICE = 1 << 17


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of every shingle, repeats included; fewer words than width are one shingle."""
    words = text.lower().split()  # bytes: A-Z only, and the white space of the contract
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends + 1 - lengths
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]


def fingerprint(hashes: list[int] | np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SLICE):
        bits = np.unpackbits(np.array(hashes[i : i + SLICE], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):  # sums of up to 255 fit a byte
            total += bits[j : j + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_by_size(rows_of(batches, "doc_id", "text"), lambda r: len(r[1] or b"") + 64, GROUP_BYTES):
            found = np.array([fingerprint(shingle_hashes(t or b"", width)) for _, t in group], np.uint64).view(np.int64)
            yield pa.record_batch([pa.array([d for d, _ in group], pa.int64()), pa.array(found)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints that together connect all pairs at most radius (0 or 2) bits apart."""
    if radius not in (0, 2):
        raise ValueError("radius 0 or 2: each side emits the variants within half of it")
    # Each fingerprint becomes 65 rows: dealt out over tasks that are not merged, since the table of fingerprints is small.
    distinct = prints.select("fp").distinct().repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    flips = [0, *((1 << b) - (1 << 64 if b == 63 else 0) for b in range(64))][: 65 if radius else 1]
    variants = distinct.select("fp", F.explode(F.array(*[F.lit(f).cast("long") for f in flips])).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"), "flip")
    # A member of a variant's group is the variant with one bit flipped, or itself: a mask and a flag hold the group.
    met = variants.groupBy("variant").agg(F.bit_or("flip").alias("mask"), F.max(F.col("flip") == 0).alias("own"))
    met = met.where(F.bit_count("mask") + F.col("own").cast("int") > 1)
    members = F.filter(F.transform(F.array(*[F.lit(f).cast("long") for f in flips]), lambda f: F.when(F.when(f == 0, F.col("own")).otherwise(F.col("mask").bitwiseAND(f) != 0), F.col("variant").bitwiseXOR(f))), lambda x: x.isNotNull())
    stars = met.select(members.alias("m")).select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where("a <> b").distinct()
    return stars.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_groups(docs: DataFrame, width: int = 3, radius: int = 2, text: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex), component_id (least doc_id of the group)."""
    prints = materialise(fingerprints(docs, width, text), "fingerprints")
    least = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "least")
    labels = components(links(least, radius))
    grouped = least.join(labels, least.fp == labels.node, "left").select("fp", "least", "n", F.coalesce("label", "fp").alias("label"))
    grouped = materialise(grouped, "groups")
    roots = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    member = materialise(grouped.join(roots, "label").select("fp", "n", "component_id"), "members")
    joined = join_split(prints, member, "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
