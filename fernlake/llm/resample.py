"""Quality classifier by importance resampling over hashed n-grams.

Two generative models of hashed unigrams and bigrams - of the target text
(labelled rows of good quality that are not toxic) and of the raw text (all
documents) - give every document an importance weight: the product, over its
n-grams, of their ratio.  Documents are then drawn without replacement in
proportion to their weights by Gumbel top-k: to each log-weight a Gumbel
variate is added, and the k largest are selected.

How the ratio is kept robust: the models are over the presence of an n-gram in
a document, so that one text of a thousand times the same word says no more
than one of it; every n-gram has a bucket in each of two tables, and of its two
ratios the one closer to one counts, so it must share both buckets with bad
n-grams to look bad.  Counts are smoothed; ratios that are not clearly below
one (MARGIN, and DEVIATIONS of the expected count) count as one, so a weight is
the chance to keep a document in rejection sampling.  k is the number of
documents which that would keep, the sum of the weights.  Log-weights are
integers (thousandths), hence the same at any order of work; they are divided
by a temperature before the draw, at which ordinary documents tie and the
variates decide among borderline ones only.

Only the labelled rows that fit the target are a bounded sample: at most
`most_labelled`, those of the least hash of doc_id.  Raw counts, weights and the
draw cover all documents.  Null and empty texts have no n-gram and weight one.
A label's nulls count as not good.  Rows that repeat a doc_id draw alike where
the text is the same.  Without labelled rows of the target all weights are one.
An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlake.llm.common import groups_by_size, materialise, rows_of

#: Buckets a table: few n-grams share one, so a bad one need not outweigh ordinary ones in its bucket.
BITS = 20
BUCKETS = 1 << BITS
SMOOTHING = 3.0
MARGIN = 1.0
DEVIATIONS = 3.0
TEMPERATURE = 0.05
MOST_LABELLED = 50_000
SEED = 42
GROUP_BYTES = 2 << 20
#: Buckets whose counts are sent together, packed.
CHUNK = 1 << 13
TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff \t\n\x0b\f\r]+")
COUNTS = "chunk int, counts binary"
COUNTS_SCHEMA = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())])
FACTOR, MIXER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Stands for any token that repeats the one before it.
REPEAT = np.uint64(0x5851F42D4C957F2D)


def ngrams(text: bytes) -> np.ndarray:
    """Distinct hashed unigrams and bigrams of a text."""
    tokens = TOKEN.findall(text)
    units = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    with np.errstate(over="ignore"):
        pairs = (units[:-1] * FACTOR ^ (units[1:] >> np.uint64(7)) + units[1:]) * MIXER
    pairs[units[1:] == units[:-1]] = REPEAT
    return np.unique(np.concatenate([units, pairs]))


def buckets(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram in the first and in the second table; the second follows the first."""
    first = (found >> np.uint64(64 - BITS)).astype(np.int64)
    second = (found >> np.uint64(20) & np.uint64(BUCKETS - 1)).astype(np.int64) + BUCKETS
    return first, second


def sample_of_target(labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id of at most `most` labelled rows of the target."""
    good = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("label_id")).distinct()
    return good.orderBy(F.xxhash64("label_id"), "label_id").limit(most)


def packed(counts: np.ndarray) -> bytes:
    """Counts of a chunk, byte plane by byte plane, compressed."""
    return zlib.compress(np.ascontiguousarray(counts.astype("<i8").reshape(-1).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1).T).view("<i8").reshape(2, -1)


def count_ngrams(docs: DataFrame, target: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket over the target and over all documents; what is sent and collected is bounded by the buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2 * BUCKETS), np.int64)
        for group in groups_by_size(rows_of(batches, "good", "text"), lambda r: len(r[1] or b"") + 64, GROUP_BYTES):
            for kind in (True, False):
                found = [ngrams(t or b"") for good, t in group if bool(good) is kind]
                if found:
                    used, seen = np.unique(np.concatenate(buckets(np.concatenate(found))), return_counts=True)
                    total[1][used] += seen
                    total[0][used] += seen * kind
        chunks = [i for i in range(0, 2 * BUCKETS, CHUNK) if total[1, i : i + CHUNK].any()]
        yield pa.record_batch([pa.array(chunks, pa.int32()), pa.array([packed(total[:, i : i + CHUNK]) for i in chunks], pa.binary())], schema=COUNTS_SCHEMA)

    def add(key, group):
        rows = group.column("counts").to_pylist()
        total = np.zeros((2, CHUNK), np.int64)
        for r in rows:
            total += unpacked(r)
        return pa.table([group.column("chunk")[:1], pa.array([packed(total)], pa.binary())], schema=COUNTS_SCHEMA)

    marked = docs.join(F.broadcast(target.withColumn("good", F.lit(True))), docs.doc_id == target.label_id, "left").select("good", "text")
    counts = marked.mapInArrow(run, COUNTS).groupBy("chunk").applyInArrow(add, COUNTS)
    out = np.zeros((2, 2 * BUCKETS), np.int64)
    for r in counts.toLocalIterator():
        out[:, r["chunk"] : r["chunk"] + CHUNK] = unpacked(r["counts"])
    return out[0], out[1]


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log-ratio of target and raw model by bucket in thousandths: at most 0, and 0 within the margin."""
    if not target.sum():
        return np.zeros(2 * BUCKETS, np.int64)
    expected = raw * (target.sum() / raw.sum())
    ratio = np.log((target + SMOOTHING) / (expected + SMOOTHING))
    clear = (ratio <= -MARGIN) & (expected - target >= DEVIATIONS * np.sqrt(expected))
    return np.where(clear, np.round(1000 * ratio), 0).astype(np.int64)


def weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, row_key, lw (log-weight in thousandths), tie (a hash of doc_id and text)."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "row_key", "lw", "tie")])
    shared = docs.sparkSession.sparkContext.broadcast(ratios.astype("<i4").tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, "<i4")
        for group in groups_by_size(rows_of(batches, "doc_id", "row_key", "text"), lambda r: len(r[2] or b"") + 64, GROUP_BYTES):
            texts = [t or b"" for _, _, t in group]
            found = [ngrams(t) for t in texts]
            first, second = buckets(np.concatenate(found))
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            lw = np.bincount(owner, np.maximum(table[first], table[second]), len(group)).astype(np.int64)
            tie = np.array([xxhash.xxh3_64_intdigest(t, (d or 0) + SEED & (1 << 64) - 1) for (d, _, _), t in zip(group, texts, strict=True)], np.uint64).view(np.int64)
            yield pa.record_batch([pa.array([d for d, _, _ in group], pa.int64()), pa.array([k for _, k, _ in group], pa.int64()), pa.array(lw), pa.array(tie)], schema=schema)

    return docs.select("doc_id", "row_key", "text").mapInArrow(run, "doc_id long, row_key long, lw long, tie long")


def gumbel_key(temperature: float) -> F.Column:
    """Log-weight over temperature plus a Gumbel variate made of the tie hash, in millionths."""
    uniform = (F.shiftrightunsigned("tie", 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return F.round((F.col("lw") / (1000.0 * temperature) - F.log(-F.log(uniform))) * 1e6).cast("long")


def top_k(keys: DataFrame, k: int) -> DataFrame:
    """Marks the k rows of the largest (key, tie); rows equal in both to the last of them are taken too.

    The k-th is narrowed down by counting bins, 4096 a round, first of the keys
    and then of the ties at its key: no sort, and no more than the bins on the driver.
    """
    if k <= 0:
        return keys.withColumn("selected", F.lit(False))
    rest, key, tie = k, None, None
    for column, rows, low, high in (("key", keys, -(2**62), 2**62), ("tie", None, -(2**63), 2**63)):
        rows = keys.where(F.col("key") == key) if rows is None else rows
        while high - low > 1:
            step = -((low - high) // 4096)
            bins = rows.where(F.col(column).between(low, high - 1)).groupBy(F.floor((F.col(column).cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(step).cast("decimal(20,0)")).cast("int").alias("bin")).count()
            for b, n in sorted(((r["bin"], r["count"]) for r in bins.collect()), reverse=True):
                if n >= rest:
                    low, high = low + b * step, min(low + (b + 1) * step, high)
                    break
                rest -= n
            else:
                return keys.withColumn("selected", F.lit(True))
        key, tie = (low, None) if column == "key" else (key, low)
    return keys.withColumn("selected", (F.col("key") > key) | ((F.col("key") == key) & (F.col("tie") >= tie)))


def resampled(docs: DataFrame, labels: DataFrame, text: str = "text", k: int | None = None, most_labelled: int = MOST_LABELLED, temperature: float = TEMPERATURE, key: str = "doc_id") -> DataFrame:
    """doc_id, row_key (the column named by key), log_weight, gumbel_key, selected for every document; k: how many to select, if not the sum of the weights."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(key).cast("long").alias("row_key"), F.col(text).cast("string").alias("text"))
    target = sample_of_target(labels, most_labelled)
    ratios = log_ratios(*count_ngrams(base, target))
    keys = materialise(weights(base, ratios).withColumn("key", gumbel_key(temperature)), "weights")
    if k is None:
        k = int(keys.agg(F.sum(F.round(F.exp(F.col("lw") / (1000.0 * temperature)) * 1000).cast("long"))).first()[0] or 0) // 1000
    return top_k(keys, k).select("doc_id", "row_key", (F.col("lw") / 1000.0).alias("log_weight"), (F.col("key") / 1e6).alias("gumbel_key"), "selected")
