"""What the corpus operators share: the shared folder, written tables, batches, document keys."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id in keys, so that nulls sort first and join.
NULL_KEY = -(2**63)

#: Rows of 64 bits in the bitmap of a set of keys, at most.
WORDS = 1 << 18

#: Words of the contracts: runs of bytes other than these, which is what bytes.split() gives.
WORD_SPACE = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            found = set_dir.get()
        else:
            found = "file://" + tempfile.mkdtemp(prefix="fernlake-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches of the session hold 250 rows at most: batches of whole texts, or of blobs of tens of KB, otherwise take tens of MB in every task, twice."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= 250:
        spark.conf.set(name, "250")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_split(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """rows joined with groups, which has one row per key and the number of its rows, n; n is not returned.

    Keys that hold over a thousandth of all rows are at most a thousand: they are
    broadcast, so that no task gets a large group.  The others are dealt out by key.
    """
    total = groups.agg(F.sum("n")).first()[0] or 0
    large = F.col("n") * 1000 > total
    hot, others = groups.where(large).drop("n"), groups.where(~large).drop("n")
    columns = [*rows.columns, *(c for c in hot.columns if c != key)]
    few = rows.join(F.broadcast(hot), key).select(columns)
    return few.union(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(others, key).select(columns))


def parted(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among keys, rows whose key surely is not), so that only the first need to meet keys in a shuffle.

    A bitmap of hashed keys tells them apart.  It is broadcast and has WORDS rows of
    64 bits at most, however many keys there are: the more, the more rows are in the
    first part, which the caller joins exactly.  keys is a written table; each part
    scans rows once.
    """
    word, bit, mask = (free_name(rows, n) for n in ("bitmap_word", "bitmap_bit", "bitmap_mask"))

    def hashed(df: DataFrame, name: str) -> DataFrame:
        h = F.xxhash64(F.col(name).cast("long"))
        return df.withColumns({word: F.pmod(F.shiftright(h, 6), F.lit(WORDS)), bit: h.bitwiseAND(F.lit(63)).cast("int")})

    one = F.expr(f"shiftleft(1L, {bit})")
    words = hashed(keys.select(key), key).groupBy(word).agg(F.bit_or(one).alias(mask))
    # The words are written, so that both parts read the same few rows.
    marked = hashed(rows, key).join(F.broadcast(materialise(words, "bitmap")), word, "left")
    may = F.coalesce(F.col(mask).bitwiseAND(one) != 0, F.lit(False))
    return marked.where(may).select(rows.columns), marked.where(~may).select(rows.columns)


def without_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key, which is not null, is not among keys, a written table."""
    may, rest = parted(rows, keys, key)
    return rest.unionByName(may.join(keys.select(key), key, "left_anti").select(rows.columns))


def doc_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_KEY))


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text and a unique key (k, c): k is doc_id, c tells apart different texts of one doc_id.

    Rows that agree in both doc_id and text get one key: they are the same document given twice.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    base = base.withColumn("k", doc_key())
    hashed = base.select("k", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    double = hashed.groupBy("k").agg(F.min("th").alias("lo"), F.max("th").alias("hi")).where("lo <> hi")
    if double.isEmpty():
        return base.withColumn("c", F.lit(0))
    copies = hashed.join(double.select("k"), "k", "left_semi").groupBy("k").agg(F.array_sort(F.collect_set("th")).alias("ths"))
    copies = copies.select("k", F.posexplode("ths").alias("c", "th"))
    return (
        base.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
        .join(copies, ["k", "th"], "left")
        .select("doc_id", "text", "k", F.coalesce("c", F.lit(0)).alias("c"))
    )


def free_name(docs: DataFrame, name: str) -> str:
    """A name that no column of the documents has."""
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def unique_ids(docs: DataFrame, name: str = "__id") -> DataFrame:
    """The rows with a unique long that sorts like doc_id, then text: doc_id itself unless it has nulls or repeats."""
    own = docs.withColumn(name, F.col("doc_id").cast("long"))
    if own.groupBy(name).count().where(F.col(name).isNull() | (F.col("count") > 1)).isEmpty():
        return own
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_first(), "text")
    return materialise(ordered.withColumn(name, F.monotonically_increasing_id()), "ids")


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def groups_by_size(items: Iterator[tuple], size_of, limit: int) -> Iterator[list[tuple]]:
    """Lists of items whose sizes sum to about limit; one larger item forms a list alone."""
    held: list[tuple] = []
    total = 0
    for item in items:
        n = size_of(item)
        if held and total + n > limit:
            yield held
            held, total = [], 0
        held.append(item)
        total += n
    if held:
        yield held


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of the batches as tuples, text as UTF-8 bytes; some hundred at a time are held as Python objects."""
    for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
        yield from zip(*(text_bytes(batch, n) if n == "text" else column(batch, n) for n in names), strict=True)
    give_back()


def give_back() -> None:
    """Memory that a Python worker has freed goes back to the system: workers stay beside the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def filesystem(uri: str):
    """A pyarrow file system and path for a URI of the shared folder."""
    from pyarrow import fs

    if re.match(r"file:/(?!/)", uri):
        uri = "file://" + uri[5:]
    if "://" not in uri:
        uri = "file://" + uri
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, parts: Iterable[bytes]) -> None:
    """Write under a private name, then rename: a task that runs twice leaves one whole file."""
    system, path = filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    private = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(private) as out:
        for part in parts:
            out.write(part)
    system.move(private, path)


def read_file(uri: str) -> bytes:
    system, path = filesystem(uri)
    with system.open_input_file(path) as source:
        return source.read()
