"""Token ids in binary files: canonical, length-limited Huffman codes from global counts.

A file holds documents in ascending doc_id order.  Its ids are cut into blocks
of BLOCK ids; the bit offset of every block is stored, so blocks decode
independently, all of a file's blocks side by side with one table look-up per
id.  Layout, little-endian:

    8 bytes   MAGIC
    6 x u64   documents, ids, blocks, payload words, symbols, block size
    symbols x u32, symbols x u8      symbols and code lengths
    documents x i64, u8, u64         doc_id, whether it is null, number of ids
    blocks x u64                     bit offset of the block in the payload
    payload words x u32              the bits, highest first in each word

Null texts are empty; every document ends with the end id, so even an empty one
has an id.  A null doc_id sorts first; rows of one doc_id are ordered by their
ids.  An empty table gives no file and no row.  Columns other than doc_id and
text are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlake.llm.chunks import CHUNK, is_odd
from fernlake.llm.common import fresh_path, groups_by_size, materialise, read_file, rows_of, write_file

MAGIC = b"FLHUF001"
LIMIT = 16
BLOCK = 512
#: Ids coded at a time; whole blocks.
PACKED_IDS = 128 * BLOCK
FILE_IDS = 8_000_000
GROUP_BYTES = 16 << 20
#: Chunks that one call encodes together.
LINES = 200


class ByteBpe:
    """The tokenizers library behind a cache of chunks; batches are cut and numbered by Arrow."""

    def __init__(self, path: str, entries: int = 800_000, longest: int = 64) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.unit = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.entries, self.longest = entries, longest
        self.kept: dict[str, bytes] = {}

    def raw(self, ids: list[int]) -> bytes:
        return np.array(ids, self.unit).tobytes()

    def _work(self, new: list[str]) -> dict[str, bytes]:
        """Line feeds never join other pre-tokens here, so many chunks are encoded as lines of one text."""
        found: dict[str, bytes] = {}
        lines = [c for c in new if c.strip() and "\n" not in c]
        parts = [lines[i : i + LINES] for i in range(0, len(lines), LINES)]
        for part, coded in zip(parts, self.tokenizer.encode_batch_fast(["\n".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, self.unit)
            ends = [*np.flatnonzero(ids == self.feed).tolist(), len(ids)]
            if len(ends) != len(part):
                raise ValueError("a chunk's ids hold a line feed")
            raw, start, size = ids.tobytes(), 0, ids.itemsize
            for chunk, end in zip(part, ends, strict=True):
                found[chunk] = raw[size * start : size * end]
                start = end + 1
        for chunk in new:
            if chunk not in found:
                found[chunk] = self.raw(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        return found

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, in numbers of the width of unit."""
        cut = [t if "\0" in t else "\0".join(CHUNK.findall(t)) if is_odd(t) else t.replace("\n", "\0\n\0").replace(" ", "\0 ") for t in texts]
        lists = pc.split_pattern(pa.array(["" if "\0" in t else c for t, c in zip(texts, cut, strict=True)], pa.large_string()), "\0")
        numbered = lists.flatten().dictionary_encode()
        names, kept = numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), self.kept
        own = list(map(kept.get, names))
        new = [c for c, ids in zip(names, own, strict=True) if ids is None]
        passing = self._work(new)
        own = [passing[c] if ids is None else ids for c, ids in zip(names, own, strict=True)]
        for c in new:
            if len(kept) >= self.entries:
                break
            if len(c) <= self.longest:
                kept[c] = passing[c]
        pool = np.frombuffer(b"".join(own), self.unit)
        size = np.fromiter(map(len, own), np.int64, len(own)) // pool.itemsize
        at = np.cumsum(size) - size
        index = numbered.indices.to_numpy()
        lengths = size[index]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        kind = np.int32 if ends[-1] + len(pool) < 1 << 31 else np.int64
        places = np.arange(ends[-1], dtype=kind)
        places += np.repeat((at[index] - ends[:-1]).astype(kind), lengths)
        raw, width = pool[places].tobytes(), pool.itemsize
        borders = (ends[lists.offsets.to_numpy()] * width).tolist()
        out = [raw[a:b] for a, b in zip(borders, borders[1:], strict=False)]
        # A text that holds the mark of the cuts is encoded as it is.
        return [self.raw(self.tokenizer.encode(t, add_special_tokens=False).ids) if "\0" in t else ids for t, ids in zip(texts, out, strict=True)]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most limit bits, by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    n = len(order)
    levels: list[np.ndarray] = []  # per level: for every item of the list its coin, or -1 for a package
    packages = np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([weights, packages])
        at = np.argsort(both, kind="stable")
        levels.append(np.where(at < n, at, -1))
        both = both[at]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * n - 2
    for level in reversed(levels):
        chosen = level[:take]
        lengths[order[chosen[chosen >= 0]]] += 1
        take = 2 * int((chosen < 0).sum())
    return lengths


def canonical(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols and lengths by (length, symbol), and their codes."""
    order = np.lexsort((symbols, lengths))
    symbols, lengths = symbols[order], lengths[order].astype(np.int64)
    width = int(lengths.max(initial=1))
    steps = np.left_shift(1, width - lengths)
    codes = np.right_shift(np.cumsum(steps) - steps, width - lengths)
    return symbols, lengths, codes


def pack(documents: list[tuple[int | None, bytes]], lengths: np.ndarray, unit: str = "<u4") -> bytes:
    """A file's bytes from (doc_id, ids in numbers of kind unit); lengths has the code length of every id."""
    symbols = np.flatnonzero(lengths).astype(np.uint32)
    sym, lens, codes = canonical(symbols, lengths[symbols])
    code_of, length_of = np.zeros(len(lengths), np.uint64), np.zeros(len(lengths), np.uint8)
    code_of[sym], length_of[sym] = codes.astype(np.uint64), lens
    ids = np.frombuffer(b"".join(i for _, i in documents), unit)
    bits = length_of[ids]
    if len(ids) and not bits.all():
        raise ValueError("an id has no code")
    total = int(bits.sum(dtype=np.int64))
    size = (total + 31) // 32 + 3
    payload, offsets, at = np.zeros(size, np.uint32), [np.zeros(0, np.int64)], 0
    for i in range(0, len(ids), PACKED_IDS):  # so many at a time stay in the processor's cache
        own = bits[i : i + PACKED_IDS].astype(np.int64)
        ends = at + np.cumsum(own)
        starts = ends - own
        offsets.append(starts[::BLOCK])
        # A code lies in one or two words: put it into 64 bits from its first word on.
        placed = code_of[ids[i : i + PACKED_IDS]] << (64 - (starts & 31) - own).astype(np.uint64)
        word = starts >> 5
        new = np.flatnonzero(np.diff(word, prepend=-1))
        word, joined = word[new], np.bitwise_or.reduceat(placed, new)
        payload[word] |= (joined >> np.uint64(32)).astype(np.uint32)
        payload[word + 1] |= (joined & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        at = int(ends[-1])
    offsets = np.concatenate(offsets).astype("<u8")
    ids_of = np.array([d or 0 for d, _ in documents], "<i8")
    nulls = np.array([d is None for d, _ in documents], np.uint8)
    counts = np.array([len(i) // ids.itemsize for _, i in documents], "<u8")
    head = np.array([len(documents), len(ids), len(offsets), size, len(symbols), BLOCK], "<u8")
    return b"".join([MAGIC, head.tobytes(), symbols.astype("<u4").tobytes(), lengths[symbols].astype(np.uint8).tobytes(), ids_of.tobytes(), nulls.tobytes(), counts.tobytes(), offsets.tobytes(), payload.astype("<u4").tobytes()])


def unpack(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, numbers of ids, and all ids of a file."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    n_docs, n_ids, n_blocks, n_words, n_symbols, block = (int(x) for x in np.frombuffer(raw, "<u8", 6, 8))
    at = 56

    def part(kind: str, n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(raw, kind, n, at)
        at += found.nbytes
        return found

    symbols, lengths = part("<u4", n_symbols), part("u1", n_symbols)
    doc_ids, nulls, counts, offsets, payload = part("<i8", n_docs), part("u1", n_docs), part("<u8", n_docs), part("<u8", n_blocks), part("<u4", n_words)
    docs = [None if null else d for d, null in zip(doc_ids.tolist(), nulls.tolist(), strict=True)]
    return docs, counts.astype(np.int64), decode(payload, offsets, n_ids, symbols, lengths, block)


def decode(payload: np.ndarray, offsets: np.ndarray, n_ids: int, symbols: np.ndarray, lengths: np.ndarray, block: int) -> np.ndarray:
    if not n_ids:
        return np.zeros(0, np.uint32)
    sym, lens, codes = canonical(symbols, lengths)
    width = int(lens.max())
    spans = np.left_shift(1, width - lens)
    table = np.zeros(1 << width, np.uint32)  # symbol and length in one entry
    filled = np.repeat(sym.astype(np.uint32) << 5 | lens.astype(np.uint32), spans)
    table[: len(filled)] = filled
    pairs = payload[:-1].astype(np.uint64) << np.uint64(32) | payload[1:].astype(np.uint64)
    position = offsets.astype(np.int64)
    out = np.zeros((block, len(position)), np.uint32)
    tail, mask = n_ids - (len(position) - 1) * block, (1 << width) - 1
    for step in range(block):
        if step == tail:
            position = position[:-1]
            if not len(position):
                break
        window = pairs[position >> 5] >> (64 - width - (position & 31)).astype(np.uint64) & np.uint64(mask)
        entry = table[window.astype(np.int64)]
        out[step, : len(position)] = entry >> 5
        position = position + (entry & 31)
    return out.T.reshape(-1)[:n_ids]


def tokenised(docs: DataFrame, path: str, end_id: int, text: str = "text") -> DataFrame:
    """doc_id and ids of each document, the end id included, in numbers of the tokenizer's unit."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path)
        for group in groups_by_size(rows_of(batches, "doc_id", "text"), lambda r: len(r[1] or b"") + 64, GROUP_BYTES):
            end = model.raw([end_id])
            ids = [i + end for i in model.encode_batch([(t or b"").decode() for _, t in group])]
            yield pa.record_batch([pa.array([d for d, _ in group], pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def id_counts(tokens: DataFrame, unit: str = "<u4") -> DataFrame:
    """id and its count over all documents; each task sends one row per id at most."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for group in groups_by_size(zip(batch.column(0).to_pylist(), strict=True), lambda r: len(r[0]), GROUP_BYTES):
                found = np.bincount(np.frombuffer(b"".join(raw for (raw,) in group), unit), minlength=len(total))
                found[: len(total)] += total
                total = found
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], schema=schema)

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_files(docs: DataFrame, path: str, end_id: int, text: str = "text", to: str | None = None) -> tuple[str, list[tuple[str, int, int]]]:
    """Encode, code and write; returns the folder and (file, documents, ids) of each file in order.

    What reaches the driver is a count per vocabulary entry and a row per file.
    """
    spark = docs.sparkSession
    to = to or fresh_path(spark, "token-files")
    tokens = materialise(tokenised(docs, path, end_id, text), "tokens")
    unit = tokenizer(path).unit
    counts = {r["id"]: r["n"] for r in id_counts(tokens, unit).collect()}
    if not counts:
        return to, []
    table = np.zeros(max(counts) + 1, np.int64)
    table[list(counts)] = list(counts.values())
    lengths = code_lengths(table)
    shared = spark.sparkContext.broadcast(lengths.tobytes())
    parts = max(int(table.sum()) // (FILE_IDS // 2), spark.sparkContext.defaultParallelism)
    width = np.dtype(unit).itemsize
    schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        lens = np.frombuffer(shared.value, np.uint8)
        for seq, group in enumerate(groups_by_size(rows_of(batches, "doc_id", "ids"), lambda r: len(r[1]) // width, FILE_IDS)):
            name = f"{to}/part-{part:06d}-{seq:04d}.huf"
            write_file(name, [pack(group, lens, unit)])
            yield pa.record_batch([[part], [seq], [name], [len(group)], [sum(len(i) for _, i in group) // width]], schema=schema)

    ordered = tokens.select("doc_id", "ids").repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    files = ordered.mapInArrow(run, "part long, seq long, file string, docs long, ids long").collect()
    return to, [(r["file"], r["docs"], r["ids"]) for r in sorted(files, key=lambda r: (r["part"], r["seq"]))]


def read_files(spark, files: list[tuple[str, int, int]], keep_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, and with keep_ids the ids (little-endian, 32 bits) of each document of the files, given in order."""
    base, rows = 0, []
    for name, _, n in files:
        rows.append((name, base))
        base += n
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.binary())] if keep_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, start in rows_of(batches, "file", "base"):
            docs, counts, ids = unpack(read_file(name))
            ends = np.cumsum(counts)
            spans = list(zip(docs, (ends - counts).tolist(), ends.tolist(), strict=True))
            raw = ids.astype("<u4").tobytes()
            for group in groups_by_size(spans, lambda s: 4 * (s[2] - s[1]), GROUP_BYTES):
                cut = [raw[4 * a : 4 * b] for _, a, b in group]
                own = [pa.array(cut, pa.binary())] if keep_ids else []
                yield pa.record_batch([pa.array([d for d, _, _ in group], pa.int64()), pa.array([start + a for _, a, _ in group]), pa.array([b - a for _, a, b in group]), pa.array([zlib.crc32(c) for c in cut], pa.int64()), *own], schema=schema)

    frame = spark.createDataFrame(rows, "file string, base long").repartition(max(len(rows), 1))
    return frame.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if keep_ids else ""))


def token_files(docs: DataFrame, path: str, end_id: int = 2, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Write the files of a corpus and read them back."""
    _, files = write_files(docs, path, end_id, text)
    return read_files(docs.sparkSession, files, keep_ids)
