"""Substring deduplication: repeated windows of words are taken out, the first occurrence stays.

Words are runs of characters other than ASCII white space, unchanged.  Every
window of `width` consecutive words of a document gets a Rabin-Karp hash (of
64-bit hashes of its words); hashes are counted in Spark, and windows that begin
earlier elsewhere - in a smaller doc_id, or earlier in the document - are
repeats.  The repeats of a document merge into maximal intervals, whose words
are removed.  Hashes have 64 bits: over w windows about w*w / 2**65 windows are
taken for repeats wrongly.

Null texts have no words.  A null doc_id comes before all others.  Texts that
share a doc_id are ordered by a hash of the text; rows that agree in both are
one document, and all get its result.  Columns other than doc_id and text are
not read by `removals`; `applied` keeps every column.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlake.llm import windows
from fernlake.llm.common import column, free_name, groups_by_size, keyed, materialise, parted, rows_of, text_bytes, unique_ids

WIDTH = 20


WORD = re.compile(rb"[^ \t\n\x0b\f\r]+")


def cut(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the words marked, and without the space after each run of them."""
    if not gone.any():
        return text
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    turn = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
    out, at = [], 0
    for a, b in zip(turn[::2], turn[1::2], strict=True):
        out.append(text[at : starts[a]])
        at = starts[b]
    return b"".join([*out, text[at:]])


def word_units(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def hashed_windows(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_by_size(rows_of(batches, "k", "c", "text"), lambda r: len(r[2] or b"") + 64, windows.GROUP_BYTES):
            rows = list({(k, c): t for k, c, t in group}.items())
            rows.sort(key=lambda r: r[0])
            units, sizes = [], []
            for _, t in rows:
                units.append(word_units((t or b"").split()))
                sizes.append(len(units[-1]))
            size = np.array(sizes, np.int64)
            ends = np.cumsum(size)
            hashes = windows.rolling(np.concatenate(units), width)
            del units
            doc = np.repeat(np.arange(len(rows)), np.maximum(size - width + 1, 0))
            if not len(doc):
                continue
            own = np.maximum(size - width + 1, 0)
            offset = np.arange(len(doc)) - np.repeat(np.cumsum(own) - own, own)
            hashes = hashes[np.repeat(ends - size, own) + offset]
            first, _ = windows.firsts(hashes)
            k = np.array([r[0][0] for r in rows], np.int64)[doc]
            c = np.array([r[0][1] for r in rows], np.int64)[doc]
            again = ~first
            out = list(windows.blob_rows(windows.doc_bucket(k[again], c[again], buckets), True, k[again], c[again], offset[again]))
            k, c, offset, hashes = k[first], c[first], offset[first], hashes[first]
            out += windows.blob_rows(windows.hash_bucket(hashes, buckets), False, k, c, offset, hashes)
            for part in groups_by_size(iter(out), lambda r: len(r[2]), 4 << 20):
                yield windows.batch_of(part)

    return docs.select("k", "c", "text").mapInArrow(run, windows.BLOB)


def repeated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """keyed() documents -> (k, c, places): starts of the windows to remove."""
    buckets = windows.bucket_count(docs)
    settled = windows.settle(hashed_windows(docs, width, buckets), buckets)
    return windows.places_by_document(settled)


def removals(docs: DataFrame, width: int = WIDTH, text: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (start and end of each interval, in words), and with keep_text the text without them."""
    base = keyed(docs, text)
    joined = windows.with_places(base, repeated(base, width))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))] + ([("kept", pa.string())] if keep_text else []))

    def one(doc_id, text, raw) -> tuple:
        words = (text or b"").split()
        gone = windows.covered(windows.places(raw), width, len(words))
        turn = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
        left = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if raw is not None else b" ".join(words)
        return (doc_id, len(words), int(gone.sum()), hashlib.sha256(left).hexdigest(), turn.reshape(-1, 2).tolist(), *([None if text is None else cut(text, gone).decode()] if keep_text else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_by_size(rows_of(batches, "doc_id", "text", "places"), lambda r: len(r[1] or b"") + 64, 4 << 20):
            rows = [one(*r) for r in group]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    kinds = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<array<bigint>>" + (", kept string" if keep_text else "")
    return joined.select("doc_id", "text", "places").mapInArrow(run, kinds)


def applied(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows with the repeats cut from their text and n_chars, if there, counted anew; texts that lose every word go.

    Texts that may have repeats are dealt out, with all their columns, to meet the places of these; the others stay where they are.
    """
    key, mark = free_name(docs, "row_id"), free_name(docs, "places")
    rows = unique_ids(docs, key)
    found = repeated(rows.select(F.col(key).alias("k"), F.lit(0).alias("c"), F.col("text").cast("string").alias("text")), width)
    found = materialise(found.select(F.col("k").alias(key), F.col("places").alias(mark)), "places")
    may, rest = parted(rows, found, key)
    joined = may.join(found, key, "left").select(*docs.columns, mark).unionByName(rest.select(*docs.columns, F.lit(None).cast("binary").alias(mark)))
    names = list(docs.columns)

    def one(text: bytes | None, raw: bytes | None) -> str | None:
        """The text without its repeats; None if no word is left."""
        n = len(text.split())
        gone = windows.covered(windows.places(raw), width, n)
        return None if gone.all() else cut(text, gone).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = column(batch, mark)
            hit = [i for i, raw in enumerate(places) if raw is not None]
            texts, own = text_bytes(batch), batch.select(names)
            kept = {i: one(texts[i], places[i]) for i in hit}
            out = []
            for name in names:
                values = batch.column(name)
                if hit and name in ("text", "n_chars"):
                    fresh = values.to_pylist()
                    for i, t in kept.items():
                        fresh[i] = t if name == "text" else len(t or "")
                    values = pa.array(fresh, values.type)
                out.append(values)
            yield pa.RecordBatch.from_arrays(out, schema=own.schema).filter(pa.array([kept.get(i, "") is not None for i in range(len(places))], pa.bool_()))

    return joined.mapInArrow(run, docs.schema)
