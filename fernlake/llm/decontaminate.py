"""Benchmark decontamination: test items found inside documents by MinHash containment search.

Containment is the share of an item's distinct shingles (five words, letters and
digits only, A-Z lowered) that a document holds; an item of fewer words is one
shingle.  A short item shares next to nothing with a long document as a whole,
so items are partitioned by size, and for each class of up to L shingles the
document is searched in windows of 2L shingles every L: an item inside a
document lies inside a window whose size is at most four times its own.  There
Jaccard similarity is at least 0.19 where containment is 0.8, and one of 64
minima agrees with a chance above 1 - 2e-6.  Items of up to eight shingles are looked up by
each of them instead.  Every candidate is verified by exact comparison of shingles
over the whole document.

The items are the query set: they are taken to the executors in blocks of a
bounded size (one, unless there are very many); documents are not shuffled.
Null texts, of documents or items, hold nothing.  Repeated rows, of either,
give repeated rows.  Other columns than the id and the text are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlake.llm.common import groups_by_size, rows_of
from fernlake.llm.windows import rolling

SHINGLE = 5
MINIMA = 64
TINY = 8
THRESHOLD = 0.8
#: Bytes of item text that one block sends to the executors.
BLOCK_BYTES = 16 << 20
GROUP_BYTES = 2 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_RNG = np.random.default_rng(42)
FACTORS = _RNG.integers(1 << 62, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RNG.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall((text or b"").lower())


def hashes_of(words: list[bytes], width: int) -> np.ndarray:
    return rolling(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), width)


class Marks:
    """A set of 64-bit values, with a bitmap in front of the binary search."""

    def __init__(self, values: np.ndarray, owners: np.ndarray) -> None:
        order = np.argsort(values, kind="stable")
        self.values, self.owners = values[order], owners[order]
        self.map = np.zeros(1 << 16, bool)
        self.map[self._slot(self.values)] = True

    @staticmethod
    def _slot(values: np.ndarray) -> np.ndarray:
        return (values * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64)

    def find(self, values: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place in values, owner) of each agreement."""
        at = np.flatnonzero(self.map[self._slot(values)])
        low = np.searchsorted(self.values, values[at], "left")
        high = np.searchsorted(self.values, values[at], "right")
        for place, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
            for j in range(a, b):
                yield place, int(self.owners[j])


class Index:
    """The items of a block: their exact shingles, and marks by class of size."""

    def __init__(self, items: list[tuple[int | None, bytes | None]]) -> None:
        self.ids = [i for i, _ in items]
        self.shingles: list[dict[int, bytes]] = []
        self.widths: list[int] = []
        tiny, classes = defaultdict(lambda: ([], [])), defaultdict(list)
        for n, (_, text) in enumerate(items):
            words = words_of(text)
            width = min(SHINGLE, len(words))
            self.widths.append(width)
            hashed = hashes_of(words, width).tolist() if width else []
            own = {h: b" ".join(words[i : i + width]) for i, h in enumerate(hashed)}
            self.shingles.append(own)
            if width < SHINGLE or len(own) <= TINY:
                tiny[width][0].extend(own)
                tiny[width][1].extend([n] * len(own))
            else:
                classes[1 << (len(own) - 1).bit_length()].append(n)
        self.tiny = {w: Marks(np.array(h, np.uint64), np.array(o)) for w, (h, o) in tiny.items() if h}
        self.classes: dict[int, list[Marks]] = {}
        for size, members in sorted(classes.items()):
            minima = np.array([[(np.array([*self.shingles[n]], np.uint64) * f + s).min() for f, s in zip(FACTORS, SHIFTS, strict=True)] for n in members], np.uint64)
            self.classes[size] = [Marks(minima[:, j], np.array(members)) for j in range(MINIMA)]

    def candidates(self, units: np.ndarray, starts: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) to verify, among documents whose words' hashes stand one after another, from starts on."""
        sizes = np.diff(starts)
        found: set[tuple[int, int]] = set()
        for width, marks in self.tiny.items():
            hashes = rolling(units, width)
            for place, item in marks.find(hashes):
                doc = int(np.searchsorted(starts, place, "right")) - 1
                if place + width <= starts[doc + 1]:
                    found.add((doc, item))
        if not self.classes:
            return found
        own = np.maximum(sizes - SHINGLE + 1, 0)  # shingles of each document
        docs = np.flatnonzero(own)
        if not len(docs):
            return found
        owner = np.repeat(docs, own[docs])
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(own[docs]) - own[docs], own[docs])
        hashes = rolling(units, SHINGLE)[starts[owner] + offset]
        # Blocks of L shingles, by document; a window is a block and the next of the document.
        least = min(self.classes)
        edge = np.flatnonzero(offset % least == 0)
        for j, (factor, shift) in enumerate(zip(FACTORS, SHIFTS, strict=True)):
            size, minima, block_doc, block = least, np.minimum.reduceat(hashes * factor + shift, edge), owner[edge], offset[edge] // least
            while True:
                if size in self.classes:
                    window = minima.copy()
                    same = block_doc[1:] == block_doc[:-1]
                    window[:-1][same] = np.minimum(minima[:-1], minima[1:])[same]
                    found.update((int(block_doc[place]), item) for place, item in self.classes[size][j].find(window))
                if size >= max(self.classes):
                    break
                size, pairs = 2 * size, np.flatnonzero(block % 2 == 0)
                minima, block_doc, block = np.minimum.reduceat(minima, pairs), block_doc[pairs], block[pairs] // 2
        return found

    def shared(self, words: list[bytes], own: dict[int, dict[int, list[int]]], item: int) -> int:
        """How many of the item's shingles the document holds, compared word by word."""
        width = self.widths[item]
        if width not in own:
            places = own[width] = defaultdict(list)
            for at, h in enumerate(hashes_of(words, width).tolist()):
                places[h].append(at)
        places = own[width]
        return sum(any(b" ".join(words[at : at + width]) == text for at in places.get(h, ())) for h, text in self.shingles[item].items())


def contained(docs: DataFrame, items: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment of each item that a document contains."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (BLOCK_BYTES // 2)))
    out = None
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        found = _search(base, [(r["item_id"], (r["text"] or "").encode()) for r in part.collect()], threshold)
        out = found if out is None else out.union(found)
    return out


def _search(docs: DataFrame, items: list[tuple[int | None, bytes]], threshold: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_shingles", pa.int64()), ("containment", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for group in groups_by_size(rows_of(batches, "doc_id", "text"), lambda r: len(r[1] or b"") + 64, GROUP_BYTES):
            words = [words_of(t) for _, t in group]
            starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
            units = np.fromiter((xxhash.xxh3_64_intdigest(w) for row in words for w in row), np.uint64, int(starts[-1]))
            rows, known, last = [], {}, None
            for doc, item in sorted(index.candidates(units, starts)):
                if doc != last:
                    known, last = {}, doc
                n, total = index.shared(words[doc], known, item), len(index.shingles[item])
                if total and n >= threshold * total:
                    rows.append((group[doc][0], index.ids[item], n, total, n / total))
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, "doc_id long, item_id long, n_shared long, n_shingles long, containment double")
