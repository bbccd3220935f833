"""Suffix-array deduplication of bytes: repeated strings of `width` bytes go, the first occurrence stays.

The order of all suffixes comes from merging Burrows-Wheeler transforms of
shards.  A transform, inverted, leads from a suffix to the one a symbol shorter,
and composed with itself to the one h symbols shorter.  The shards' suffixes are
interleaved by their first few symbols, which the transforms give; a round then
refines the interleave by h symbols to one by 2 h: suffixes that agree in h
symbols are told apart by the block of what follows these.  Blocks of one suffix
are settled and take no part in further rounds, so no suffix is compared with
another and not all are sorted again.  Where neighbours part, the round says
what prefix they had in common; stretches with one of `width` symbols are the
repeated intervals, that is, one repeated string each.

Not all suffixes need be merged at one place.  Every string of `width` bytes has
an anchor, the least hashed half-length gram inside it; equal strings have equal
anchors at equal offsets.  Consecutive strings of one anchor form a run, and

1. anchors are counted by hash in Spark (the blobs of `windows`); a run whose
   anchor stands nowhere else repeats nothing and is dropped;
2. the other runs' bytes go to buckets by anchor.  Of equal runs the first is
   kept, in the sending task already, and the others are repeats as a whole;
3. a bucket cuts its distinct runs into shards, sorts each shard's suffixes, and
   merges the shards' transforms.  In each final block the earliest string stays.

Copies of a whole text (equal SHA-256) repeat the first one in all their bytes and
skip steps 2 and 3.  They and equal runs only save work: a group of copies, however
large, reaches a bucket once.  Hashes choose what to compare; the result is exact.

Null texts are empty.  A null doc_id comes before all others.  Texts that share
a doc_id are ordered by a hash of the text; rows that agree in both are one
document, and all get its result.  Long texts are cut into overlapping pieces.
An empty table gives no row.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlake.llm import windows
from fernlake.llm.common import NULL_KEY, give_back, groups_by_size, join_split, keyed, materialise, rows_of

WIDTH = 100
#: Bytes of text a task works on at once, and of a long text cut off as one piece.
GROUP_BYTES = 3 << 19
PIECE = 1 << 20
#: Bytes of runs whose suffixes are sorted as one shard, and of runs whose shards are merged at a time (more if one anchor has more).
SHARD = 1 << 17
MERGED = 1 << 19
#: Settled places that are unpacked at a time.
PLACES = 1 << 19
#: Symbols by which the first interleave goes, as many as fit a number at 9 bits each.
PACKED = 7
#: A run as one number: start << 28 | strings in it << 14 | offset of the anchor.
FIELD = 14


def pieces(rows: Iterator[tuple[int, int, bytes | None]], width: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(k, c, base, bytes): texts, long ones in pieces that overlap so that each string is in one."""
    for k, c, text in rows:
        text = text or b""
        for base in range(0, max(len(text) - width + 1, 0), PIECE):
            yield k, c, base, text[base : base + PIECE + width - 1]


def runs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Runs of strings by anchor: piece, first start in it, number of strings, anchor's offset from the first start, anchor's hash."""
    gram = width // 2
    span = width - gram + 1  # grams in a string
    hashes = windows.rolling(data, gram)
    low = np.uint64((1 << 24) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    own = np.maximum(sizes - width + 1, 0)
    piece = np.repeat(np.arange(len(sizes)), own)
    at = np.arange(len(piece)) - np.repeat(np.cumsum(own) - own, own) + starts[piece]
    anchor = (least[at] & low).astype(np.int64)
    del least
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])])) if len(at) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(at)))
    return piece[first], at[first] - starts[piece[first]], count, anchor[first] - at[first], hashes[anchor[first]]


def anchors(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """Blobs: runs under their anchor's hash, and runs known to have company in their task's share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_by_size(pieces(rows_of(batches, "k", "c", "text"), width), lambda r: len(r[3]), GROUP_BYTES):
            group = sorted({g[:3]: g for g in group}.values(), key=lambda g: g[:3])
            sizes = np.array([len(g[3]) for g in group], np.int64)
            data = np.frombuffer(b"".join(g[3] for g in group), np.uint8)
            piece, start, count, offset, hashes = runs(data, np.cumsum(sizes) - sizes, sizes, width)
            k, c, base = (np.array([g[i] for g in group], np.int64)[piece] for i in range(3))
            place = (base + start) << 2 * FIELD | count << FIELD | offset
            first, many = windows.firsts(hashes)
            out = list(windows.blob_rows(windows.doc_bucket(k[many], c[many], buckets), True, k[many], c[many], place[many]))
            # One run speaks for its anchor to other tasks; those with company in this one are sent above in any case.
            out += windows.blob_rows(windows.hash_bucket(hashes[first], buckets), False, k[first], c[first], place[first], hashes[first])
            for part in groups_by_size(iter(out), lambda r: len(r[2]), 4 << 20):
                yield windows.batch_of(part)

    return docs.select("k", "c", "text").mapInArrow(run, windows.BLOB)


def pack_runs(rows: list[tuple[int, int, int, int, bytes]]) -> bytes:
    """(k, c, start, anchor offset, bytes) of runs, compressed."""
    k, c, p, o, text = zip(*rows, strict=True)
    head = windows.pack(np.array(k, np.int64), np.array(c, np.int64), np.array(p, np.int64))
    sizes, offsets = np.array([len(t) for t in text], "<u4").tobytes(), np.array(o, "<u4").tobytes()
    return np.array([len(rows), len(head)], "<u8").tobytes() + head + zlib.compress(sizes + offsets + b"".join(text), 1)


def unpack_runs(raw: bytes) -> list[tuple[int, int, int, int, bytes]]:
    n, size = np.frombuffer(raw, "<u8", 2).tolist()
    k, c, p, _ = windows.unpack(raw[16 : 16 + size])
    body = zlib.decompress(raw[16 + size :])
    sizes, offsets = np.frombuffer(body, "<u4", n).tolist(), np.frombuffer(body, "<u4", n, 4 * n).tolist()
    out, at = [], 8 * n
    for place, o, length in zip(zip(k.tolist(), c.tolist(), p.tolist(), strict=True), offsets, sizes, strict=True):
        out.append((*place, o, body[at : at + length]))
        at += length
    return out


def send_runs(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """Blobs of the runs whose anchor has company (column places), by anchor; equal runs of a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = width // 2
        for group in groups_by_size(rows_of(batches, "k", "c", "places", "text"), lambda r: len(r[3] or b"") + 64, 8 << 20):
            seen: set[bytes] = set()
            ready: dict[int, list] = defaultdict(list)
            repeats: list[tuple[int, int, int, int]] = []
            for (k, c), (places, text) in sorted({(k, c): (p, t) for k, c, p, t in group}.items()):
                for place in windows.places(places).tolist():
                    start, count, offset = place >> 2 * FIELD, place >> FIELD & (1 << FIELD) - 1, place & (1 << FIELD) - 1
                    own = text[start : start + count + width - 1]
                    if own in seen:
                        repeats.append((k, c, start, count))
                        continue
                    seen.add(own)
                    anchor = xxhash.xxh3_64_intdigest(text[start + offset : start + offset + gram])
                    ready[(anchor >> 32) * buckets >> 32].append((k, c, start, offset, own))
            out = [(bucket, False, pack_runs(rows)) for bucket, rows in ready.items()]
            out += settled_stretches(repeats, buckets)
            for part in groups_by_size(iter(out), lambda r: len(r[2]), 4 << 20):
                yield windows.batch_of(part)

    return docs.select("k", "c", "places", "text").mapInArrow(run, windows.BLOB)


def spread(stretches: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (k, c, p) of stretches (k, c, first place, number of places)."""
    k, c, p, n = (np.array(x, np.int64) for x in (zip(*stretches, strict=True) if stretches else [()] * 4))
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(k, n), np.repeat(c, n), np.repeat(p, n) + inside


def settled_rows(k: np.ndarray, c: np.ndarray, p: np.ndarray, buckets: int) -> list[tuple[int, bool, bytes]]:
    order = np.lexsort((p, c, k))  # places in order pack well
    k, c, p = k[order], c[order], p[order]
    return list(windows.blob_rows(windows.doc_bucket(k, c, buckets), True, k, c, p))


def settled_stretches(stretches: list[tuple[int, int, int, int]], buckets: int) -> Iterator[tuple[int, bool, bytes]]:
    """Rows of the places of stretches, some at a time: a place takes a hundred bytes until it is packed."""
    for part in groups_by_size(iter(stretches), lambda s: s[3], PLACES):
        yield from settled_rows(*spread(part), buckets)


# --- Burrows-Wheeler transforms ----------------------------------------------


def packed(symbols: np.ndarray, steps: int, advance) -> np.ndarray:
    """The first symbols of each suffix as one number; advance gives the symbols one place further on."""
    key = symbols.astype(np.uint64)
    for i in range(1, steps):
        key = key << np.uint64(9) | advance(i).astype(np.uint64)
    return key


def starts_of(new: np.ndarray) -> np.ndarray:
    """For each place of an order, where its block starts; new marks the places that start one."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def refine(order: np.ndarray, rank: np.ndarray, left: np.ndarray, common: np.ndarray, depth: int, longer: int, follow) -> None:
    """Refine, in place, an order of suffixes by depth symbols to one by longer.

    rank: of each suffix, where its block starts; left: symbols before its end;
    common: of each place, the symbols known to agree with the place before.
    follow(suffixes) is what follows longer - depth symbols.  Blocks of one
    suffix, and those of a whole short suffix, are settled.
    """
    held = rank[order]
    joined = held[1:] == held[:-1]
    active = np.concatenate([[False], joined]) | np.concatenate([joined, [False]])
    active &= left[order] >= depth
    place = np.flatnonzero(active)
    if not len(place):
        return
    suffix = order[place]
    key = held[place].astype(np.int64) * (len(order) + 1) + rank[follow(suffix)]
    moved = np.argsort(key, kind="stable")
    suffix, key = suffix[moved], key[moved]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    order[place] = suffix
    rank[suffix] = place[starts_of(new)]
    parted = place[new]
    parted = parted[held[parted] != parted]  # the block started here before
    common[parted] = depth


def shard_transform(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of some texts, ordered by their first width symbols and then their places, and the transform.

    Symbols are bytes + 1; 0 stands for an end and all that follows it.
    """
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    n = int(lengths.sum())
    ends = np.cumsum(lengths) - 1
    left = np.repeat(ends, lengths) - np.arange(n)
    symbols = np.zeros(n, np.uint16)
    symbols[left > 0] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1

    def advance(i: int) -> np.ndarray:
        out = np.zeros(n, np.uint16)
        out[: max(n - i, 0)] = symbols[i:]
        out[left < i] = 0
        return out

    depth = min(PACKED, width)
    key = packed(symbols, depth, advance)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    rank = np.empty(n, np.int64)
    rank[order] = starts_of(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    common = np.zeros(n, np.int32)
    while depth < width:
        longer = min(2 * depth, width)
        refine(order, rank, left, common, depth, longer, lambda s, step=longer - depth: s + step)
        depth = longer
    before = symbols[order - 1]
    before[order == 0] = 0
    return order, before


def merge_transforms(transforms: list[np.ndarray], left: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave the shards' suffixes by their first width symbols: (place in the shards, one after another; common prefix with the one before, at most width).

    The common prefix is what the rounds prove: exact where it is width, else the last depth at which both agreed.
    Suffixes that agree in width symbols stay in the order of the shards.

    transforms: of the shards; left: of each place in the shards, the symbols before its suffix's end.
    """
    n = len(left)
    # Inverted, a transform leads to the suffix one symbol shorter; from an end it stays there.
    step, first, at = np.empty(n, np.int32), np.empty(n, np.uint16), 0
    for t in transforms:
        own = np.argsort(t, kind="stable")
        step[at : at + len(t)] = at + own
        first[at : at + len(t)] = t[own]
        at += len(t)
    step = np.where(left == 0, np.arange(n, dtype=np.int32), step)
    depth = min(PACKED, width)
    reached = [np.arange(n, dtype=np.int32)]

    def advance(i: int) -> np.ndarray:
        reached[0] = step[reached[0]]
        return first[reached[0]]

    key = packed(first, depth, advance)
    steps = {1: step, depth: step[reached[0]]}
    order = np.argsort(key, kind="stable")  # every shard's keys ascend already
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int32)
    rank[order] = starts_of(new)
    common = np.where(new, 0, width).astype(np.int32)
    del key, ordered, reached

    def follow(places: np.ndarray, far: int) -> np.ndarray:
        for size in sorted(steps, reverse=True):
            while far >= size:
                places, far = steps[size][places], far - size
        return places

    while depth < width:
        longer = min(2 * depth, width)
        refine(order, rank, left, common, depth, longer, lambda s, far=longer - depth: follow(s, far))
        if 2 * longer <= width:
            steps[longer] = steps[depth][steps[depth]]
        depth = longer
    return order, common


def equal_strings(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, offset, block) of every string of width bytes inside the texts; equal strings share a block, in the order of their places."""
    shards, held, total = [], [], 0
    for n, t in enumerate(texts):
        if not held or total + len(t) > SHARD:
            held = []
            shards.append(held)
            total = 0
        held.append(n)
        total += len(t)
    transforms, owner, offset = [], [], []
    for members in shards:
        order, transform = shard_transform([texts[n] for n in members], width)
        lengths = np.array([len(texts[n]) + 1 for n in members], np.int64)
        text = np.repeat(np.arange(len(members)), lengths)
        inside = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        transforms.append(transform)
        owner.append(np.array(members)[text[order]])
        offset.append(inside[order])
    owner, offset = np.concatenate(owner), np.concatenate(offset)
    left = np.array([len(t) for t in texts])[owner] - offset
    at, common = merge_transforms(transforms, left, width)
    block = np.cumsum(common < width)
    whole = left[at] >= width
    return owner[at][whole], offset[at][whole], block[whole]


def settle_runs(blobs: DataFrame, width: int, buckets: int) -> DataFrame:
    """Blobs of runs and of settled places -> blobs of the starts of all repeats, by document."""

    def run(key, group):
        rows = list(zip(group.column("repeats").to_pylist(), group.column("blob").to_pylist(), strict=True))
        out = []
        for part in groups_by_size(((b,) for done, b in rows if done), lambda r: windows.places_in(r[0]), PLACES):
            k, c, p, _ = windows.unpack_all([b for (b,) in part])
            out += settled_rows(k, c, p, buckets)
        found = sorted(x for done, b in rows if not done for x in unpack_runs(b))
        repeats: list[tuple[int, int, int, int]] = []
        seen: dict[bytes, tuple[int, int, int]] = {}
        families: dict[bytes, list[tuple[int, int, int, bytes]]] = defaultdict(list)
        for k, c, start, offset, own in found:
            place = seen.setdefault(own, (k, c, start))
            if place != (k, c, start):
                repeats.append((k, c, start, len(own) - width + 1))
            elif not families[anchor := own[offset : offset + width // 2]] or families[anchor][-1] != (k, c, start, own):
                families[anchor].append((k, c, start, own))
        out += settled_stretches(repeats, buckets)
        del rows, found, seen, repeats
        # Distinct runs with an anchor in common, and only they, can share some of their strings.
        shared = ((members, sum(len(r[3]) for r in members)) for members in families.values() if len(members) > 1)
        for part in groups_by_size(shared, lambda m: m[1], MERGED):
            mixed = sorted(r for members, _ in part for r in members)
            owner, offset, block = equal_strings([r[3] for r in mixed], width)
            # mixed is in the order of places, so of a block the first is the earliest.
            later = np.flatnonzero(block[1:] == block[:-1]) + 1
            k, c, start = (np.array([r[i] for r in mixed], np.int64)[owner[later]] for i in range(3))
            out += settled_rows(k, c, start + offset[later], buckets)
            del mixed, owner, offset, block, later, k, c, start
        families.clear()
        give_back()
        return pa.Table.from_batches([windows.batch_of(out)] if out else [], windows.BLOB_SCHEMA)

    return blobs.groupBy("bucket").applyInArrow(run, windows.BLOB)


def removals(docs: DataFrame, width: int = WIDTH, text: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with keep_text the bytes left."""
    if width // 2 >= 1 << FIELD:
        raise ValueError("width is too large")
    base = keyed(docs, text).select("k", "c", "text")
    buckets = windows.bucket_count(docs, text)
    company = windows.places_by_document(windows.settle(anchors(base, width, buckets), buckets, windows.shared))
    # Whole copies of an earlier text; only keys and digests are dealt out.
    digests = materialise(base.where(F.octet_length("text") >= width).select("k", "c", F.unhex(F.sha2("text", 256)).alias("digest")), "digests")
    first = digests.groupBy("digest").agg(F.min(F.struct("k", "c")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "n", F.col("first.k").alias("k0"), F.col("first.c").alias("c0"))
    copies = join_split(digests, materialise(first, "first"), "digest").where("k <> k0 or c <> c0").select("k", "c", F.lit(True).alias("copy")).distinct()
    wanted = company.join(copies, ["k", "c"], "left_anti")
    sent = send_runs(base.join(wanted, ["k", "c"]), width, buckets)
    found = windows.places_by_document(settle_runs(sent, width, buckets))
    verdicts = found.join(copies, ["k", "c"], "full")
    joined = base.join(verdicts, ["k", "c"], "left")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + ([("kept", pa.binary())] if keep_text else []))

    def one(k, places, copy, text) -> tuple:
        text, doc_id = text or b"", None if k == NULL_KEY else k
        if copy:
            return (doc_id, len(text), len(text), 1, hashlib.sha256(b"").hexdigest(), *([b""] if keep_text else []))
        gone = windows.covered(windows.places(places), width, len(text)) if places is not None else np.zeros(len(text), bool)
        left = np.frombuffer(text, np.uint8)[~gone].tobytes() if places is not None else text
        return (doc_id, len(text), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest(), *([left] if keep_text else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_by_size(rows_of(batches, "k", "places", "copy", "text"), lambda r: len(r[3] or b"") + 64, 4 << 20):
            rows = [one(*r) for r in group]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return joined.select("k", "places", "copy", "text").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else ""))
