"""Duplicate finders against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from fernlake.llm import components, simhash, substring_dedup, suffix_dedup, windows


def in_order(rows, spark):
    """Distinct documents in the order of the contracts: doc_id, nulls first, then the hash of the text."""
    from pyspark.sql import functions as F

    texts = spark.createDataFrame([(t,) for _, t, *_ in rows], "text string").select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct().collect()
    hashes = {r["text"]: r["h"] for r in texts}
    return sorted({(d, t) for d, t, *_ in rows}, key=lambda x: (x[0] is not None, x[0] or 0, hashes[x[1]]))


def brute(ordered, width, split, join):
    """For each document, which of its units are covered by windows that start earlier too."""
    seen, out = set(), {}
    for doc in ordered:
        units = split(doc[1])
        gone = [False] * len(units)
        for i in range(len(units) - width + 1):
            w = join(units[i : i + width])
            if w in seen:
                gone[i : i + width] = [True] * width
            seen.add(w)
        out[doc] = (units, gone)
    return out


def test_substrings(spark, docs, rows):
    expected = brute(in_order(rows, spark), 20, lambda t: (t or "").encode().split(), tuple)
    want = []
    for doc_id, text, *_ in rows:
        words, gone = expected[doc_id, text]
        left = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        want.append((doc_id, len(words), sum(gone), hashlib.sha256(left).hexdigest()))
    found = substring_dedup.removals(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert sum(w[2] for w in want) > 100


def test_substrings_applied(spark, docs, rows):
    out = substring_dedup.applied(docs)
    assert out.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in out.where("doc_id is not null and doc_id <> 20").collect()}
    assert kept[1] == rows[0][1] and kept[4] is None and 8 not in kept and 6 not in kept
    assert kept[5] == "  \t\n "


def test_cut_keeps_other_text():
    gone = np.array([False, True, True, False, True])
    assert substring_dedup.cut(b" a  b\nc\n\nd e ", gone) == b" a  d "


@pytest.mark.parametrize("seed", range(3))
def test_substrings_random(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(40)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = brute(rows, 5, lambda t: t.split(), tuple)
    found = {r["doc_id"]: r["n_removed"] for r in substring_dedup.removals(df, 5).collect()}
    assert found == {d[0]: sum(g) for d, (_, g) in expected.items()}


def test_suffixes(spark, docs, rows):
    expected = brute(in_order(rows, spark), 100, lambda t: (t or "").encode(), bytes)
    want = []
    for doc_id, text, *_ in rows:
        data, gone = expected[doc_id, text]
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        want.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    found = suffix_dedup.removals(docs).collect()
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert sum(w[2] for w in want) > 1000


@pytest.mark.parametrize("seed", range(3))
def test_suffixes_random(spark, seed, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD", 64)  # many shards
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice("aab") for _ in range(rng.randrange(60)))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = brute(rows, 10, lambda t: t.encode(), bytes)
    found = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.removals(df, 10).collect()}
    assert found == {d[0]: sum(g) for d, (_, g) in expected.items()}


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice("abcd") for _ in range(3000))
    rows = [(1, text), (2, text[500:900] + "zz" + text[100:1700])]
    monkeypatch.setattr(suffix_dedup, "PIECE", 256)
    at = list(suffix_dedup.pieces(iter([(1, 0, text.encode())]), 100))
    assert b"".join(p[3][: 256] for p in at[:-1]) + at[-1][3] == text.encode()
    found = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string"), 100).collect()}
    assert found == {1: 0, 2: 2000}


def test_merged_transforms_group_equal_strings():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12, 30))) for _ in range(40)]
    owner, offset, block = suffix_dedup.equal_strings(texts, 8)
    groups: dict = {}
    for o, i, b in zip(owner.tolist(), offset.tolist(), block.tolist(), strict=True):
        groups.setdefault(b, set()).add(texts[o][i : i + 8])
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len({t[i : i + 8] for t in texts for i in range(len(t) - 7)})
    assert len(owner) == sum(len(t) - 7 for t in texts)


def test_rolling_hash():
    units = np.arange(50, dtype=np.uint64) % np.uint64(7)
    hashes = windows.rolling(units, 20)
    assert len(hashes) == 31 and len(set(hashes.tolist())) == 7 and hashes[0] == hashes[7]
    assert len(windows.rolling(units[:5], 20)) == 0


def test_blobs_round_trip():
    rng = np.random.default_rng(0)
    k, c, p = np.sort(rng.integers(-(2**62), 2**62, 100)), rng.integers(0, 3, 100), rng.integers(0, 2**50, 100)
    h = rng.integers(0, 2**63, 100).astype(np.uint64)
    for a, b in zip(windows.unpack(windows.pack(k, c, p, h)), (k, c, p, h), strict=True):
        assert (a == b).all()


@pytest.mark.parametrize("operator", [lambda d: substring_dedup.removals(d), lambda d: suffix_dedup.removals(d), lambda d: simhash.near_groups(d)])
def test_empty_tables(no_docs, operator):
    assert operator(no_docs).collect() == []


def prints_of(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def grouped(values: dict[int, int], radius: int = 2) -> dict[int, int]:
    """fingerprint -> least doc_id of its component, by comparing all."""
    todo, out = set(values), {}
    while todo:
        stack, members = [todo.pop()], set()
        while stack:
            x = stack.pop()
            members.add(x)
            near = {y for y in todo if (x ^ y).bit_count() <= radius}
            todo -= near
            stack += near
        least = min((values[m] for m in members if values[m] is not None), default=None)
        out |= dict.fromkeys(members, least)
    return out


def test_simhash(docs, rows):
    prints = [(d, prints_of(t)) for d, t, *_ in rows]
    least: dict = {}
    for d, f in prints:
        least[f] = d if least.get(f) is None else min(least[f], d) if d is not None else least[f]
    component = grouped(least)
    want = [(d, f"{f:016x}", component[f]) for d, f in prints]
    assert sorted(map(tuple, simhash.near_groups(docs).collect()), key=str) == sorted(want, key=str)


def test_simhash_links_connect_all_within_two_bits(spark):
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    values = {centre}
    for _ in range(60):
        x = rng.choice(sorted(values))
        for _ in range(rng.randrange(1, 3)):
            x ^= 1 << rng.randrange(64)
        values.add(x)
    values |= {rng.getrandbits(64) for _ in range(40)} | {0, 1, 1 << 63, (1 << 63) | 1}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = simhash.links(spark.createDataFrame([(signed(v),) for v in values], "fp long"))
    labels = {r["node"]: r["label"] for r in components.components(found).collect()}
    component = grouped({v: signed(v) for v in values})
    for v in values:
        members = [signed(w) for w in values if component[w] == component[v]]
        assert labels.get(signed(v), signed(v)) == min(members)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 102)], "a long, b long")
    found = {r["node"]: r["label"] for r in components.components(links).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
    assert components.components(links.limit(0)).collect() == []


@pytest.mark.parametrize("words", [1, 1 << 18])
def test_without_keys(spark, monkeypatch, words):
    from fernlake.llm import common

    monkeypatch.setattr(common, "WORDS", words)  # one word: the bitmap soon is full, and the join decides alone
    ids = [*range(-70, 300), 2**62, -(2**63)]
    rows = spark.createDataFrame([(i, f"t{i}", i) for i in ids] + [(5, "again", 1)], "id long, text string, bitmap_word long")
    gone = [i for i in ids if i % 3 == 0] + [10**9]
    keys = common.materialise(spark.createDataFrame([(i,) for i in gone + gone[:2]], "id long"), "keys")
    kept = common.without_keys(rows, keys, "id")
    assert kept.columns == rows.columns
    assert sorted(map(tuple, kept.collect())) == sorted(t for t in map(tuple, rows.collect()) if t[0] not in gone)
    may, rest = common.parted(rows, keys, "id")
    assert {r["id"] for r in may.collect()} >= set(gone) & set(ids)
    assert may.count() + rest.count() == rows.count()
    assert common.without_keys(rows.limit(0), keys, "id").count() == 0
    none = common.materialise(keys.limit(0), "none")
    assert common.without_keys(rows, none, "id").count() == rows.count()


def test_settled_stretches_unpack_a_bounded_number_of_places(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PLACES", 10)
    stretches = [(i % 3, 0, 100 * i, 4) for i in range(9)] + [(7, 1, 5, 25)]
    sizes, spread = [], suffix_dedup.spread
    monkeypatch.setattr(suffix_dedup, "spread", lambda part: sizes.append(sum(s[3] for s in part)) or spread(part))
    k, c, p, _ = suffix_dedup.windows.unpack_all([blob for _, _, blob in suffix_dedup.settled_stretches(stretches, 4)])
    assert sorted(zip(k.tolist(), c.tolist(), p.tolist(), strict=True)) == sorted((a, b, s + i) for a, b, s, n in stretches for i in range(n))
    assert sizes == [8, 8, 8, 8, 4, 25]
