"""Encoders and token files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fernlake.llm import bpe, huffman, token_counts
from fernlake.llm.queries import PATTERN


@pytest.fixture(scope="module")
def word_library(tokenizers_dir):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(f"{tokenizers_dir}/word_bpe_49k.json")


@pytest.fixture(scope="module")
def byte_library(tokenizers_dir):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(f"{tokenizers_dir}/byte_bpe_50k.json")


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_bpe_documents(docs, rows, word_library, tokenizers_dir):
    found = bpe.encoded(docs, f"{tokenizers_dir}/word_bpe_49k.json").collect()
    expected = []
    for doc_id, text, *_ in rows:
        ids = ids_of(word_library, text)
        decoded = word_library.decode(ids, skip_special_tokens=False)
        expected.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


def test_bpe_keeps_ids(docs, tokenizers_dir):
    model = bpe.encoder(f"{tokenizers_dir}/word_bpe_49k.json")
    for r in bpe.encoded(docs, f"{tokenizers_dir}/word_bpe_49k.json", keep_ids=True).collect():
        assert model.decode(np.frombuffer(r["ids"], "<u4").tolist()) == r["decoded"]


def test_bpe_empty_table(no_docs, tokenizers_dir):
    assert bpe.encoded(no_docs, f"{tokenizers_dir}/word_bpe_49k.json").collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abeinorst 'sé\n\t.,<|>"), st.characters(codec="utf-8", exclude_categories=["Cn", "Co"])), max_size=40))
def test_bpe_any_text(text):
    from tokenizers import Tokenizer

    library = _cached("word", lambda: Tokenizer.from_file("/opt/tokenizers/word_bpe_49k.json"))
    ids, decoded = bpe.encoder("/opt/tokenizers/word_bpe_49k.json").encode(text)
    expected = ids_of(library, text)
    assert np.frombuffer(ids, "<u4").tolist() == expected
    assert decoded == library.decode(expected, skip_special_tokens=False)


_made: dict = {}


def _cached(name, make):
    if name not in _made:
        _made[name] = make()
    return _made[name]


def test_bpe_bounded_cache(tokenizers_dir, word_library):
    model = bpe.WordBpe(f"{tokenizers_dir}/word_bpe_49k.json", entries=2)
    for text in ("one two three four five", "six two one"):
        assert np.frombuffer(model.encode(text)[0], "<u4").tolist() == ids_of(word_library, text)
    assert len(model.chunks) == 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab's1?é<| \n\t\0\x85"), max_size=25), max_size=4))
def test_byte_bpe_any_text(texts):
    from tokenizers import Tokenizer

    library = _cached("byte", lambda: Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json"))
    model = huffman.tokenizer("/opt/tokenizers/byte_bpe_50k.json")
    assert [np.frombuffer(i, model.unit).tolist() for i in model.encode_batch(texts)] == [ids_of(library, t) for t in texts]


def test_token_files(docs, rows, byte_library, tokenizers_dir):
    found = huffman.token_files(docs, f"{tokenizers_dir}/byte_bpe_50k.json", end_id=2).collect()
    coded = sorted(((d, np.array([*ids_of(byte_library, t), 2], "<u4").tobytes()) for d, t, *_ in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    assert len(found) == len(coded)
    by_start = sorted(found, key=lambda r: r["start"])
    assert [r["doc_id"] for r in by_start] == [d for d, _ in coded]
    at = 0
    for r in by_start:
        assert r["start"] == at and zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in found) == sorted((str(d), i) for d, i in coded)


def test_token_files_empty_table(no_docs, tokenizers_dir):
    assert huffman.token_files(no_docs, f"{tokenizers_dir}/byte_bpe_50k.json").collect() == []


def test_code_lengths_are_optimal_and_limited():
    assert huffman.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]
    assert huffman.code_lengths(np.array([5, 5, 1, 1])).tolist() in ([1, 2, 3, 3], [2, 2, 2, 2], [2, 1, 3, 3])
    counts = np.array([2**i for i in range(30)])
    lengths = huffman.code_lengths(counts, 8)
    assert lengths.max() == 8 and sum(2.0 ** -lengths.astype(float)) == 1.0
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, np.int64), 3)


@pytest.mark.parametrize("n", [1, 511, 512, 513, 5000])
def test_pack_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.geometric(0.05, n).astype("<u4")
    lengths = huffman.code_lengths(np.bincount(ids))
    cut = sorted(rng.integers(0, n + 1, 3).tolist())
    parts = [ids[a:b].tobytes() for a, b in zip([0, *cut], [*cut, n], strict=True)]
    docs, counts, found = huffman.unpack(huffman.pack([(None, parts[0]), *enumerate(parts[1:])], lengths))
    assert docs == [None, 0, 1, 2] and counts.tolist() == [len(p) // 4 for p in parts] and found.tolist() == ids.tolist()


def best_cut(word: bytes, costs: dict[bytes, int]) -> tuple[int, int]:
    best = [(0, 0)]
    for d in range(1, len(word) + 1):
        best.append(min((best[s][0] + costs[word[s:d]], best[s][1] + 1) for s in range(d) if word[s:d] in costs))
    return best[-1]


def test_token_counts(docs, rows, tokenizers_dir):
    import regex

    file = f"{tokenizers_dir}/byte_bpe_50k.tiktoken"
    costs, pattern = token_counts.unigram_costs(file), regex.compile(PATTERN)
    expected = []
    for doc_id, text, *_ in rows:
        cuts = [best_cut(p.encode()[:4000], costs) for p in pattern.findall(text or "")]
        expected.append((doc_id, len(cuts), sum(n for _, n in cuts), sum(c for c, _ in cuts)))
    assert sorted(map(tuple, token_counts.token_counts(docs, file, PATTERN).collect()), key=str) == sorted(expected, key=str)


def test_token_counts_empty_table(no_docs, tokenizers_dir):
    assert token_counts.token_counts(no_docs, f"{tokenizers_dir}/byte_bpe_50k.tiktoken", PATTERN).collect() == []


def test_trie_shares_prefixes(tokenizers_dir):
    trie = token_counts.PrefixTrie(token_counts.unigram_costs(f"{tokenizers_dir}/byte_bpe_50k.tiktoken"))
    for word in (b"prefix", b"prefixed", b"prefer", b"prefix"):
        trie.terminal(word)
    assert trie.scored == len(b"prefix") + len(b"ed") + len(b"er")


def test_unigram_agrees_with_library(tokenizers_dir):
    """The library's Unigram model finds cuts of the same total score."""
    from tokenizers import Tokenizer, models

    costs = {t: c for t, c in token_counts.unigram_costs(f"{tokenizers_dir}/byte_bpe_50k.tiktoken").items() if t.isascii()}
    names = {t.decode(): c for t, c in costs.items()}
    library = Tokenizer(models.Unigram([(t, -float(c)) for t, c in names.items()], unk_id=None))
    rng = random.Random(3)
    for _ in range(200):
        word = "".join(rng.choice("aeinorstlhd") for _ in range(rng.randrange(1, 15)))
        assert sum(names[t] for t in library.encode(word).tokens) == best_cut(word.encode(), costs)[0]


def test_trie_looks_only_at_tokens_that_end_at_a_node(tokenizers_dir):
    costs = token_counts.unigram_costs(f"{tokenizers_dir}/byte_bpe_50k.tiktoken")
    trie = token_counts.PrefixTrie(costs)
    words = [b"walking", b"walked", b"a" * 300, b"walk", "été".encode(), bytes(range(256)), b"walker", b"b"]
    for word in words:
        found = trie.terminal(word)
        assert (found >> token_counts.COUNT_BITS, found & (1 << token_counts.COUNT_BITS) - 1) == best_cut(word, costs)
        assert trie.branch == word and len(trie.path) == len(word) + 1


def test_bpe_caches_hold_ids_alone(tokenizers_dir, word_library):
    model = bpe.WordBpe(f"{tokenizers_dir}/word_bpe_49k.json")
    text = "Cached words, and <|endoftext|> cached again"
    ids, decoded = model.encode(text)
    expected = ids_of(word_library, text)
    assert np.frombuffer(ids, "<u4").tolist() == expected and decoded == word_library.decode(expected, skip_special_tokens=False)
    assert model.chunks and all(type(v) is bytes for v in [*model.chunks.values(), *model.pieces.values()])


def test_token_files_without_ids(docs, tokenizers_dir):
    path = f"{tokenizers_dir}/byte_bpe_50k.json"
    whole = huffman.token_files(docs, path).drop("ids")
    bare = huffman.token_files(docs, path, keep_ids=False)
    assert bare.columns == whole.columns and sorted(map(tuple, bare.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_pack_in_parts(monkeypatch):
    ids = np.random.default_rng(1).geometric(0.01, 5000).astype("<u2")
    lengths = huffman.code_lengths(np.bincount(ids))
    whole = huffman.pack([(1, ids.tobytes())], lengths, "<u2")
    monkeypatch.setattr(huffman, "PACKED_IDS", huffman.BLOCK)
    assert huffman.pack([(1, ids.tobytes())], lengths, "<u2") == whole
    assert huffman.unpack(whole)[2].tolist() == ids.tolist()
