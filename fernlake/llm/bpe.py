"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

Every prefix of a pre-token has one last token that merging by rank can leave
there: a vocabulary token that ends at the prefix, matched by an automaton
of the vocabulary with suffix links (Aho-Corasick), whose pair with the last
token of the rest is compatible.  Two tokens are compatible if no merge joins a token on the right edge of the first
with one on the left edge of the second before either edge is itself merged
away.  Back-pointers from the whole pre-token then spell its ids.

Nulls are empty texts; empty texts have no ids.  Texts are encoded whole, a very
long one as a group by itself.  Repeated rows give repeated rows.  An empty table
gives no row.  Columns other than doc_id and text are not read, so names that
clash do no harm.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlake.llm.chunks import spaced
from fernlake.llm.common import groups_by_size, rows_of

#: Ends a pre-token; the vocabulary's word-end tokens end with it.
END = "\U0010ffff"
GROUP_BYTES = 4 << 20


class Kept(dict):
    """Results by key, worked out at the first look-up; the bound is on entries and on the length of keys kept."""

    def __init__(self, work, entries: int, longest: int = 64) -> None:
        self.work, self.entries, self.longest = work, entries, longest

    def __missing__(self, key: str):
        found = self.work(key)
        if len(self) < self.entries and len(key) <= self.longest:
            self[key] = found
        return found


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """The encoder of a tokenizer file of kind BPE with word ends."""

    def __init__(self, path: str, entries: int = 200_000) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in special.items()}
        self.cut_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        #: Without lookaround the pattern takes a piece by itself as one piece again, so what is kept of it as a chunk serves.
        self.alone = "(?" not in split["pattern"]["Regex"]
        self.letters = byte_letters()
        #: rank of a pair of ids; what parts an id was merged from, and at which rank an edge goes.
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.rank.setdefault((a, b), rank)
            self.parts.setdefault(whole, (a, b, rank))
        self.edges: dict[tuple[int, bool], tuple] = {}
        self.fits: dict[int, bool] = {}
        self.stands: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            if token not in special and self.whole(i):
                form = token.removesuffix(self.suffix) + END if token.endswith(self.suffix) else token
                self.automaton.add_word(form, (len(form), i))
        self.automaton.make_automaton()
        self.pieces = Kept(self._piece, entries // 2)
        self.chunks = Kept(self._chunk, entries + entries // 4)

    def edge(self, token: int, right: bool) -> tuple:
        """(edge token, rank of the merge that takes it away) from the token inwards."""
        if (token, right) not in self.edges:
            found, taken, x = [], sys.maxsize, token
            while True:
                found.append((x, taken))
                if x not in self.parts:
                    break
                a, b, taken = self.parts[x]
                x = b if right else a
            self.edges[token, right] = tuple(found)
        return self.edges[token, right]

    def compatible(self, a: int, b: int) -> bool:
        rank = self.rank
        # Equal ranks: the pair more to the left merges first.
        fits = not any((r := rank.get((x, y))) is not None and r < gone_x and r <= gone_y for x, gone_x in self.edge(a, True) for y, gone_y in self.edge(b, False))
        if len(self.fits) < 1_000_000:
            self.fits[a << 20 | b] = fits
        return fits

    def whole(self, token: int) -> bool:
        """Whether merging the token's own letters gives back the token."""
        known = self.stands.get(token)
        if known is None:
            if token in self.parts:
                a, b, rank = self.parts[token]
                known = self.whole(a) and self.whole(b) and self._joins(a, b, rank)
            else:
                known = True
            self.stands[token] = known
        return known

    def _joins(self, a: int, b: int, rank: int) -> bool:
        """No earlier merge crosses the border of a and b."""
        return not any(
            (r := self.rank.get((x, y))) is not None and r < min(gone_x, rank + 1) and r <= min(gone_y, rank) and (x, y) != (a, b)
            for x, gone_x in self.edge(a, True)
            for y, gone_y in self.edge(b, False)
        )

    def word(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        letters = self.letters
        form = "".join([letters[b] for b in piece.encode()]) + END
        last: list[int | None] = [None] * (len(form) + 1)
        size = last.copy()
        fits = self.fits.get
        for at, (n, token) in self.automaton.iter(form):
            end = at + 1
            if last[end] is None:
                if n <= at:
                    before = last[end - n]
                    if before is None:
                        continue
                    known = fits(before << 20 | token)
                    if not (self.compatible(before, token) if known is None else known):
                        continue
                last[end], size[end] = token, n
        ids, end = [], len(form)
        while end:
            token = last[end]
            if token is None:
                raise ValueError(f"no segmentation of {piece!r}")
            ids.append(token)
            end -= size[end]
        return ids[::-1]

    def _piece(self, piece: str) -> bytes:
        return le32(self.word(piece))

    def _chunk(self, chunk: str) -> bytes:
        if chunk in self.special:
            return le32([self.special[chunk]])
        cut = self.pattern.findall(chunk)
        if len(cut) == 1:  # kept as a chunk; room among the pieces is for parts of chunks
            return self.pieces.get(cut[0]) or self._piece(cut[0])
        known = self.chunks.get if self.alone else {}.get
        return b"".join([known(piece) or self.pieces[piece] for piece in cut])

    def normalise(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # letter by letter: no final sigma

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids (little-endian, 32 bits) and the decoded text."""
        if "<|" in text and self.cut_special.search(text):
            row = []
            for part in self.cut_special.split(text):
                row += [part] if part in self.special else spaced(self.normalise(part))
        else:
            row = spaced(self.normalise(text))
        ids = b"".join(map(self.chunks.__getitem__, row))
        return ids, self.decode(from32(ids))

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens joined by spaces: the file names no decoder."""
        return " ".join(map(self.names.__getitem__, ids))


def le32(ids: list[int]) -> bytes:
    held = array("I", ids)
    if sys.byteorder == "big":
        held.byteswap()
    return held.tobytes()


def from32(raw: bytes) -> array:
    held = array("I", raw)
    if sys.byteorder == "big":
        held.byteswap()
    return held


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    return WordBpe(path)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoded(docs: DataFrame, path: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row a document: doc_id, n_tokens, sha256 of the ids and of the decoded text, and with keep_ids the ids and that text."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + ([("ids", pa.binary()), ("decoded", pa.string())] if keep_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for group in groups_by_size(rows_of(batches, "doc_id", "text"), lambda r: len(r[1] or b"") + 64, GROUP_BYTES):
            found = [model.encode((t or b"").decode()) for _, t in group]
            columns = [[d for d, _ in group], [len(i) // 4 for i, _ in found], [hashlib.sha256(i).hexdigest() for i, _ in found], [hashlib.sha256(s.encode()).hexdigest() for _, s in found]]
            if keep_ids:
                columns += [[i for i, _ in found], [s for _, s in found]]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA + (", ids binary, decoded string" if keep_ids else ""))
