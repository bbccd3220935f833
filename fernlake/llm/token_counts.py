"""Token counts of a unigram model, by a trie that shares the scores of prefixes.

The model gives every vocabulary token a cost that rises with its rank; a
pre-token is cut into the tokens of least total cost, and of those cuts the one
with fewest tokens.  Distinct pre-tokens are inserted into a trie.  The forward
score of a node - least cost and fewest tokens of the path to it - is worked
out once for all pre-tokens that share the prefix; the count at a terminal node
serves every occurrence.

Costs are integers, so results don't depend on the order of the work.  Null and
empty texts count no tokens.  Whole texts are counted, repeated rows each.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlake.llm.chunks import Cache, chunks
from fernlake.llm.common import groups_by_size, rows_of

#: A forward score is cost << COUNT_BITS | tokens.
COUNT_BITS = 40
#: No path to a node yet; one pre-token, in a number above cost and tokens.
WORST = 1 << 100
ONE = 1 << 112
GROUP_BYTES = 4 << 20


def unigram_costs(rank_file: str) -> dict[bytes, int]:
    """A Zipf model of a rank file: cost 1000 log2(rank + 2), rounded."""
    with open(rank_file, "rb") as file:
        ranks = (line.split() for line in file if line.strip())
        return {base64.b64decode(token): round(1000 * math.log2(int(rank) + 2)) for token, rank in ranks}


class PrefixTrie:
    """Trie of byte strings with a forward score at each node, walked along one branch.

    Words are best given in order: all that a word shares with earlier ones then
    lies on the branch of the word before.  An automaton of the tokens (Aho-Corasick)
    names, for each new node, just the tokens that end there.
    """

    def __init__(self, costs: dict[bytes, int]) -> None:
        self.longest = max(map(len, costs), default=0)
        if any(bytes([b]) not in costs for b in range(256)):
            raise ValueError("every single byte needs a cost")
        self.tokens = ahocorasick.Automaton()
        for token, cost in costs.items():
            if token:
                self.tokens.add_word(token.decode("latin-1"), (len(token) - 1, cost << COUNT_BITS | 1))
        self.tokens.make_automaton()
        self.forward: dict[bytes, int] = {}
        self.branch, self.path = b"", [0]
        self.scored = 0

    def terminal(self, word: bytes) -> int:
        """The score at the word's node; nodes missing on the way are inserted."""
        known = self.forward.get(word)
        if known is not None:
            return known
        shared = 0
        for x, y in zip(self.branch, word, strict=False):
            if x != y:
                break
            shared += 1
        # path[d] is the score of the prefix of d bytes; a new node's is the least over the tokens that end at it.
        path = self.path
        del path[shared + 1 :]
        path += [WORST] * (len(word) - shared)
        for end, (before, step) in self.tokens.iter(word.decode("latin-1"), max(0, shared + 1 - self.longest)):
            if end >= shared:
                score = path[end - before] + step
                if score < path[end + 1]:
                    path[end + 1] = score
        self.branch = word
        self.scored += len(word) - shared
        self.forward[word] = path[-1]
        return path[-1]


class Counter:
    def __init__(self, rank_file: str, pattern: str, entries: int = 400_000) -> None:
        self.trie = PrefixTrie(unigram_costs(rank_file))
        self.pattern = regex.compile(pattern)
        self.cache = Cache(self._fill, entries)

    def _fill(self, new: list[str]) -> list[int]:
        """Pre-tokens, cost and tokens of each chunk, as one number."""
        pieces = [[p.encode() for p in self.pattern.findall(c)] for c in new]
        trie, scores = self.trie, {}
        # In order, prefixes are shared by neighbours.
        for word in sorted({p for row in pieces for p in row}):
            scores[word] = trie.terminal(word)
        trie.forward.clear()
        return [ONE + scores[row[0]] if len(row) == 1 else len(row) * ONE + sum([scores[p] for p in row]) for row in pieces]

    def count_batch(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(pre-tokens, tokens, cost) of each text."""
        rows = [chunks(t) for t in texts]
        known = self.cache.of(rows)
        totals = [sum(map(known, row)) for row in rows]
        return [(t // ONE, t & (1 << COUNT_BITS) - 1, t % ONE >> COUNT_BITS) for t in totals]


@lru_cache(maxsize=2)
def counter(rank_file: str, pattern: str) -> Counter:
    return Counter(rank_file, pattern)


def token_counts(docs: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens and cost (of the best cut) of each document."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_pretokens", "n_tokens", "cost")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(rank_file, pattern)
        for group in groups_by_size(rows_of(batches, "doc_id", "text"), lambda r: len(r[1] or b"") + 64, GROUP_BYTES):
            found = model.count_batch([(t or b"").decode() for _, t in group])
            yield pa.record_batch([pa.array([d for d, _ in group], pa.int64()), *(pa.array([f[i] for f in found], pa.int64()) for i in range(3))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, cost long")
