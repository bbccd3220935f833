"""Cutting text at places where no pre-token can cross, for caches in front of a tokenizer.

A chunk is a run of non-space characters with the single space before it, or a
piece of white space.  The byte-level pre-token pattern never crosses these
borders, so the ids of a text are those of its chunks, one after another.
"""

from __future__ import annotations

import re

#: Characters with the Unicode property White_Space (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Fast cutting needs single spaces and line feeds as the only white space.
ODD = [c for c in WHITE if c not in " \n"] + ["\0", "  ", " \n", "\n ", "\n\n"]
RUN = re.compile(f"[{WHITE}]+")
WHITE_ODD = [c for c in WHITE if not c.isascii()] + ["\x1c", "\x1d", "\x1e", "\x1f"]


def is_odd(text: str) -> bool:
    """Whether the text has white space other than single spaces and line feeds between other characters."""
    return text[:1] in (" ", "\n") or text[-1:] in (" ", "\n") or any(c in text for c in ODD)


def chunks(text: str) -> list[str]:
    if not text:
        return []
    if is_odd(text):
        return CHUNK.findall(text)
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")


def spaced(text: str) -> list[str]:
    """Runs of characters other than White_Space."""
    if any(c in text for c in WHITE_ODD):
        return [c for c in RUN.split(text) if c]
    return text.split()


class Cache:
    """A bounded map from chunk to result; fill(list of new chunks) gives their results.

    Chunks met after it is full are worked out again for each batch.  The bound
    is on entries and on the length of what is kept.
    """

    def __init__(self, fill, entries: int = 350_000, longest: int = 64) -> None:
        self.fill, self.entries, self.longest = fill, entries, longest
        self.kept: dict = {}
        self.passing: list = []

    def of(self, lists: list[list[str]]):
        """Look-up that holds every chunk of the lists, until the next call."""
        kept = self.kept
        for c in self.passing:
            del kept[c]
        new = list(set().union(*lists).difference(kept))
        room = max(self.entries - len(kept), 0)
        self.passing = [c for c in new[:room] if len(c) > self.longest] + new[room:]
        if new:
            kept.update(zip(new, self.fill(new), strict=True))
        return kept.__getitem__
