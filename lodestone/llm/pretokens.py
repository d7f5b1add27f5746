"""Cutting texts for the byte-level BPE tokenizer.

A space between two characters that aren't white space always begins a word of the tokenizer's
pattern, so a text may be cut before each such space and the pieces encoded on their own. Pieces
recur, so what a worker learns about them is remembered (bounded).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import regex

_TWO_SPACES = re.compile(r"\s\s")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")

# Fixed value: the pattern of the byte-level vocabulary's words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def cut(text: str) -> list[str]:
    """Pieces of the text; all but the first have lost one leading space."""
    return text.split(" ") if not _TWO_SPACES.search(text) else _LONE_SPACE.split(text)


class PieceMemory:
    """Values of pieces, each computed once; forgets all when it is full."""

    def __init__(self, compute: Callable[[list[str]], Iterable], most: int):
        self.compute, self.most = compute, most
        self.first: dict[str, object] = {}
        self.later: dict[str, object] = {}

    def values(self, texts: list[str]) -> list[list]:
        """For each text the values of its pieces."""
        pieces = [cut(t) for t in texts]
        heads = {p[0] for p in pieces} - self.first.keys()
        tails = set().union(*(p[1:] for p in pieces)) - self.later.keys()
        if len(self.first) + len(self.later) + len(heads) + len(tails) > self.most:
            self.first, self.later = {}, {}
            heads = {p[0] for p in pieces}
            tails = set().union(*(p[1:] for p in pieces))
        heads, tails = list(heads), list(tails)
        found = list(self.compute(heads + [" " + t for t in tails]))
        self.first.update(zip(heads, found[: len(heads)], strict=True))
        self.later.update(zip(tails, found[len(heads) :], strict=True))
        later = self.later.__getitem__
        return [[self.first[p[0]], *map(later, p[1:])] for p in pieces]
