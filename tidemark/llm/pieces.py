"""Split text where a byte-level BPE tokenizer always splits it, and remember pieces.

A single space before a non-space character starts a new pre-token whatever
stands before it, so the text between two such spaces is encoded alone. Pieces
repeat a lot; a bounded two-generation memory keeps what they encode to.
"""

from __future__ import annotations

import re

_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?!\S)")
#: The same for Arrow, whose patterns look at nothing ahead and know ASCII blanks only.
ODD = r" ([\x{0009}-\x{000d}\x{001c}-\x{0020}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)"


def cut(text: str) -> list[str]:
    """Pieces that join to ``text``; all but the first had a leading space, here left out."""
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


def runs(text: str, least: int):
    """Runs of ``text`` of ``least`` characters or a little more, each but the first from a place where ``cut`` cuts on."""
    if len(text) <= 2 * least:
        yield text
        return
    at = 0
    while at < len(text):
        found = _CUT.search(text, at + least) if at + least < len(text) else None
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


class Memory(dict):
    """piece -> value, of at most 2 x ``size`` short pieces; ``make`` gives missing ones."""

    LONG = 64

    def __init__(self, make, size: int = 300_000):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        if len(key) > self.LONG:
            return self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


#: Ends of a word that are tokens' starts for sure: they can't share a pre-token with letters.
_ENDS = frozenset(",.!?;:")


class Pieces:
    """What pieces encode to. ``encode`` takes text; ``join`` puts results together.

    A word with one mark behind it, and lines in a piece, are put together from
    their parts, so that only words themselves are encoded. Both splits are at
    places where pre-tokens end: between letters and a mark at the end, and
    around a single line end between non-blanks.
    """

    def __init__(self, encode, join):
        self.encode, self.join, self.line = encode, join, encode("\n")
        self.mark = {c: encode(c) for c in _ENDS}
        self.head, self.tail = Memory(lambda p: self._make(p, self.head, ""), 60_000), Memory(lambda p: self._make(p, self.tail, " "))

    def _make(self, piece: str, own: Memory, before: str):
        if piece[-1:] in self.mark and piece[:-1].isalpha():
            return self.join(own[piece[:-1]], self.mark[piece[-1]])
        a, line, b = piece.partition("\n")
        if line and a and b and (a[-1].isalnum() or a[-1] in _ENDS) and b[0].isalnum():
            return self.join(own[a], self.line, self.head[b])
        return self.encode(before + piece)
