"""Cutting texts before blanks, and remembering what was worked out for a piece."""

from __future__ import annotations

import re

#: A blank after white space, before which no cut is made.
_TORN = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


def cut_pieces(text: str) -> list[str]:
    """The text cut before every blank that follows a character that is not white space.
    Vocabularies that split at blanks never join tokens over such a cut, whatever follows it."""
    if "\0" in text or _TORN.search(text):
        return _CUT.split(text)
    return text.replace(" ", "\0 ").split("\0")


class Memory(dict):
    """What ``work(key)`` gives, kept in two generations of bounded size: when the young one is full
    it becomes the old one, so keys in use stay. Keys longer than ``longest`` are worked out anew."""

    def __init__(self, work, size: int, longest: int = 200):
        super().__init__()
        self.work, self.size, self.longest, self.old = work, size, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.work(key)
        if len(key) <= self.longest:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
