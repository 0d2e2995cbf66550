"""Many literals in one walk over a text, by an automaton that is built once a task."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick

from .intervals import IntervalSet

#: Blanks that may stand on either side of a line break where a literal has a space.
GAP = 8
_LINE = "\r\n"


def _edge(c: str) -> bool:
    return c.isascii() and c.isalnum()


def _fold(text: str) -> str:
    """Lower case, character by character, so places stay what they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(k if len(k := c.lower()) == 1 else c for c in text)


class Literals:
    """Literals to be found as they are written, or with case and line breaks folded.

    Where a literal begins or ends in an ASCII letter or digit, none may touch it there; other scripts are written
    without spaces and have no such edge.  ``wrapped`` lets each of a literal's spaces be any blanks, or none, with one
    line break among them at most.  Finding costs the text's length and what is found, however many literals there are.
    """

    def __init__(self, values: Iterable[str], fold_case: bool = False, wrapped: bool = False):
        self.values = list(values)
        self.fold_case, self.wrapped = fold_case, wrapped
        by_key: dict[str, list[int]] = {}
        for k, v in enumerate(self.values):
            if key := self._key(v):
                by_key.setdefault(key, []).append(k)
        self.machine = ahocorasick.Automaton() if by_key else None
        for key, own in by_key.items():
            self.machine.add_word(key, (len(key), own))
        if self.machine is not None:
            self.machine.make_automaton()

    def _key(self, text: str) -> str:
        text = _fold(text) if self.fold_case else text
        return "".join(text.split()) if self.wrapped else text

    def occurrences(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, number of the literal) of everything that reads like one, overlapping ones too, by their ends."""
        if self.machine is None or not text:
            return
        folded = _fold(text) if self.fold_case else text
        places, hits = None, self.machine.iter("".join(folded.split()) if self.wrapped else folded)
        if self.wrapped:
            if not (hits := list(hits)):  # most texts hold none: where its characters stand needn't be told
                return
            places = [i for i, c in enumerate(folded) if not c.isspace()]
        for last, (size, own) in hits:
            first = last - size + 1
            start, end = (first, last + 1) if places is None else (places[first], places[last] + 1)
            for k in own:
                if self._fits(text, start, end, self.values[k]):
                    yield start, end, k

    def _fits(self, text: str, start: int, end: int, value: str) -> bool:
        value = value.strip(" ") if self.wrapped else value
        if start and _edge(value[0]) and _edge(text[start - 1]) or end < len(text) and _edge(value[-1]) and _edge(text[end]):
            return False
        return not self.wrapped or gaps_fit(text[start:end], value) == len(value)

    def claimed(self, text: str, taken: IntervalSet) -> list[tuple[int, int, int]]:
        """Places that literals get: the first literal of the list before the next, each from left to right, where nothing is taken."""
        found: dict[int, list[tuple[int, int]]] = {}
        for start, end, k in self.occurrences(text):
            found.setdefault(k, []).append((start, end))
        out = []
        for k in sorted(found):
            behind = -1
            for start, end in sorted(found[k]):
                if start < behind:
                    continue
                behind = end
                if taken.claim(start, end):
                    out.append((start, end, k))
        return out


def gaps_fit(text: str, value: str) -> int:
    """How many characters of ``value`` the whole of ``text`` spells, case aside, its spaces as ``Literals`` lets them be; -1 if it doesn't."""
    i = at = 0
    while i < len(text):
        if at < len(value) and value[at] == " ":
            while at < len(value) and value[at] == " ":
                at += 1
            j = i
            while j < len(text) and text[j].isspace():
                j += 1
            if not _gap(text[i:j]):
                return -1
            if j == len(text):
                return at
            i = j
        if at >= len(value) or not (text[i] == value[at] or _fold(text[i]) == _fold(value[at])):
            return -1
        i, at = i + 1, at + 1
    return at


def _gap(blanks: str) -> bool:
    lines = blanks.replace("\r\n", "\n")
    if sum(c in _LINE for c in lines) > 1:
        return False
    return all(len(side) <= GAP for side in lines.replace("\r", "\n").split("\n"))


def combining_from(text: str) -> int:
    """Where the marks begin that a text ends with."""
    at = len(text)
    while at and unicodedata.combining(text[at - 1]):
        at -= 1
    return at
