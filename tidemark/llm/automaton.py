"""Suffix automaton over word sequences, with the least document of every state."""

from __future__ import annotations


class SuffixAutomaton:
    """Sequences are added in ascending order of their document, so a state's first document is its least."""

    def __init__(self):
        self.size, self.link, self.next, self.least = [0], [-1], [{}], [-1]
        self.symbols = 0

    def _state(self, size: int, link: int, step: dict, least: int) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(step)
        self.least.append(least)
        return len(self.size) - 1

    def _split(self, p: int, word, q: int) -> int:
        """A state for the strings of q that end p's longest string plus word."""
        copy = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]), self.least[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words, least: int) -> None:
        at = 0
        for word in words:
            self.symbols += 1
            q = self.next[at].get(word)
            if q is not None:
                at = q if self.size[q] == self.size[at] + 1 else self._split(at, word, q)
                continue
            new = self._state(self.size[at] + 1, 0, {}, least)
            p = at
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, word, q)
            at = new

    def least_of_windows(self, words, width: int) -> list:
        """For each end place from width - 1 on: the least document with that window, None if no document has it.

        The matching statistic at a place is the length of the longest match that ends there; while it
        is at least `width`, suffix links lead to the state that holds the window itself.
        """
        out, at, length = [], 0, 0
        for i, word in enumerate(words):
            while at and word not in self.next[at]:
                at = self.link[at]
                length = self.size[at]
            q = self.next[at].get(word)
            if q is not None:
                at, length = q, length + 1
            if i >= width - 1:
                if length < width:
                    out.append(None)
                    continue
                while self.size[self.link[at]] >= width:
                    at = self.link[at]
                    length = self.size[at]
                out.append(self.least[at])
        return out
