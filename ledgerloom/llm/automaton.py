"""Suffix automata over word numbers."""

from __future__ import annotations

import numpy as np


class SuffixAutomaton:
    """All substrings of several weighted sequences, with how often each occurs.

    States are kept in parallel lists; ``count`` is the weight of a state's end
    positions after ``finish``.
    """

    def __init__(self) -> None:
        self.next, self.link, self.length, self.count = [{}], [-1], [0], [0]

    def add(self, sequence: list[int], weight: int) -> None:
        """Adds one sequence; sequences are kept apart by beginning at the root again."""
        last = 0
        for symbol in sequence:
            last = self._extend(last, symbol)
            self.count[last] += weight

    def _extend(self, last: int, symbol: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(symbol)
        if known is not None:  # another sequence came this way
            if length[known] == length[last] + 1:
                return known
            return self._clone(last, symbol, known)
        state = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        self.count.append(0)
        at = last
        while at >= 0 and symbol not in nxt[at]:
            nxt[at][symbol] = state
            at = link[at]
        if at >= 0:
            target = nxt[at][symbol]
            link[state] = target if length[target] == length[at] + 1 else self._clone(at, symbol, target)
        return state

    def _clone(self, at: int, symbol: int, target: int) -> int:
        copy = len(self.length)
        self.next.append(dict(self.next[target]))
        self.link.append(self.link[target])
        self.length.append(self.length[at] + 1)
        self.count.append(0)
        self.link[target] = copy
        while at >= 0 and self.next[at].get(symbol) == target:
            self.next[at][symbol] = copy
            at = self.link[at]
        return copy

    def finish(self) -> None:
        """Carries the counts from longer to shorter substrings."""
        for state in np.argsort(-np.array(self.length), kind="stable").tolist():
            if self.link[state] >= 0:
                self.count[self.link[state]] += self.count[state]

    def occurrences(self, sequence: list[int], window: int) -> list[int]:
        """For each window of the sequence, how often its words occur in the sequences added.

        Streams the sequence and keeps the longest match that ends at each
        word, shortened to the window.
        """
        nxt, link, length, count = self.next, self.link, self.length, self.count
        state, size, out = 0, 0, []
        for i, symbol in enumerate(sequence):
            while state and symbol not in nxt[state]:
                state = link[state]
                size = length[state]
            state = nxt[state].get(symbol, -1)
            if state < 0:
                state, size = 0, 0
            else:
                size += 1
            while state and length[link[state]] >= window:
                state = link[state]
            size = min(size, length[state])
            if i >= window - 1:
                out.append(count[state] if size >= window else 0)
        return out
