"""Suffix automaton over several token sequences, with the least value of the sequences that hold each string."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Iterator


class SuffixAutomaton:
    """States stand for sets of strings with the same ends; following a token leads from string to longer string."""

    def __init__(self):
        self.go: list[dict[Hashable, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [None]

    def _state(self, length: int, go: dict, link: int) -> int:
        self.go.append(go)
        self.length.append(length)
        self.link.append(link)
        self.least.append(None)
        return len(self.go) - 1

    def _split(self, p: int, q: int, token: Hashable) -> int:
        """A state for the strings that reach ``q`` from ``p`` on, where ``q`` also stands for longer ones."""
        new = self._state(self.length[p] + 1, dict(self.go[q]), self.link[q])
        self.link[q] = new
        while p >= 0 and self.go[p].get(token) == q:
            self.go[p][token] = new
            p = self.link[p]
        return new

    def add(self, tokens: Iterable[Hashable], value) -> None:
        """One more sequence; ``value`` is kept at its strings where it is the least."""
        last, go, link, length, least = 0, self.go, self.link, self.length, self.least
        for t in tokens:
            q = go[last].get(t)
            if q is not None:       # an earlier sequence has this string
                last = q if length[q] == length[last] + 1 else self._split(last, q, t)
            else:
                new, p = self._state(length[last] + 1, {}, 0), last
                while p >= 0 and t not in go[p]:
                    go[p][t] = new
                    p = link[p]
                if p >= 0:
                    q = go[p][t]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, q, t)
                last = new
            if least[last] is None or value < least[last]:
                least[last] = value

    def finish(self) -> None:
        """Hand values on from strings to their suffixes."""
        link, least = self.link, self.least
        for v in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            p = link[v]
            if least[v] is not None and p > 0 and (least[p] is None or least[v] < least[p]):
                least[p] = least[v]

    def statistics(self, tokens: Iterable[Hashable]) -> Iterator[tuple[int, int]]:
        """After each token: the length of the longest string ending there that the automaton holds, and its state."""
        v, l = 0, 0
        for t in tokens:
            while v and t not in self.go[v]:
                v = self.link[v]
                l = self.length[v]
            if t in self.go[v]:
                v, l = self.go[v][t], l + 1
            yield l, v

    def least_of(self, state: int, size: int):
        """Least value of the sequences that hold the last ``size`` tokens of a string of ``state``."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return self.least[state]
