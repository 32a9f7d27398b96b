"""Minimal acyclic transducer: words as byte paths, their number sequences as outputs along the way.

Words arrive sorted. While a word is added, the states behind the prefix it shares with the word before are finished: each is
looked up in a register by its arcs and outputs, so equal suffixes become one state. Outputs are pushed towards the start as
far as words share them. The result is flat arrays in one byte string, which workers map into memory.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterable

import numpy as np

BYTES = [bytes([i]) for i in range(256)]
HEADER = 5      # numbers of states, arcs, outputs; start state; length of labels


class _Draft:
    __slots__ = ("arcs", "final", "tail")

    def __init__(self):
        self.arcs: dict[int, list] = {}     # label → [target (draft or number), output]
        self.final, self.tail = False, ()


def _shared(a: tuple, b: tuple) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def build(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The transducer of (word, ids); words are distinct and ascending."""
    done: list[tuple] = []          # finished states: (final, tail, ((label, target, output), …))
    register: dict[tuple, int] = {}

    def finish(state: _Draft) -> int:
        key = (state.final, state.tail, tuple((c, t, o) for c, (t, o) in sorted(state.arcs.items())))
        if key not in register:
            register[key] = len(done)
            done.append(key)
        return register[key]

    path, before = [_Draft()], b""
    for word, ids in entries:
        if before and word <= before:
            raise ValueError("words must be distinct and ascending")
        keep = _shared(before, word)
        for i in range(len(before), keep, -1):
            path[i - 1].arcs[before[i - 1]][0] = finish(path[i])
        del path[keep + 1:]
        left = tuple(ids)
        for i in range(keep):       # leave on each shared arc what both words have, push the rest one state on
            arc = path[i].arcs[word[i]]
            n = _shared(arc[1], left)
            rest, arc[1], left = arc[1][n:], arc[1][:n], left[n:]
            if rest:
                node = path[i + 1]
                for other in node.arcs.values():
                    other[1] = rest + other[1]
                if node.final:
                    node.tail = rest + node.tail
        for c in word[keep:]:
            node = _Draft()
            path[-1].arcs[c] = [node, left]
            left = ()
            path.append(node)
        path[-1].final, path[-1].tail = True, left
        before = word
    for i in range(len(before), 0, -1):
        path[i - 1].arcs[before[i - 1]][0] = finish(path[i])
    start = finish(path[0])

    first, final, labels, target, out_at, outs = [0], [], bytearray(), [], [0], []
    tails_at, tails = [0], []
    for is_final, tail, arcs in done:
        for c, t, o in arcs:
            labels.append(c)
            target.append(t)
            outs.extend(o)
            out_at.append(len(outs))
        first.append(len(target))
        final.append(int(is_final))
        tails.extend(tail)
        tails_at.append(len(tails))
    head = np.array([len(done), len(target), len(outs), start, len(tails)], np.int32)
    numbers = [np.array(x, np.int32) for x in (first, final, target, out_at, outs, tails_at, tails)]
    return b"".join([head.tobytes(), *[a.tobytes() for a in numbers], bytes(labels)])


class Lexicon:
    """A built transducer, read from mapped memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.memory = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        states, arcs, outs, self.start, tails = np.frombuffer(self.memory, np.int32, HEADER).tolist()
        at = 4 * HEADER

        def numbers(n: int) -> memoryview:
            nonlocal at
            view = memoryview(self.memory)[at:at + 4 * n].cast("i")
            at += 4 * n
            return view

        self.first, self.final, self.target = numbers(states + 1), numbers(states), numbers(arcs)
        self.out_at, self.outs, self.tails_at, self.tails = numbers(arcs + 1), numbers(outs), numbers(states + 1), numbers(tails)
        self.labels_at = at
        # For many words at a time: arcs lie in order of (state, label); a final state's tail counts as one more arc, behind the real ones.
        first = np.frombuffer(self.first, np.int32)
        labels = np.frombuffer(self.memory, np.uint8, arcs, at)
        self._arcs = np.repeat(np.arange(states, dtype=np.int64), np.diff(first)) << 8 | labels
        out_at, tails_at = np.frombuffer(self.out_at, np.int32).astype(np.int64), np.frombuffer(self.tails_at, np.int32).astype(np.int64)
        self._begin = np.concatenate([out_at[:-1], tails_at[:-1] + outs])
        self._count = np.concatenate([np.diff(out_at), np.diff(tails_at)])
        self._out = np.concatenate([np.frombuffer(self.outs, np.int32), np.frombuffer(self.tails, np.int32)])
        self._target, self._final = np.frombuffer(self.target, np.int32), np.frombuffer(self.final, np.int32) > 0

    def get(self, word: bytes) -> list[int] | None:
        """The word's ids, or None where it isn't in the lexicon."""
        state, at, first, target, find = self.start, self.labels_at, self.first, self.target, self.memory.find
        arcs = []
        for c in word:
            arc = find(BYTES[c], at + first[state], at + first[state + 1]) - at
            if arc < 0:
                return None
            arcs.append(arc)
            state = target[arc]
        if not self.final[state]:
            return None
        ids, out_at = [], self.out_at
        for arc in arcs:
            a, b = out_at[arc], out_at[arc + 1]
            if a != b:
                ids += self.outs[a:b]
        ids += self.tails[self.tails_at[state]:self.tails_at[state + 1]]
        return ids

    def get_all(self, words: list[bytes], longest: int = 64) -> list[bytes | None]:
        """The ids of many words, walked side by side, as packed 32-bit numbers; longer words than ``longest`` are walked alone."""
        out: list[bytes | None] = [None] * len(words)
        short = []
        for i, word in enumerate(words):
            if len(word) > longest or not len(self._arcs):
                ids = self.get(word)
                out[i] = None if ids is None else np.array(ids, np.int32).tobytes()
            else:
                short.append(i)
        if not short:
            return out
        lengths = np.array([len(words[i]) for i in short], np.int64)
        width = int(lengths.max())
        letters = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in short), np.uint8).reshape(len(short), width)
        taken = np.full((len(short), width + 1), -1, np.int64)
        state = np.full(len(short), self.start, np.int64)
        rows = np.arange(len(short))        # words that are still on a path
        for depth in range(width + 1):
            done = lengths[rows] == depth
            ended = rows[done]
            ended = ended[self._final[state[ended]]]
            taken[ended, depth] = len(self._arcs) + state[ended]
            rows = rows[~done]
            if not len(rows):
                break
            wanted = state[rows] << 8 | letters[rows, depth]
            arc = np.minimum(np.searchsorted(self._arcs, wanted), len(self._arcs) - 1)
            on = self._arcs[arc] == wanted
            rows, arc = rows[on], arc[on]
            taken[rows, depth], state[rows] = arc, self._target[arc]
        whole = np.nonzero(taken[np.arange(len(short)), lengths] >= 0)[0]
        taken = taken[whole]
        arcs = taken[taken >= 0]        # word by word, from start to end
        counts = self._count[arcs]
        ends = np.cumsum(counts)
        at = np.repeat(self._begin[arcs] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)
        flat = self._out[at].tobytes()
        word_ends = 4 * np.concatenate([[0], ends])[np.cumsum((taken >= 0).sum(1))]
        low = 0
        for i, high in zip(whole.tolist(), word_ends.tolist()):
            out[short[i]], low = flat[low:high], high
        return out
