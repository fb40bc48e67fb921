"""Weighted acyclic automata that map phrases to counts.

A path of words from the root to a final state is a phrase; the weights along it, the final one
included, add up to its count. Automata are built word by word from sorted phrases: what can no longer
change is frozen, and equal frozen states are one state. Weights move towards the root as far as all
phrases of a prefix share them, so that more states are equal.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np


#: A state that only ends a phrase.
NO_ARCS = (0,)


class Builder:
    """Takes phrases, tuples of label numbers, in ascending order and without repeats."""

    def __init__(self):
        self.states: list[tuple] = []
        self.register: dict[tuple, int] = {}
        self.last: tuple = ()
        self.open: list[list] = [[None, []]]  # states of the last phrase: final weight, arcs

    def add(self, phrase: tuple, count: int) -> None:
        last, open_ = self.last, self.open
        shared = 0
        for a, b in zip(last, phrase):
            if a != b:
                break
            shared += 1
        self._freeze(shared)
        for depth in range(shared):
            arc = open_[depth][1][-1]
            if arc[2] > count:  # what the others of this prefix have more moves below it
                more, below = arc[2] - count, open_[depth + 1]
                arc[2] = count
                for other in below[1]:
                    other[2] += more
                if below[0] is not None:
                    below[0] += more
            count -= arc[2]
        for label in phrase[shared:]:
            open_[-1][1].append([label, -1, 0])
            open_.append([None, []])
        open_[-1][0] = 0
        open_[shared][1][-1][2] = count
        self.last = phrase

    def add_endings(self, prefix: tuple, endings: list[int], counts: list[int]) -> None:
        """``add`` of all phrases of equal length with this prefix at once: sorted last words."""
        if NO_ARCS not in self.register:
            self.register[NO_ARCS] = len(self.states)
            self.states.append(NO_ARCS)
        leaf, shared = self.register[NO_ARCS], 0
        if prefix:
            shared = min(counts)
            self.add(prefix, shared)
            self.open[-1][0] = None  # the prefix itself is no phrase
        self.open[-1][1] = [(label, leaf, n - shared) for label, n in zip(endings, counts, strict=True)]

    def _freeze(self, depth: int) -> None:
        open_, register = self.open, self.register
        while len(open_) - 1 > depth:
            final, arcs = open_.pop()
            state = (final, *map(tuple, arcs))
            number = register.get(state)
            if number is None:
                number = register[state] = len(self.states)
                self.states.append(state)
            open_[-1][1][-1][1] = number

    def finish(self) -> list[tuple]:
        """The states, each its final weight (None if it ends no phrase) and its arcs; the root is last."""
        self._freeze(0)
        self.states.append((self.open[0][0], *map(tuple, self.open[0][1])))
        return self.states


def _narrow(values) -> bytes:
    """The numbers in as few bytes each as the largest needs, behind that width."""
    values = np.asarray(values, np.int64)
    top = int(values.max()) if len(values) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return struct.pack("<BI", width, len(values)) + values.astype(f"<u{width}").tobytes()


def _wide(blob: bytes, at: int) -> tuple[np.ndarray, int]:
    width, n = struct.unpack_from("<BI", blob, at)
    return np.frombuffer(blob, f"<u{width}", n, at + 5).astype(np.int64), at + 5 + n * width


def pack(phrases: Iterable[tuple[tuple, int]], words: list[bytes]) -> bytes:
    """The automaton of sorted (label numbers, count) as bytes; ``words`` names the labels. Words hold
    no space."""
    builder = Builder()
    for phrase, count in phrases:
        builder.add(phrase, count)
    return _packed(builder.finish(), words)


def pack_rows(rows: np.ndarray, counts: np.ndarray, words: list[bytes]) -> bytes:
    """``pack`` of phrases of equal length, given as sorted rows of label numbers."""
    builder, length = Builder(), rows.shape[1]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)
    starts = np.flatnonzero(new).tolist()
    prefixes, endings, counts = rows[starts, :-1].tolist(), rows[:, -1].tolist(), counts.tolist()
    for prefix, at, to in zip(map(tuple, prefixes), starts, [*starts[1:], len(rows)], strict=True):
        builder.add_endings(prefix if length > 1 else (), endings[at:to], counts[at:to])
    return _packed(builder.finish(), words)


def _packed(states: list[tuple], words: list[bytes]) -> bytes:
    arcs = [arc for s in states for arc in s[1:]]
    labels, targets, weights = zip(*arcs, strict=True) if arcs else ((), (), ())
    used, place = np.unique(np.array(labels, np.int64), return_inverse=True)
    return b"".join([
        _narrow([len(s) - 1 for s in states]),
        _narrow([0 if s[0] is None else s[0] + 1 for s in states]),
        _narrow(place), _narrow(targets), _narrow(weights), b" ".join([words[i] for i in used.tolist()])])


class Transducer:
    """A packed automaton, read."""

    def __init__(self, blob: bytes):
        degree, at = _wide(blob, 0)
        final, at = _wide(blob, at)
        self.labels, at = _wide(blob, at)
        self.targets, at = _wide(blob, at)
        self.weights, at = _wide(blob, at)
        self.words = blob[at:].split(b" ") if len(self.labels) else []
        self.ends = np.cumsum(degree)
        self.starts = self.ends - degree
        self.final = final - 1  # -1: ends no phrase
        self.root = len(degree) - 1
        self._arcs: dict[int, dict] = {}

    def expand(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(label numbers, counts) of all phrases of each length, one row a phrase, sorted by them."""
        states, sums = np.array([self.root]), np.zeros(1, np.int64)
        paths = np.zeros((1, 0), np.int64)
        while len(states):
            done = self.final[states] >= 0
            if paths.shape[1] and done.any():
                yield paths[done], sums[done] + self.final[states[done]]
            width = self.ends[states] - self.starts[states]
            source = np.repeat(np.arange(len(states)), width)
            arcs = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + self.starts[states][source]
            paths = np.column_stack([paths[source], self.labels[arcs]])
            sums, states = sums[source] + self.weights[arcs], self.targets[arcs]

    def arcs(self, state: int) -> dict[bytes, tuple[int, int]]:
        """word -> (state after it, weight)."""
        found = self._arcs.get(state)
        if found is None:
            at = range(int(self.starts[state]), int(self.ends[state]))
            found = self._arcs[state] = {
                self.words[self.labels[i]]: (int(self.targets[i]), int(self.weights[i])) for i in at}
        return found


def compose(asked: Transducer, counts: Transducer) -> Iterator[tuple[tuple[bytes, ...], int]]:
    """(phrase, count) of every phrase that both automata hold; weights are those of ``counts``."""
    stack = [((), asked.root, counts.root, 0)]
    while stack:
        phrase, p, q, total = stack.pop()
        if phrase and asked.final[p] >= 0 and counts.final[q] >= 0:
            yield phrase, total + int(counts.final[q])
        there = counts.arcs(q)
        for word, (next_p, _) in asked.arcs(p).items():
            if word in there:
                next_q, weight = there[word]
                stack.append(((*phrase, word), next_p, next_q, total + weight))
