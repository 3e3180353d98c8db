"""Count transducers: deterministic acyclic automata that accept phrases and give out their counts.

States that have the same weight and the same arcs are one state. A state is closed, and looked up among those registered,
as soon as the sorted phrases have moved on from it; as all phrases of a depth are at hand as arrays, the states of a
depth are closed at once, the deepest first.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import zstandard

from caseworks.llm.hashing import mix

_ARC = np.uint64(0xD6E8FEB86659FD93)


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def narrow(x: np.ndarray) -> np.ndarray:
    """x in the narrowest whole numbers that hold it."""
    top = int(x.max()) if len(x) else 0
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def summed(paths: np.ndarray, weights: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of word numbers (1 to n_words; 0: no word), in order, and the sums of their weights."""
    if not len(paths):
        return paths, weights
    bits = max(1, int(n_words).bit_length())
    per = max(1, 63 // bits)
    keys = []
    for a in range(0, paths.shape[1], per):
        key = np.zeros(len(paths), np.int64)
        for c in range(a, min(a + per, paths.shape[1])):
            key = (key << bits) | paths[:, c]
        keys.append(key)
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(paths), bool)
    new[0] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return paths[order[first]], np.add.reduceat(weights[order], first)


@dataclass
class Transducer:
    #: Words (numbers over 0, in order) that label arcs.
    words: np.ndarray
    #: Arcs by state: arcs first[s] to first[s + 1] leave state s, in the order of their labels.
    first: np.ndarray
    label: np.ndarray
    target: np.ndarray
    #: Count of the phrases that end in a state (0: none does).
    weight: np.ndarray
    root: int

    def dump(self) -> bytes:
        gaps = np.diff(self.words, prepend=np.uint64(0))
        return squeeze(pickle.dumps((narrow(gaps), narrow(np.diff(self.first)), narrow(self.label), narrow(self.target), narrow(self.weight), self.root), 5))

    @staticmethod
    def load(data: bytes) -> Transducer:
        gaps, arcs, label, target, weight, root = pickle.loads(unsqueeze(data))
        words = np.cumsum(gaps, dtype=np.uint64)
        first = np.concatenate([[0], np.cumsum(arcs.astype(np.int64))])
        return Transducer(words, first, label.astype(np.int64), target.astype(np.int64), weight.astype(np.int64), root)

    def _leave(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arcs that leave the given states: for each the place of its state, and the arc."""
        n = self.first[states + 1] - self.first[states]
        at = np.repeat(np.arange(len(states)), n)
        return at, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.first[states][at]

    def paths(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """All phrases as rows of word numbers (from 1; 0: no word), and their counts."""
        rows, counts = [np.zeros((0, depth), np.int64)], [np.zeros(0, np.int64)]
        states, held = np.array([self.root]), np.zeros((1, depth), np.int64)
        for d in range(depth):
            at, arc = self._leave(states)
            states, held = self.target[arc], held[at]
            held[:, d] = self.label[arc] + 1
            final = self.weight[states] > 0
            rows.append(held[final])
            counts.append(self.weight[states[final]])
        return np.concatenate(rows), np.concatenate(counts)


def build(words: np.ndarray, paths: np.ndarray, weights: np.ndarray) -> Transducer:
    """The least transducer of phrases, given as distinct rows of word numbers in order, with their counts (over 0)."""
    n, depth = paths.shape
    node = np.zeros((n, depth + 1), np.int64)  # number of the prefix of each depth, from 0
    starts: list[np.ndarray] = []
    new = np.zeros(n, bool)
    for d in range(depth):
        there = paths[:, d] > 0
        new[1:] |= paths[1:, d] != paths[:-1, d]
        if n:
            new[0] = True
        own = new & there
        node[:, d + 1] = np.cumsum(own) - 1
        starts.append(np.flatnonzero(own))
    length = (paths > 0).sum(1)
    arcs_of, label_of, target_of, weight_of = [], [], [], []
    known, n_states = np.zeros(0, np.int64), 0  # state of each prefix one deeper
    for d in range(depth, -1, -1):
        at = starts[d - 1] if d else np.zeros(1, np.int64)
        weight = np.zeros(len(at), np.int64)
        ends = np.flatnonzero(length == d) if d else np.zeros(0, np.int64)
        weight[node[ends, d]] = weights[ends]
        rows = starts[d] if d < depth else np.zeros(0, np.int64)  # arcs to the prefixes one deeper
        parent, label = node[rows, d], paths[rows, d] - 1 if d < depth else rows
        with np.errstate(over="ignore"):
            sign = mix(weight.astype(np.uint64) + np.uint64(d << 48))
            np.add.at(sign, parent, mix((label + 1).astype(np.uint64) * _ARC + known.astype(np.uint64)))
        _, kept, state = np.unique(sign, return_index=True, return_inverse=True)
        new_number = np.full(len(at), -1, np.int64)
        new_number[kept] = state[kept]
        arc = np.flatnonzero(new_number[parent] >= 0)
        arc = arc[np.argsort(new_number[parent[arc]], kind="stable")]
        arcs_of.append(np.bincount(new_number[parent[arc]], minlength=len(kept)))
        label_of.append(label[arc])
        target_of.append(known[arc])
        weight_of.append(weight[kept])
        known, n_states = state + n_states, n_states + len(kept)
    first = np.concatenate([[0], np.cumsum(np.concatenate(arcs_of))])
    return Transducer(words, first, np.concatenate(label_of), np.concatenate(target_of), np.concatenate(weight_of), n_states - 1)


def of_phrases(phrases: np.ndarray, counts: np.ndarray) -> Transducer:
    """The transducer of phrases, rows of words (0: no word) in any order; counts of equal ones are summed."""
    words = np.unique(phrases)
    words = words[words > 0]
    numbers = np.where(phrases > 0, np.searchsorted(words, phrases) + 1, 0)
    return build(words, *summed(numbers, counts, len(words)))


def union(parts: list[Transducer], depth: int, least: int = 1) -> Transducer:
    """The transducer of all phrases of the parts, their counts summed; those that count less than `least` are left out."""
    words = np.unique(np.concatenate([np.zeros(0, np.uint64), *[p.words for p in parts]]))
    rows, counts = [np.zeros((0, depth), np.int64)], [np.zeros(0, np.int64)]
    for p in parts:
        number = np.concatenate([[0], np.searchsorted(words, p.words) + 1])
        r, c = p.paths(depth)
        rows.append(number[r])
        counts.append(c)
    r, c = summed(np.concatenate(rows), np.concatenate(counts), len(words))
    kept = c >= least
    return build(words, r[kept], c[kept])


def compose(asked: Transducer, t: Transducer, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The phrases that both accept, as rows of asked's word numbers in the order of paths(), and their counts in t: both
    are walked side by side, each arc of one with the arc of the same word of the other."""
    rows, counts = [np.zeros((0, depth), np.int64)], [np.zeros(0, np.int64)]
    place = np.minimum(np.searchsorted(t.words, asked.words), max(0, len(t.words) - 1))
    number = np.where(t.words[place] == asked.words, place, -1) if len(t.words) else np.full(len(asked.words), -1)
    width = len(t.words) + 1
    arcs = np.repeat(np.arange(len(t.weight)), np.diff(t.first)) * width + t.label
    a, b, held = np.array([asked.root]), np.array([t.root]), np.zeros((1, depth), np.int64)
    for d in range(depth):
        at, arc = asked._leave(a)
        want = number[asked.label[arc]]
        key = b[at] * width + want
        found = np.minimum(np.searchsorted(arcs, key), max(0, len(arcs) - 1))
        ok = (want >= 0) & (arcs[found] == key) if len(arcs) else np.zeros(len(arc), bool)
        at, arc, found = at[ok], arc[ok], found[ok]
        a, b, held = asked.target[arc], t.target[found], held[at]
        held[:, d] = asked.label[arc] + 1
        both = (asked.weight[a] > 0) & (t.weight[b] > 0)
        rows.append(held[both])
        counts.append(t.weight[b[both]])
    return np.concatenate(rows), np.concatenate(counts)
