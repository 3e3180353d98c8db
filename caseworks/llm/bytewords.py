"""Words of many texts at once, cut from their UTF-8 bytes by classes of bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from caseworks.llm.hashing import _powers, mix


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that tells of each byte whether it lies in one of the ranges (both ends included)."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


@dataclass
class Words:
    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    #: 64-bit hash of each word's bytes.
    hash: np.ndarray
    #: Number of words of each text.
    sizes: np.ndarray

    def word(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]].tobytes()


def words(texts: list[str | None], outside: np.ndarray, between: bytes) -> Words:
    """Maximal runs of bytes that aren't `outside`, A-Z in lower case; null texts have none. `between` is a byte of `outside`
    put between texts."""
    data = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    raw = np.frombuffer(between + between.join(data) + between, np.uint8)
    inside = ~outside[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[0::2], edge[1::2]  # both ends of raw are outside
    ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)) + 1) + 1
    sizes = np.diff(np.searchsorted(start, ends), prepend=0)
    return Words(raw, start, end, _hashes(raw, inside, start, end), sizes)


#: Bytes hashed at once.
AT_ONCE = 1 << 20


def _hashes(raw: np.ndarray, inside: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.zeros(len(start), np.uint64)
    cuts = np.unique(np.searchsorted(start, np.arange(0, len(raw) + AT_ONCE, AT_ONCE)))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # words that start within some bytes
        here = slice(start[a], end[b - 1])
        letters = raw[here][inside[here]].astype(np.uint64)
        length = end[a:b] - start[a:b]
        first = np.cumsum(length) - length
        at = np.arange(len(letters)) - np.repeat(first, length)
        with np.errstate(over="ignore"):
            letters *= _powers(int(length.max()))[at]
            out[a:b] = mix(np.add.reduceat(letters, first) ^ length.astype(np.uint64))
    return out


def parts(texts: list[str | None], rows: int, size: int) -> list[tuple[int, int]]:
    """[from, to) of runs of texts of so many rows and characters at most; a longer text is a run of its own."""
    out, a, held = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > a and (i - a >= rows or held + n > size):
            out.append((a, i))
            a, held = i, 0
        held += n
    return [*out, (a, len(texts))] if len(texts) > a else out
