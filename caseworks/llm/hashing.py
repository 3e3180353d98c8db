"""Hashes of all words of a text at once, as numpy arrays."""

from __future__ import annotations

import numpy as np

_WORD = np.uint64(0x100000001B3)
_SHINGLE = np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0x9FB21C651E98DF25)
_POWERS = np.cumprod(np.full(4096, _WORD, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _MIX
        x = (x ^ (x >> np.uint64(29))) * _SHINGLE
        return x ^ (x >> np.uint64(32))


def mix_into(x: np.ndarray, out: np.ndarray) -> None:
    """mix(x) in out; x is overwritten."""
    np.right_shift(x, np.uint64(32), out=out)
    x ^= out
    x *= _MIX
    np.right_shift(x, np.uint64(29), out=out)
    x ^= out
    x *= _SHINGLE
    np.right_shift(x, np.uint64(32), out=out)
    out ^= x


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(2 * n, _WORD, np.uint64))
    return _POWERS


_INVERSE = np.zeros(0, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    """The inverse (modulo 2^64) of each power of _WORD, from the zeroth on."""
    global _INVERSE
    if n > len(_INVERSE):
        _INVERSE = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, pow(int(_WORD), -1, 1 << 64), np.uint64)]))
    return _INVERSE


#: Bytes of text hashed at once.
AT_ONCE = 1 << 18
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the runs of bytes between ASCII white space of all texts, in order, and how many each text has.
    Many short texts are hashed at once."""
    out, sizes, held, size = [], [], [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= AT_ONCE:
            _hash_joined(held, out, sizes)
            held, size = [], 0
    if held:
        _hash_joined(held, out, sizes)
    return np.concatenate([np.zeros(0, np.uint64), *out]), np.concatenate([np.zeros(0, np.int64), *sizes])


def _hash_joined(texts: list[bytes], out: list[np.ndarray], sizes: list[np.ndarray]) -> None:
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~_SPACES[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]  # the last byte is a space, so every run ends
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    sizes.append(np.diff(np.searchsorted(start, ends), prepend=0))
    if not len(start):
        return
    length = end - start
    letters = raw[inside].astype(np.uint64)
    first = np.cumsum(length) - length
    at = np.arange(len(letters)) - np.repeat(first, length)
    with np.errstate(over="ignore"):
        letters *= _powers(int(length.max()))[at]
        out.append(mix(np.add.reduceat(letters, first) ^ length.astype(np.uint64)))


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hash of each word (of its UTF-8 bytes). Words hold no space."""
    if not words:
        return np.zeros(0, np.uint64)
    data = (" ".join(words) + " ").encode("utf-8", "surrogatepass")
    if len(data) > AT_ONCE and len(words) > 1:
        half = len(words) // 2
        return np.concatenate([word_hashes(words[:half]), word_hashes(words[half:])])
    return spaced_hashes(data)


def spaced_hashes(text: bytes) -> np.ndarray:
    """The word_hashes of a text's words. Spaces stand between them and after the last, and nothing else is a gap.

    A word's hash is the sum of its bytes (and the space) times powers of a number by their place in it: the sum over the text
    from the word's start on, times the inverse power of its start.
    """
    data = np.frombuffer(text, np.uint8)
    gap = np.flatnonzero(data == 32)
    start = np.concatenate([[0], gap[:-1] + 1])
    start, end = start[gap > start], gap[gap > start]
    powers, inverse = _powers(len(data)), _inverse_powers(len(data))
    with np.errstate(over="ignore"):
        upto = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * powers[: len(data)], out=upto[1:])
        return mix((upto[end + 1] - upto[start]) * inverse[start] ^ (end - start).astype(np.uint64))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; of all words together if there are fewer, but not none."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * _SHINGLE + words[i : len(words) - n + 1 + i]
    return mix(out)
