"""Parcels between blocks of documents and buckets of keys.

A block (some hundred documents) sends each key once, with what it holds on it, packed into one binary row per bucket;
a bucket joins the parcels of all blocks and answers. So a key that a third of all documents share is one entry per
block, and rows stay few.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd

PARCEL = "bucket int, block int, data binary"
ANSWER = "block int, kind string, a long, b long, data binary"


def parcels(block: int, buckets: int, keys: np.ndarray, content: Callable[[np.ndarray], object]) -> pd.DataFrame:
    """One row per bucket that gets any of the keys: its data is content(numbers of these keys, in their order)."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    parts = [p for p in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(p)]
    out = pd.DataFrame({"bucket": [int(bucket[p[0]]) for p in parts], "block": [block] * len(parts), "data": [pickle.dumps(content(p), 5) for p in parts]})
    return out.astype({"bucket": "int32", "block": "int32", "data": object})


def answers(rows: list[tuple]) -> pd.DataFrame:
    """Rows of (block, kind, a, b, data)."""
    out = pd.DataFrame(rows, columns=["block", "kind", "a", "b", "data"])
    return out.astype({"block": "int32", "kind": object, "a": "int64", "b": "int64", "data": object})


def pack48(keys: np.ndarray) -> bytes:
    """The upper 48 bits of each key: six bytes, still telling 10^13 keys apart but for a few in a hundred."""
    return np.ascontiguousarray((keys >> np.uint64(16)).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def sum_by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each one's values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values, first)


def look_up(keys: np.ndarray, table: np.ndarray, values: np.ndarray, default: int) -> np.ndarray:
    """Value of each key in a sorted table, or the default."""
    if not len(table):
        return np.full(len(keys), default, values.dtype)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], default)


def among(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each key is in a sorted table."""
    if not len(table):
        return np.zeros(len(keys), bool)
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys
