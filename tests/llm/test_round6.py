"""Bounds of the exact rest and hashes of words and texts, against plain forms."""

from __future__ import annotations

import random
import re

import numpy as np

from caseworks.llm import hashing, leftover, minhash

# the exact rest ---------------------------------------------------------------------------------------------------


def test_members_that_are_only_alike_end_inside_the_join(spark):
    """A crowd in which each shares most of a template with each, and some pairs are over the threshold."""
    rng = random.Random(6)
    made = {}
    for i in range(60):
        own = {t: 1 + t % 3 / 8 for t in range(200) if rng.random() > 0.15} | {1000 + 20 * i + k: 1.0 for k in range(4)}
        made[i] = own
        made[100 + i] = {t: w for t, w in own.items() if t % 23} | {9000 + i: 1.25}
    rows = spark.createDataFrame([(i, t, w) for i, x in made.items() for t, w in x.items()], "id long, token long, weight double")
    found = leftover._prefix_pairs(spark.createDataFrame([(i, i) for i in made], "id long, c long"), rows, 0.8)
    found = {(r.leader, r.member) for r in found.collect()}

    def like(a, b):
        both = sum(min(w, b.get(t, 0)) for t, w in a.items())
        return both / (sum(a.values()) + sum(b.values()) - both)

    over = {(i, j) for i in made for j in made if i < j and like(made[i], made[j]) >= 0.8}
    assert len(over) >= 60 and over <= found
    assert len(found) <= 10 * len(over)  # 7,140 pairs share most of the template


# hashes -----------------------------------------------------------------------------------------------------------


def _hash(word: str) -> int:
    data, power, total = word.encode(), 1, 0
    for byte in data + b" ":
        power = power * 0x100000001B3 % 2**64
        total += byte * power
    return int(hashing.mix(np.array([total % 2**64 ^ len(data)], np.uint64))[0])


def test_word_hashes(monkeypatch):
    words = ["a", "", "b_c", "éa", "x" * 50, "a"]
    want = [_hash(w) for w in words if w]
    assert hashing.spaced_hashes((" ".join(words) + " ").encode()).tolist() == want
    monkeypatch.setattr(hashing, "AT_ONCE", 8)
    assert hashing.word_hashes([w for w in words if w]).tolist() == want


def test_texts_are_hashed_by_their_words():
    for text in ["", "...", "one, two_3 (four)\x1ffive\x0b", " é two ", "x"]:
        assert minhash.text_hashes(text).tolist() == [_hash(w) for w in re.findall(r"\w+", text)]


def test_mix_into():
    x = np.arange(9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = np.empty_like(x)
    hashing.mix_into(x.copy(), out)
    assert (out == hashing.mix(x)).all()
