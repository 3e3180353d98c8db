"""Parts of segments that are sorted, and components that grow, against plain forms."""

from __future__ import annotations

import random

from caseworks.llm import components as stars
from caseworks.llm import repeats


def _plain(texts):
    """Runs of windows that a smaller document holds, by looking at all windows."""
    least = {}
    for text, doc in texts.items():
        for i in range(len(text) - repeats.LENGTH + 1):
            own = text[i : i + repeats.LENGTH]
            least[own] = min(doc, least.get(own, doc))
    out = {}
    for text, doc in texts.items():
        runs = []
        for i in range(len(text) - repeats.LENGTH + 1):
            if least[text[i : i + repeats.LENGTH]] < doc:
                runs = [*runs[:-1], (runs[-1][0], i + 1)] if runs and runs[-1][1] == i else [*runs, (i, i + 1)]
        if runs:
            out[text] = runs
    return out


def test_only_shared_parts_are_sorted(monkeypatch):
    """Segments of one key: around one gram, of few letters, so that many share some windows but not all."""
    sorted_symbols = []
    order = repeats.suffix_order
    monkeypatch.setattr(repeats, "suffix_order", lambda symbols: sorted_symbols.append(len(symbols)) or order(symbols))
    rng, left = random.Random(7), 0
    for n in range(300):
        gram = bytes(rng.choice(b"wxyz") for _ in range(repeats.GRAM))
        sides = [(bytes(rng.choice(b"ab") for _ in range(20)), bytes(rng.choice(b"ab") for _ in range(20))) for _ in range(3)]
        texts, at = {}, {}
        for doc in rng.sample(range(100), 12):
            (before, _), (_, after) = rng.choice(sides), rng.choice(sides)
            before, after = before[rng.randrange(21) :], after[: rng.randrange(21)]
            text = before + gram + after
            if len(text) >= repeats.LENGTH:
                texts[text], at[text] = min(doc, texts.get(text, doc)), len(before)
        if not texts:
            continue
        if n % 5 == 0:  # the gram may lie there twice: all of all
            at[next(iter(at))] = -1
        else:
            left += sum(map(len, texts)) + len(texts)
        sorted_symbols, before_it = [], sorted_symbols
        assert repeats.earlier_windows(texts, *repeats.may_share(texts, at)) == _plain(texts)
        sorted_symbols = before_it + (sorted_symbols if n % 5 else [])
    assert sum(sorted_symbols) < left / 2


def test_components_grow_between_parts_only(spark, monkeypatch):
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    as_map = lambda df: {r.node: r.component for r in df.collect()}
    rng = random.Random(8)
    old = [(rng.randrange(120), rng.randrange(120)) for _ in range(60)]
    inside = [(a, b) for a, b in old[:9]]
    parts = stars.components(frame(old), "a", "b")
    new = [(rng.randrange(160), rng.randrange(160)) for _ in range(25)]
    assert as_map(stars.grown(parts, frame(old + new), "a", "b")) == as_map(stars.components(frame(old + new), "a", "b"))
    monkeypatch.setattr(stars, "components", lambda *a: 1 / 0)  # no more rounds without an edge between parts
    assert stars.grown(parts, frame(inside), "a", "b") is parts
