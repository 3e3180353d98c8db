"""Toxicity by a linear classifier over character n-grams that are scaled by naive Bayes log-count ratios.

1. A text in lower case, with one space for each run of anything but letters and digits, has its runs of 4 to 6 characters
   as features, hashed to 2^18 numbers, each of value 1 + log2 of its occurrences.
2. A feature's log-count ratio is that of the odds of label 1 among the labelled training texts that hold it, smoothed
   towards the odds of all: r = ln((p + S * base) / (q + S * (1 - base))) - ln(base / (1 - base)). All labelled rows count;
   tasks send packed counts, which are summed by slices of the feature space.
3. Features with |r| under LEAST carry no weight. The values of the others, scaled by r and each text's to unit length, go
   into a logistic regression (batch gradient steps with momentum and an L2 penalty), fitted on FIT_ROWS labelled training
   rows at most (about), half of each label; its intercept is moved back to the odds of all labelled rows.
4. Scoring reads every text whole. The model is 2^18 numbers at any size of the corpus.

Defined results: texts without a weighted feature, null and empty ones too, score the share of label 1; null labels and null texts teach nothing; of several
labels of one doc_id the greatest holds, for each of its rows; without training rows of both labels every score is the
share of label 1 (0 without any); equal texts score alike; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseworks.llm.common import crc_mod, fits, table

GRAMS = (4, 5, 6)
BITS = 18
SIZE = 1 << BITS
#: Features of a slice, which is one group of a sum.
SLICE = 1 << 13
#: Strength of the smoothing towards the odds of all labelled rows.
SMOOTH = 20.0
#: Log-count ratios nearer to 0 carry no weight.
LEAST = 0.7
#: Labelled training rows that the regression is fitted on, at most (about), chosen by a hash of their text.
FIT_ROWS = 12_000
STEPS, PENALTY, MOMENTUM = 300, 1e-5, 0.9


def _plain(text: str) -> np.ndarray:
    """Code points of the text in lower case, one space for each run of anything but letters and digits, and at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = (codes >= 128) | (codes - 48 < 10) | (codes - 97 < 26)
    codes = np.concatenate([[32], np.where(kept, codes, 32), [32]]).astype(np.uint32)
    return codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]


def grams(text: str | None) -> np.ndarray:
    """Feature numbers of all n-grams of a text, with repeats."""
    codes = _plain(text or "")
    h, out = codes.copy(), [np.zeros(0, np.int64)]
    for n in range(2, GRAMS[-1] + 1):
        h = h[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        if n in GRAMS:
            mixed = (h ^ (h >> np.uint32(15)) ^ np.uint32(n)) * np.uint32(0x9E3779B1)
            out.append((mixed >> np.uint32(32 - BITS)).astype(np.int64))
        if len(h) < 2:
            break
    return np.concatenate(out)


def features(text: str | None, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of a text, of those that are marked in `among`, and their values."""
    found = grams(text)
    found, n = np.unique(found[among[found]], return_counts=True)
    return found, 1 + np.log2(n)


def present(text: str | None) -> np.ndarray:
    """All distinct feature numbers of a text."""
    found = grams(text)
    if len(found) < SIZE // 32:
        return np.unique(found)
    mark = np.zeros(SIZE, bool)
    mark[found] = True
    return np.flatnonzero(mark)


def label_counts(labelled: DataFrame) -> tuple[np.ndarray, int, int]:
    """Rows of label 0 and of label 1 that hold each feature, and how many rows of each label there are."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, rows = np.zeros((2, SIZE), np.int64), [0, 0]
        for pdf in batches:
            for text, label in zip(pdf["text"], pdf["label"], strict=True):
                out[label, present(text)] += 1
                rows[label] += 1
        if sum(rows):
            yield pd.DataFrame({"slice": range(SIZE // SLICE), "zeros": rows[0], "ones": rows[1], "counts": [out[:, a : a + SLICE].ravel() for a in range(0, SIZE, SLICE)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(pdf["counts"].to_numpy()), axis=0)
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "zeros": [pdf["zeros"].sum()], "ones": [pdf["ones"].sum()], "counts": [total]})

    schema = "slice int, zeros long, ones long, counts array<long>"
    rows = labelled.select("text", "label").mapInPandas(count, schema).groupBy("slice").applyInPandas(add, schema).collect()  # the model's size
    out = np.zeros((2, SIZE), np.int64)
    for r in rows:
        out[:, r.slice * SLICE : (r.slice + 1) * SLICE] = np.reshape(r.counts, (2, SLICE))
    return out, rows[0].zeros if rows else 0, rows[0].ones if rows else 0


def log_ratios(counts: np.ndarray, zeros: int, ones: int) -> np.ndarray:
    base = ones / (zeros + ones)
    return np.log((counts[1] + SMOOTH * base) / (counts[0] + SMOOTH * (1 - base))) - np.log(base / (1 - base))


def _unit(n: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Values scaled by their ratios, to unit length."""
    scaled = n * ratios
    return scaled / max(1e-12, float(np.sqrt((scaled**2).sum())))


@dataclass
class Model:
    #: Log-count ratio of each feature (0: it carries no weight), and its weight in the regression.
    ratios: np.ndarray
    weights: np.ndarray
    intercept: float
    #: Logarithm of the odds of label 1, for texts without a weighted feature.
    base: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        among, margin = self.ratios != 0, np.empty(len(texts))
        for i, t in enumerate(texts):
            f, n = features(t, among)
            margin[i] = (_unit(n, self.ratios[f]) * self.weights[f]).sum() + self.intercept if len(f) else self.base
        return 1 / (1 + np.exp(-np.clip(margin, -700, 700)))


def regression(row: np.ndarray, feature: np.ndarray, value: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of features and the intercept, for rows of unit length and the given entries."""
    used, at = np.unique(feature, return_inverse=True)
    w, b, vw, vb = np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0
    for _ in range(STEPS):  # steps of 2: the mean of |(x, 1)|^2 / 4 bounds the curvature
        margin = np.bincount(row, value * w[at], len(labels)) + b
        error = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - labels) / len(labels)
        vw = MOMENTUM * vw - 2 * (np.bincount(at, value * error[row], len(used)) + PENALTY * w)
        vb = MOMENTUM * vb - 2 * error.sum()
        w, b = w + vw, b + vb
    out = np.zeros(SIZE)
    out[used] = w
    return out, b


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The classifier of labelled rows (text, label)."""
    labelled = labelled.where("text IS NOT NULL AND label IN (0, 1)").select("text", F.col("label").cast("int").alias("label"))
    counts, zeros, ones = label_counts(labelled)
    if not zeros or not ones:
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0, np.inf if ones else -np.inf)
    base = float(np.log(ones / zeros))
    ratios = log_ratios(counts, zeros, ones)
    ratios[np.abs(ratios) < LEAST] = 0
    among = ratios != 0
    shares = [min(1.0, fit_rows / 2 / x) for x in (zeros, ones)]
    place = (F.pmod(F.xxhash64("text", F.lit(12)), F.lit(1 << 30)) / float(1 << 30)).alias("place")
    chosen = labelled.select("text", "label", place).where(F.col("place") < F.when(F.col("label") == 1, shares[1]).otherwise(shares[0]))

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [features(t, among) for t in pdf["text"]]
            yield pd.DataFrame({"model": 0, "label": pdf["label"], "place": pdf["place"], "features": [f.astype(np.int32).tobytes() for f, _ in got], "values": [n.astype(np.float32).tobytes() for _, n in got]})

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "features"])
        f, n = ([np.frombuffer(x, kind) for x in pdf[c]] for c, kind in (("features", np.int32), ("values", np.float32)))
        value = np.concatenate([_unit(y, ratios[x]) for x, y in zip(f, n, strict=True)])
        w, b = regression(np.repeat(np.arange(len(f)), [len(x) for x in f]), np.concatenate(f), value, pdf["label"].to_numpy(np.float64))
        return pd.DataFrame({"weights": [w], "intercept": [b]})

    rows = chosen.mapInPandas(held, "model int, label int, place double, features binary, values binary").groupBy("model").applyInPandas(learn, "weights array<double>, intercept double").collect()
    if not rows:
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0, base)
    moved = np.log(shares[0] / shares[1])
    return Model(ratios, np.array(rows[0].weights), rows[0].intercept + moved, base)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score of docs (doc_id, text, held_out)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["doc_id", "held_out"]].assign(score=model.scores(pdf["text"].tolist()))

    return docs.select("doc_id", "held_out", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, label) of the rows of docs (doc_id, text, held_out) that have a label and aren't held out."""
    of = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    return docs.where(~F.col("held_out")).join(fits(of), "doc_id").select("text", "label")


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held)
    model = fit(training_rows(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return score(docs, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
