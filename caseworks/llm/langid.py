"""Language identification by hyperdimensional computing.

Every letter has a fixed random vector of +1 and -1. An n-gram is bound: the vectors of its letters, each permuted by
its place, multiplied; a document is the bundle (sum) of its n-grams, and a language's prototype the bundle of its
documents, each of unit length. Prediction is the greatest cosine between document and prototypes.

Defined results: null text or text without a letter is ``und`` with score 0; ties between languages go to the smaller
name; no training document gives ``und`` everywhere; repeated rows are predicted alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseworks.llm.common import crc_mod, renamed, table

DIMS = 1024
GRAM = 3
#: Unit vectors are summed as whole numbers of this fraction, so that sums don't depend on the order of rows.
UNIT = 1 << 24
#: Documents bundled by one matrix product.
CHUNK = 256
_SPACE = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=65536)
def letter_vector(code: int) -> np.ndarray:
    return np.random.default_rng([code, DIMS]).integers(0, 2, DIMS, dtype=np.int8) * 2 - 1


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a text's letter n-grams: lower case, anything but letters is one space."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = _letters()[codes] if len(codes) else np.zeros(0, bool)
    if not kept.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes = np.concatenate([[_SPACE], np.where(kept, codes, _SPACE), [_SPACE]]).astype(np.uint64)
    codes = codes[np.concatenate([[True], (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)])]
    gram = np.zeros(len(codes) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        gram = (gram << np.uint64(21)) | codes[i : len(codes) - GRAM + 1 + i]
    return np.unique(gram, return_counts=True)


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Bound vectors of n-grams: letter i of n is rolled by n - 1 - i places."""
    out = np.ones((len(grams), DIMS), np.int8)
    for i in range(GRAM):
        codes = (grams >> np.uint64(21 * (GRAM - 1 - i))) & np.uint64((1 << 21) - 1)
        letters, which = np.unique(codes, return_inverse=True)
        out *= np.stack([np.roll(letter_vector(int(c)), GRAM - 1 - i) for c in letters])[which]
    return out


def document_vectors(texts: list[str | None]) -> np.ndarray:
    """Unit vectors of documents (zero rows for those without letters), float32."""
    counted = [gram_counts(t) for t in texts]
    grams, which = np.unique(np.concatenate([g for g, _ in counted]), return_inverse=True)
    out = np.zeros((len(texts), DIMS), np.float32)
    if len(grams):
        rows = np.repeat(np.arange(len(texts)), [len(g) for g, _ in counted])
        order = np.argsort(which, kind="stable")
        rows, which = rows[order], which[order]
        own = np.concatenate([c for _, c in counted])[order]
        for a in range(0, len(grams), 4096):  # bounds the vectors and counts held at once
            lo, hi = np.searchsorted(which, (a, a + 4096))
            part = grams[a : a + 4096]
            counts = np.zeros((len(texts), len(part)), np.float32)
            counts[rows[lo:hi], which[lo:hi] - a] = own[lo:hi]
            out += counts @ gram_vectors(part).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fit_prototypes(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Unit prototypes of all languages of (text, lang). Each task sends one sum per language; nulls teach nothing."""

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for a in range(0, len(pdf), CHUNK):
                part = pdf.iloc[a : a + CHUNK]
                vectors = np.rint(document_vectors(part["text"].tolist()) * UNIT).astype(np.int64)
                langs = part["lang"].to_numpy()
                for lang in set(langs):
                    sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(0)
        for lang, v in sums.items():
            yield pd.DataFrame({"lang": lang, "dim": np.arange(DIMS, dtype=np.int32), "value": v})

    parts = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInPandas(bundle, "lang string, dim int, value long")
    rows = parts.groupBy("lang", "dim").agg(F.sum("value").alias("value")).collect()  # languages x DIMS rows
    langs = sorted({r.lang for r in rows})
    out = np.zeros((len(langs), DIMS))
    for r in rows:
        out[langs.index(r.lang), r.dim] = r.value
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    kept = norm[:, 0] > 0
    return [x for x, k in zip(langs, kept, strict=True) if k], (out[kept] / norm[kept]).astype(np.float32)


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, keep: list[str]) -> DataFrame:
    """The `keep` columns with lang_pred and score (the cosine, 0 at least) of every text."""
    fields = [docs.schema[c] for c in keep]

    def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            best, score = [], []
            for a in range(0, len(pdf), CHUNK):
                texts = pdf["text"].iloc[a : a + CHUNK].tolist()
                cos = document_vectors(texts) @ prototypes.T if langs else np.zeros((len(texts), 0))
                known = [bool(langs) and has_letter(t) for t in texts]
                best += [langs[c.argmax()] if k else "und" for c, k in zip(cos, known, strict=True)]
                score += [float(min(1.0, max(0.0, c.max()))) if k else 0.0 for c, k in zip(cos, known, strict=True)]
            yield pdf[keep].assign(lang_pred=best, score=score)

    columns = list(dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double"
    return docs.select(columns).mapInPandas(guess, schema)


def held_out() -> Column:
    return crc_mod("doc_id", 5) == 0


def identify(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Fit on the documents that aren't held out, predict all."""
    langs, prototypes = fit_prototypes(docs.where(~F.coalesce(held_out(), F.lit(False))))
    return predict(docs, langs, prototypes, keep)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def stage_language_id(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any language (no letter, no text) go; all others stay as they are, repeated ones too. Null doc_ids
    and langs teach nothing, extra columns may have any name, an empty table stays empty."""
    langs, prototypes = fit_prototypes(docs.where(~F.coalesce(held_out(), F.lit(True))))
    plain = renamed(docs)
    return predict(plain, langs, prototypes, plain.columns).where("lang_pred <> 'und'").select(plain.columns).toDF(*docs.columns)
