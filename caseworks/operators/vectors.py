"""Near-duplicate vectors by several random-hyperplane signatures.

Each vector has L keys of k signs: on which side of k random hyperplanes it lies. Two vectors at an angle t agree on a sign
with probability 1 - t / pi, so L and k follow from the threshold, the recall asked for, and the size of the largest
owner: cells hold some dozens of unrelated vectors however many there are. Within a cell the signs of SIGNS planes or more
are compared by matrix products; what may reach the threshold is verified by the exact cosine. Cells larger than a block are
dealt as pairs of blocks, so a hot cell is many tasks and none of its pairs is left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseworks.operators.search import cosine

#: Unrelated vectors of an owner in a cell, about; and vectors of one block of a large cell.
CELL = 64
BLOCK = 1024
#: A pair is verified if its signs differ no more often than expected at the threshold plus so many standard deviations.
SIGMAS = 4.0
SIGNS = 256
SEED = 11


@dataclass(frozen=True)
class Plan:
    tables: int
    bits: int
    #: Signs of a vector, those of the keys first; and how many may differ in a pair that is verified.
    signs: int
    most: int


def plan(threshold: float, recall: float, largest: int, cell: int = CELL) -> Plan:
    """Tables and bits for a cosine threshold, the recall at just that cosine, and the vectors of the largest owner."""
    bits = min(20, max(4, math.ceil(math.log2(max(1, largest) / cell)) if largest > cell else 4))
    differ = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    meet = (1 - differ) ** bits
    tables = 1 if meet >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))
    signs = max(SIGNS, tables * bits)
    return Plan(tables, bits, signs, math.floor(signs * differ + SIGMAS * math.sqrt(signs * differ * (1 - differ))))


def distinct_vectors(df: DataFrame, owner: str, v: str, id: str) -> tuple[DataFrame, DataFrame]:
    """(owner, id, v) of one vector, that of the least id, for all equal ones of an owner, and (owner, id, class) of all.
    Null and zero vectors, and nulls of an id, belong to no class."""
    rows = df.select(F.col(owner).alias("owner"), F.col(id).alias("id"), F.col(v).cast("array<double>").alias("v")).where("id IS NOT NULL AND exists(v, x -> x <> 0)")
    classes = rows.groupBy("owner", "v").agg(F.min("id").alias("class"))
    members = rows.select("owner", "id", "v").join(classes.withColumnRenamed("owner", "_o"), F.col("owner").eqNullSafe(F.col("_o")) & (rows["v"] == classes["v"])).select("owner", "id", "class")
    return classes.select("owner", F.col("class").alias("id"), "v"), members


def _signatures(rows: DataFrame, p: Plan) -> DataFrame:
    """(owner, id, tab, key, signs) of every vector and table. Vectors of different lengths meet nowhere."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for pdf in batches:
            dims = pdf["v"].map(len).to_numpy()
            for d in np.unique(dims).tolist():
                part = pdf[dims == d]
                if d not in planes:
                    planes[d] = np.random.default_rng([SEED, d]).standard_normal((d, p.signs))
                side = np.stack(part["v"].to_numpy()) @ planes[d] > 0
                key = (side[:, : p.tables * p.bits].reshape(len(part), p.tables, p.bits) << np.arange(p.bits)).sum(2) + (d << 24)
                packed = np.packbits(side, axis=1)
                out = {"owner": pd.Series(np.repeat(part["owner"].to_numpy(object), p.tables), dtype=object), "id": np.repeat(part["id"].to_numpy(), p.tables), "tab": np.tile(np.arange(p.tables, dtype=np.int32), len(part))}
                yield pd.DataFrame(out | {"key": key.reshape(-1).astype(np.int64), "signs": [s for x in packed for s in [x.tobytes()] * p.tables]})

    return rows.mapInPandas(run, f"owner {rows.schema['owner'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, tab int, key long, signs binary")


def candidate_pairs(rows: DataFrame, p: Plan, block: int = BLOCK) -> DataFrame:
    """(owner, a, b), a < b, of vectors (owner, id, v) that share a cell and whose signs may reach the threshold: each pair
    once, in the first table where it meets."""
    cell = ["owner", "tab", "key"]
    keyed = _signatures(rows, p)
    sizes = keyed.groupBy(*cell).agg(F.count("*").alias("n")).where("n > 1").select(*[F.col(c).alias(f"_{c}") for c in cell], F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    same = F.col("owner").eqNullSafe(F.col("_owner")) & (F.col("tab") == F.col("_tab")) & (F.col("key") == F.col("_key"))
    own = F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int")
    dealt = keyed.join(sizes, same).select(*cell, "id", "signs", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        tab, i, j = (int(pdf[c].iloc[0]) for c in ("tab", "i", "j"))
        bits = np.unpackbits(np.frombuffer(b"".join(pdf["signs"]), np.uint8).reshape(len(pdf), -1), axis=1, count=p.signs)
        keys = bits[:, : p.tables * p.bits]
        signs, own, ids = bits.astype(np.float32) * 2 - 1, pdf["own"].to_numpy(), pdf["id"].to_numpy()
        found = [np.zeros((0, 2), np.int64)]
        least = p.signs - 2 * p.most  # of the product of signs
        for x in range(0, len(pdf), BLOCK):
            a, b = np.nonzero(signs[x : x + BLOCK] @ signs.T >= least)
            a += x
            kept = (ids[a] < ids[b]) & ((i == j) | (own[a] != own[b]))
            found.append(np.stack([a[kept], b[kept]], 1))
        a, b = np.concatenate(found).T
        first = np.zeros(len(a), bool)
        for x in range(0, len(a), 65536):
            meet = (keys[a[x : x + 65536]] == keys[b[x : x + 65536]]).reshape(-1, p.tables, p.bits).all(2)
            first[x : x + 65536] = meet.argmax(1) == tab
        owner = pd.Series([pdf["owner"].iloc[0]] * int(first.sum()), dtype=object)
        return pd.DataFrame({"owner": owner, "a": ids[a[first]], "b": ids[b[first]]})

    kind = rows.schema["id"].dataType.simpleString()
    return dealt.groupBy(*cell, "i", "j").applyInPandas(pairs, f"owner {rows.schema['owner'].dataType.simpleString()}, a {kind}, b {kind}")


def near_dup_hashed(df: DataFrame, owner: str, v: str, id: str, threshold: float = 0.95, recall: float = 0.99, block: int = BLOCK) -> DataFrame:
    """owner, a < b, similarity of different vectors of one owner with a cosine above the threshold.

    Equal vectors count once, by their least id (distinct_vectors has the membership). Similarities are exact; a pair at
    just the threshold is found with the given probability, a more similar one with a higher. For high thresholds; at
    low ones nearly all vectors share cells (near_dup_vectors is exact at any).
    """
    rows, _ = distinct_vectors(df, owner, v, id)
    largest = rows.groupBy("owner").count().agg(F.max("count")).first()[0] or 0
    found = candidate_pairs(rows, plan(threshold, recall, largest), block)
    end = lambda c: rows.select(F.col("owner").alias(f"o_{c}"), F.col("id").alias(c), F.col("v").alias(f"v_{c}"))
    same = lambda c: F.col("owner").eqNullSafe(F.col(f"o_{c}"))
    x, y = end("a"), end("b")
    j = found.join(x, (found["a"] == x["a"]) & same("a")).drop(x["a"]).join(y, (found["b"] == y["b"]) & same("b")).drop(y["b"])
    out = j.select(F.col("owner").alias(owner), "a", "b", cosine(F.col("v_a"), F.col("v_b")).alias("similarity"))
    return out.where(F.col("similarity") > threshold)
