"""Small helpers shared by the corpus operators: tables, shared storage, document blocks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseworks.plans.shared import FREE_SHUFFLES, shared_dir, shuffles_freed  # noqa: F401

#: Documents that one block (one Python call) holds; bounds the memory of a task.
BLOCK_DOCS = 1000
#: Bytes of text that a block holds for each of its documents, on average.
DOC_BYTES = 8192
#: Rows (of some numbers each) that are broadcast at most, some 50 MB in an executor; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def append(df: DataFrame, path: str) -> None:
    """Add df to the Parquet folder of a path."""
    with shuffles_freed(df.sparkSession):
        df.write.mode("append").parquet(path)


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df as Parquet into the shared folder (in a folder for each value of the columns `by`) and read it back: cuts
    the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_blocks(df: DataFrame, per_block: int = BLOCK_DOCS, text: str = "text") -> int:
    """Number of blocks for df's rows: bounded in rows, and in bytes of text for tables of long texts."""
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return max(1, -(-rows // per_block), -(-size // (per_block * DOC_BYTES)))


def with_block(df: DataFrame, key: str, blocks: int) -> DataFrame:
    """A block number per row from a hash of its key, so blocks are even whatever the key's distribution."""
    return df.withColumn("block", F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(blocks)).cast("int"))


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has few rows. For tables of narrow rows that are written already: counting them
    reads footers only."""
    return F.broadcast(df) if df.count() <= rows else df


def renamed(df: DataFrame) -> DataFrame:
    """df with plain column names but for text, so that no column clashes with one that an operator adds; the order stays,
    and toDF(*df.columns) gives the names back."""
    return df.toDF(*["text" if c == "text" else f"_c{i}" for i, c in enumerate(df.columns)])


#: Rows without a doc_id get numbers under this one, from their text, which no doc_id is expected to reach.
_NAMELESS = -(1 << 61)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number in place of each null doc_id, by the text: less than all others, equal for equal texts."""
    own = F.lit(_NAMELESS - 1) - F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit("")), F.lit(5)), 3)
    return docs.withColumn("doc_id", F.coalesce(F.col("doc_id"), own))


def real_id(c: str = "doc_id") -> Column:
    """The doc_id that numbered() was given: null for numbers of its own."""
    return F.when(F.col(c) >= _NAMELESS, F.col(c))


def crc_mod(col: str, mod: int) -> Column:
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod
