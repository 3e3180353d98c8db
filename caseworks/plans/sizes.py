"""Broadcasting behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side is broadcast up to this estimate; beyond it the optimiser joins by shuffle.
BROADCAST_BYTES = 32 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's size estimate of a plan (file sizes for scans; huge where it knows nothing)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its estimate is under the limit, else df as it is."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def few(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df marked for broadcast if it has few rows: for small rows whose plan the optimiser can't estimate, such as
    checkpoints. It is counted, so it should be cheap to read."""
    return F.broadcast(df) if df.count() <= rows else df
