"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster names it; where it is unset (tests, local runs) a new folder per application."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        app = spark.sparkContext.applicationId
        if app not in _made:
            _made[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        at = _made[app]
    return at.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """df checkpointed into the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


#: Spark's setting that drops the shuffle files of an execution when it ends, not when the driver collects garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed inside go as soon as it has ended. For writes: what was written is read from the
    shared folder from then on, so nothing needs these files again; while a write runs, lost ones are made again as ever."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def written(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """df written as Parquet into the shared folder and read back: cuts the lineage like a checkpoint, but is smaller, and later
    reads take only the columns and rows that they need. With free it is written tightly, and its shuffles go (shuffles_freed)."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(df.sparkSession) if free else nullcontext():
        (df.write.option("compression", "zstd") if free else df.write).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
