"""Readers and writers: delimited text, monthly file sets, op-logs, document folders, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPLOG = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("entity", T.StructType([T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("properties", T.MapType(T.StringType(), T.StringType()))])),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("from", T.StringType()),
        T.StructField("rel", T.StringType()),
        T.StructField("to", T.StringType()),
        T.StructField("timestamp", T.StringType()),
    ]
)


def read_delimited(spark: SparkSession, path: str, sep: str = ",", encodings: tuple[str, ...] = ("utf-8", "gbk"), na_values: tuple[str, ...] = ("", "NA", "N/A", "null")) -> DataFrame:
    """All columns as strings, the given tokens null. The encoding is the first that reads the whole file without
    a replacement character, else the last."""
    chosen = encodings[-1]
    for e in encodings[:-1]:
        head = spark.read.option("encoding", e).option("sep", sep).csv(path)
        bad = head.where(F.exists(F.array(*head.columns), lambda x: F.contains(F.coalesce(x, F.lit("")), F.lit("�")))) if head.columns else head
        if bad.isEmpty():
            chosen = e
            break
    df = spark.read.option("header", True).option("inferSchema", False).option("encoding", chosen).option("sep", sep).csv(path)
    return df.select(*[F.when(~F.trim(F.col(f"`{c}`")).isin(list(na_values)), F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_file_set(spark: SparkSession, dir: str, month_prefix: str, patterns: dict[str, str]) -> dict[str, DataFrame]:
    """Logical table -> all files {month_prefix}*{name}*.csv of the folder, as strings."""
    return {table: spark.read.option("header", True).csv(f"{dir}/{month_prefix}*{name}*.csv") for table, name in patterns.items()}


def read_oplog(spark: SparkSession, path: str) -> DataFrame:
    """A log of JSON lines as seq, op, id, type, properties, src, rel, dst, timestamp."""
    raw = spark.read.schema(OPLOG).json(path)
    return raw.select("seq", "op", F.coalesce("entity.id", "id").alias("id"), F.col("entity.type").alias("type"), F.coalesce("entity.properties", "properties").alias("properties"), F.col("from").alias("src"), "rel", F.col("to").alias("dst"), "timestamp")


def read_documents(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("txt", "md")) -> DataFrame:
    """uri, content, content_hash, size of the text files under a folder with one of the extensions."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").text(path)
    return raw.select(F.input_file_name().alias("uri"), F.col("value").alias("content"), F.md5("value").alias("content_hash"), F.octet_length("value").cast("long").alias("size"))


def write_documents(df: DataFrame, path: str, key: str) -> None:
    """Each row's value as a text file of its own, all in one folder. Rows are dealt by the key to a fixed number of tasks,
    as a small table would else be one task's files, and each task moves its own files where they belong."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = df.repartition(tasks, key).select("value").write.option("maxRecordsPerFile", 1)
    files.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)


def write_export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """CSV with a header, quotes doubled (to be read with multiLine and escape '"'), or JSON lines with null fields."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True).option("escape", '"').csv if fmt == "csv" else writer.option("ignoreNullFields", False).json)(path)


def write_by_category(df: DataFrame, path: str, col: str) -> None:
    """One folder of Parquet files per value of the column."""
    df.write.mode("overwrite").partitionBy(col).parquet(path)
