"""Validation of tables and JSON records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def check_schema(df: DataFrame, required: list[str], expected_rows: int | None = None) -> DataFrame:
    """check, detail, ok: a row per required column and, if asked for, one for the number of rows."""
    columns = df.agg(F.count("*").alias("n"))
    parts = [columns.select(F.lit("column").alias("check"), F.lit(c).alias("detail"), F.lit(c in df.columns).alias("ok")) for c in required]
    if expected_rows is not None:
        parts.append(columns.select(F.lit("rows").alias("check"), F.col("n").cast("string").alias("detail"), (F.col("n") == expected_rows).alias("ok")))
    return reduce(DataFrame.unionByName, parts)


def parse_json(df: DataFrame, col: str, schema: T.StructType) -> DataFrame:
    """Adds parsed and corrupt: a text that isn't JSON of the schema is kept in corrupt, and parsed is null."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    out = df.withColumn("_j", F.from_json(col, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_j").isNull() | F.col("_j._corrupt").isNotNull()
    return out.withColumns({"parsed": F.when(~bad, F.struct(*[F.col(f"_j.{f.name}").alias(f.name) for f in schema.fields])), "corrupt": F.when(bad, F.col(col))}).drop("_j")


def check_required(df: DataFrame, id: str, rules: list[tuple[str, str]]) -> DataFrame:
    """id, path, error of required fields that are missing, or don't read as the kind (int, double, boolean, string)."""
    kinds = {"int": "bigint", "double": "double", "boolean": "boolean"}
    errors = []
    for path, kind in rules:
        missing = F.col(path).isNull()
        wrong = F.col(path).cast("string").try_cast(kinds[kind]).isNull() if kind in kinds else F.lit(False)
        errors.append(F.when(missing, F.struct(F.lit(path).alias("path"), F.lit("missing").alias("error"))).when(wrong, F.struct(F.lit(path).alias("path"), F.lit(f"not {kind}").alias("error"))))
    return df.select(id, F.explode(F.filter(F.array(*errors), lambda e: e.isNotNull())).alias("e")).select(id, "e.path", "e.error")


PATTERNS = {"date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"}


def check_formats(df: DataFrame, id: str, rules: list[tuple[str, str, list[str]]]) -> DataFrame:
    """id, path, error: one row per value outside its enum, or not in date or e-mail form. Rules: (path, kind, allowed)."""
    errors = []
    for path, kind, allowed in rules:
        v = F.col(path).cast("string")
        bad = ~v.isin(allowed) if kind == "enum" else ~v.rlike(PATTERNS[kind])
        errors.append(F.when(v.isNotNull() & bad, F.struct(F.lit(path).alias("path"), F.lit(kind).alias("error"))))
    return df.select(id, F.explode(F.filter(F.array(*errors), lambda e: e.isNotNull())).alias("e")).select(id, "e.path", "e.error")
