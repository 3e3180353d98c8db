"""From documents to packed training sequences: the stages in order, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caseworks.llm.common import materialize, table
from caseworks.llm.decontaminate import stage_decontaminate
from caseworks.llm.langid import stage_language_id
from caseworks.llm.lines import stage_line_dedup
from caseworks.llm.minhash import stage_near_dedup
from caseworks.llm.packing import stage_packing

STAGES = [
    ("language_id", stage_language_id),
    ("line_dedup", stage_line_dedup),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("packing", stage_packing),
]

#: SQL can't express language ID, the MinHash stages and packing; tests/llm/test_corpus.py checks run() and its stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
