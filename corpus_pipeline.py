"""The corpus pipeline: language ID, near-duplicates, repeated passages, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written before the next one reads it; all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import read_table, written
from millrace.llm.decontaminate import decontamination_stage
from millrace.llm.language import language_stage
from millrace.llm.packing import pack
from millrace.llm.simhash import simhash_stage
from millrace.llm.substring import substring_stage


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document in sequences of power-of-two lengths."""
    return pack(docs)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", simhash_stage),
    ("repeated_passages", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Not expressible: language scores, fingerprints and token ids are no SQL. tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
