"""A corpus in five stages: rules, near duplicates, repeated passages, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratamart.llm.packing import pack, pieces
from stratamart.llm.queries import TOKENIZER, table
from stratamart.llm.stages import dedup_stage, mixing_stage, passages_stage, rules_stage
from stratamart.session import ship_package, stable


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document of the mix, packed: one row per piece."""
    ship_package(spark)
    return pack(pieces(docs, TOKENIZER))


STAGES = [
    ("quality_rules", rules_stage),
    ("minhash_near_dedup", dedup_stage),
    ("suffix_array_dedup", passages_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

# tree scores, signatures, byte-wise passages and tokenizers have no SQL form; tests/llm compares
# the stages with plain versions
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the ``documents`` of ``sf_dir``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
