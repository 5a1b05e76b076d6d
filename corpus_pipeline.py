"""The corpus pipeline: each stage reads what its predecessor kept, its decisions take effect, the last one packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillwork.llm.common import stage, table
from quillwork.llm.stages import decontaminated, packed, quality_kept, secrets_masked, simhash_kept

#: (name, function); a function takes (spark, docs, sf_dir). All but the last return the columns of `documents`.
STAGES = [
    ("quality_classifier", quality_kept),
    ("simhash_near_dedup", simhash_kept),
    ("benchmark_decontamination", decontaminated),
    ("secret_scan", secrets_masked),
    ("best_fit_packing", packed),
]

#: The classifier is trained, fingerprints need XXH64 and packing a tokenizer: no SQL expresses these; tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
