"""Training corpus from documents: five stages, each a table that the next one reads.

Quality rules reject, line dedup takes repeated lines out of the texts, near duplicates keep one
document of each class, documents with benchmark passages go, and the rest is mixed to target
weights. Between stages stands a written table: it cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isotherm.llm import decontaminate, lines, mixing, neardup, quality
from isotherm.session import new_folder

STAGES = [
    ("quality_rules", quality.stage),
    ("line_dedup", lines.stage_all_lines),
    ("ngram_jaccard_join", neardup.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
]

# learned rules and MinHash pruning have no SQL form; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), new_folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
