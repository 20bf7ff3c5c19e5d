"""From raw documents to packed training sequences, five operators one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared
folder and reads it back as the next stage's input, so a lost executor costs at most one stage. All stages
but the last return rows with the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docketscope.llm import stages
from docketscope.session import ensure_checkpoint_dir

STAGES = [
    ("quality rules", stages.quality_rules),
    ("near-duplicates", stages.near_duplicates),
    ("personal data", stages.personal_data),
    ("mixing", stages.mixing),
    ("packing", stages.packing),
]

# The stages work on sketches, sampled hashes, spans, a dynamic program and token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
