"""From raw documents to token ids, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet into the
shared folder and read again as the next stage's docs, so a lost executor never costs more than the
stage at hand. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeline.llm import bpe, langid, mixing, ngram_join, substring_dedup
from treeline.llm.common import Scratch

STAGES = [
    ("language_id", langid.stage),
    ("ngram_jaccard_join", ngram_join.stage),
    ("substring_dedup", substring_dedup.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents: doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of the mix."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return scratch.keep(docs)
