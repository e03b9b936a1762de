"""From raw documents to token ids: toxicity, exact and near duplicates, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  Null
counts as an empty text, of which exact de-duplication keeps one; repeated ids are judged by their
texts, and an empty table stays empty.  ``run`` writes
each stage's rows to the shared folder and reads them back, so a lost executor never sends the
work back beyond the stage it was in.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covenantry.llm import bpe, decontaminate, jaccard_join, radix_dedup, toxicity
from covenantry.llm.shared import documents, written

# The toxicity model and the token ids are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return radix_dedup.one_of_each(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets of five-word shingles that are alike by 0.8 or more."""
    return jaccard_join.one_of_each(docs, shingle=5, share=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of what is left."""
    ids = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("bpe encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
