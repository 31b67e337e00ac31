"""The corpus pipeline: documents in, token ids out.

Stages, each on what the one before kept:

1. toxicity: documents that score 0.7 or more go;
2. near copies: of each group of linked documents the smallest id stays;
3. decontamination: documents that hold a window of a benchmark item go;
4. mixing: whole documents, some twice, in the proportions of their sources;
5. token ids: written as shards and read back, one row per document.

Nulls, empty texts, repeated rows, empty tables and further columns have the
results that the operators' modules state. SQL cannot express stages 1, 4 and
5, so there is no SQL for the run; the tests compare it with a plain version.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import decontamination, jaccard_join, mixing, token_ids, toxicity
from gleaner.llm.queries import table, tokenizer_path
from gleaner.session import checkpoint_folder


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_ids.tokenized(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxic_out),
    ("jaccard_join", near_copies_out),
    ("decontamination", benchmark_out),
    ("mixing", mixed),
    ("token_ids", token_output),
]

ORACLE_SQL = None  # a trained model, a subset-sum fit and a tokenizer are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table in the shared folder."""
    folder = f"{checkpoint_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
