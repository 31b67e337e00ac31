"""Joining accepted pairs with the prompts they came from."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_prompt_metadata(pairs: DataFrame, prompts: DataFrame) -> DataFrame:
    """Left join on ``prompt_index``; unknown indexes get nulls."""
    return pairs.join(prompts.drop("prompt", "chunk_text"), "prompt_index", "left")


def rag_pairs(
    accepted: DataFrame, prompts: DataFrame, project_id: str, job_id: str, provider: str, model: str
) -> DataFrame:
    """Stored form of accepted pairs generated from retrieved evidence."""
    joined = with_prompt_metadata(accepted, prompts)
    tag = (
        F.coalesce("source_type", F.lit("rag_ollama"))
        if provider == "ollama"
        else F.lit(f"rag_{provider}")
    )
    empty = F.array().cast("array<string>")
    scores = F.coalesce("retrieval_scores", F.array().cast("array<double>"))
    ids = F.coalesce(F.col("citation_chunk_ids").cast("array<string>"), empty)
    metadata = F.struct(
        F.lit(True).alias("rag"),
        F.lit(provider).alias("provider"),
        "query_term",
        "question_type",
        scores.alias("retrieval_scores"),
        ids.alias("citation_chunk_ids"),
        "citations",
        "source_filename",
    )
    return joined.select(
        _pair_id(job_id).alias("id"),
        F.lit(project_id).alias("project_id"),
        F.lit(job_id).alias("generation_job_id"),
        F.col("primary_chunk_id").cast("string").alias("chunk_id"),
        "question",
        "answer",
        tag.alias("source_type"),
        F.coalesce(F.nullif("source_filename", F.lit("")), "query_term").alias("source_document"),
        F.lit(model).alias("model_used"),
        F.lit(provider).alias("provider"),
        "quality_score",
        F.lit("pending").alias("validation_status"),
        F.lit(False).alias("human_edited"),
        metadata.alias("metadata"),
        *_carried(accepted),
    )


def sampled_pairs(
    accepted: DataFrame, prompts: DataFrame, project_id: str, job_id: str, provider: str, model: str
) -> DataFrame:
    """Stored form of accepted pairs generated from sampled chunks."""
    joined = with_prompt_metadata(accepted, prompts)
    origin = F.coalesce("source_type", F.lit("unknown"))
    family = F.when(origin == "PDF", "pdf").otherwise("pubmed")
    metadata = F.struct(
        F.lit(False).alias("rag"),
        F.lit(provider).alias("provider"),
        origin.alias("original_source"),
        F.col("source_filename").alias("original_file"),
    )
    return joined.select(
        _pair_id(job_id).alias("id"),
        F.lit(project_id).alias("project_id"),
        F.lit(job_id).alias("generation_job_id"),
        "question",
        "answer",
        F.concat(family, F.lit(f"_{provider}")).alias("source_type"),
        F.col("source_filename").alias("source_document"),
        F.lit(model).alias("model_used"),
        F.lit(provider).alias("provider"),
        "quality_score",
        F.lit("pending").alias("validation_status"),
        F.lit(False).alias("human_edited"),
        metadata.alias("metadata"),
        *_carried(accepted),
    )


def _pair_id(job_id: str):
    return F.sha2(F.concat_ws(":", F.lit(job_id), F.col("prompt_index").cast("string")), 256)


def _carried(accepted: DataFrame) -> list[str]:
    return [c for c in ("checks",) if c in accepted.columns]
