"""Edits and deletions as new table snapshots (plain files have no UPDATE)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edit_pairs(pairs: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply one edit per id; a null field stays, changing text marks the pair."""
    fields = [c for c in edits.columns if c != "id"]
    changed = edits.select("id", *[F.col(c).alias(f"_{c}") for c in fields])
    out = pairs.join(changed, "id", "left")
    texts = [F.col(f"_{c}").isNotNull() for c in ("question", "answer") if c in fields]
    if texts:
        rewritten = texts[0] if len(texts) == 1 else texts[0] | texts[1]
        out = out.withColumn("human_edited", F.col("human_edited") | rewritten)
    for c in fields:
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    return out.select(*pairs.columns)


def set_status(pairs: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """Set the status of the listed pairs."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return (
        pairs.join(hit, "id", "left")
        .withColumn(
            "validation_status",
            F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("validation_status")),
        )
        .select(*pairs.columns)
    )


def delete_rows(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    doomed = ids.select(F.col(ids.columns[0]).alias("_gone")).distinct()
    return table.join(doomed, table[key] == doomed["_gone"], "left_anti")


def delete_projects(tables: dict[str, DataFrame], project_ids: DataFrame) -> dict[str, DataFrame]:
    """Remove projects with everything that belongs to them.

    ``tables`` may hold: projects, sources, chunks, qa_pairs, quality_checks,
    user_feedback, generation_jobs, review_sessions, api_usage.
    """
    gone = project_ids.select(F.col(project_ids.columns[0]).alias("project_id")).distinct()
    out = dict(tables)
    for name in ("sources", "chunks", "qa_pairs", "generation_jobs", "review_sessions", "api_usage"):
        if name in tables:
            out[name] = delete_rows(tables[name], gone, "project_id")
    if "projects" in tables:
        out["projects"] = delete_rows(tables["projects"], gone, "id")
    if "qa_pairs" in tables:
        pair_ids = tables["qa_pairs"].join(gone, "project_id", "left_semi").select("id")
        for name in ("quality_checks", "user_feedback"):
            if name in tables:
                out[name] = delete_rows(tables[name], pair_ids, "qa_pair_id")
    if "api_usage" in tables and "review_sessions" in tables:
        sessions = tables["review_sessions"].join(gone, "project_id", "left_semi").select("id")
        out["api_usage"] = delete_rows(out["api_usage"], sessions, "review_session_id")
    return out


def accept_suggestions(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Replace answers by the suggestion of their fact check, keeping the old one.

    ``pairs`` holds ``fact_check`` and ``suggestion_applied`` structs; pairs
    without a suggestion are left alone.
    """
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    suggested = F.col("fact_check.suggested_answer")
    use = F.coalesce(F.col("_hit") & (suggested != ""), F.lit(False))
    applied = F.struct(
        F.col("answer").alias("old_answer"),
        F.lit("fact_check").alias("source"),
        F.coalesce("fact_check.factual_accuracy", F.lit(0.0)).alias("fact_check_score"),
    )
    return (
        pairs.join(hit, "id", "left")
        .withColumn("_use", use)
        .withColumn(
            "suggestion_applied", F.when(F.col("_use"), applied).otherwise(F.col("suggestion_applied"))
        )
        .withColumn("answer", F.when(F.col("_use"), suggested).otherwise(F.col("answer")))
        .withColumn("human_edited", F.col("_use") | F.col("human_edited"))
        .select(*pairs.columns)
    )


def revert_suggestions(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Put back the answer kept by :func:`accept_suggestions`."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    old = F.col("suggestion_applied.old_answer")
    return (
        pairs.join(hit, "id", "left")
        .withColumn("_use", F.coalesce(F.col("_hit") & old.isNotNull(), F.lit(False)))
        .withColumn("answer", F.when(F.col("_use"), old).otherwise(F.col("answer")))
        .withColumn(
            "suggestion_applied", F.when(~F.col("_use"), F.col("suggestion_applied"))
        )
        .select(*pairs.columns)
    )
