"""Dataset exports: every format is a projection plus a Spark writer."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.listing import filter_for_export
from gleaner.operators.splits import SPLITS, split_exact

ASSISTANT = "You are a knowledgeable medical assistant."  # fixed value

EXPORT_COLUMNS = [
    "question", "answer", "source_type", "quality_score", "validation_status",
    "rag", "query_term", "citation_chunk_ids", "retrieval_scores",
]


def export_rows(pairs: DataFrame) -> DataFrame:
    """Project stored pairs for export; absent evidence gets empty defaults.

    ``pairs.metadata`` is a struct with (some of) rag, query_term,
    citation_chunk_ids, retrieval_scores and citations.
    """
    have = set(pairs.schema["metadata"].dataType.names) if "metadata" in pairs.columns else set()

    def meta(field: str, kind: str, default: Column) -> Column:
        value = F.col(f"metadata.{field}") if field in have else F.lit(None)
        return F.coalesce(value.cast(kind), default).alias(field)

    rows = [
        "question", "answer",
        F.coalesce("source_type", F.lit("")).alias("source_type"),
        "quality_score",
        F.coalesce("validation_status", F.lit("")).alias("validation_status"),
        meta("rag", "boolean", F.lit(False)),
        meta("query_term", "string", F.lit("")),
        meta("citation_chunk_ids", "array<string>", F.array().cast("array<string>")),
        meta("retrieval_scores", "array<double>", F.array().cast("array<double>")),
    ]
    if "citations" in have:
        rows.append(F.col("metadata.citations").alias("citations"))
    keep = [c for c in ("split",) if c in pairs.columns]
    return pairs.select(*rows, *keep)


def _evidence(*fields: str) -> list[Column]:
    """Evidence fields, null (so left out of JSON) for pairs without evidence."""
    return [F.when(F.col("rag"), F.col(f)).alias(f) for f in fields]


def csv_rows(rows: DataFrame) -> DataFrame:
    def flag(c: str) -> Column:
        return F.when(F.col(c), "True").otherwise("False").alias(c)

    scores = F.transform("retrieval_scores", lambda s: F.format_string("%.4f", s))
    return rows.select(
        *EXPORT_COLUMNS[:5],
        flag("rag"),
        "query_term",
        F.array_join("citation_chunk_ids", ";").alias("citation_chunk_ids"),
        F.array_join(scores, ";").alias("retrieval_scores"),
    )


def training_lines(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.concat(F.lit("question: "), "question", F.lit(" answer: "), "answer").alias("value")
    )


def json_records(rows: DataFrame) -> DataFrame:
    """Full records, one JSON object per line."""
    extra = ["citations"] if "citations" in rows.columns else []
    evidence = ["rag", "query_term", "citation_chunk_ids", "retrieval_scores", *extra]
    keep = {"ignoreNullFields": "false"}  # a missing score is written as null
    plain = F.to_json(F.struct(*EXPORT_COLUMNS[:5]), keep)
    return rows.select(
        F.when(F.col("rag"), F.to_json(F.struct(*EXPORT_COLUMNS[:5], *evidence), keep)).otherwise(plain).alias("value")
    )


def jsonl_records(rows: DataFrame) -> DataFrame:
    record = F.struct(
        "question", "answer",
        *_evidence("rag", "query_term", "citation_chunk_ids", "retrieval_scores"),
    )
    return rows.select(F.to_json(record).alias("value"))


def instruction_records(rows: DataFrame) -> DataFrame:
    record = F.struct(
        F.col("question").alias("instruction"), F.lit("").alias("input"),
        F.col("answer").alias("output"),
    )
    return rows.select(F.to_json(record).alias("value"))


def chat_records(rows: DataFrame) -> DataFrame:
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    messages = F.array(
        message("system", F.lit(ASSISTANT)),
        message("user", F.col("question")),
        message("assistant", F.col("answer")),
    )
    return rows.select(F.to_json(F.struct(messages.alias("messages"))).alias("value"))


def parquet_rows(rows: DataFrame, lists_as_json: bool = False) -> DataFrame:
    """Typed rows; with ``lists_as_json`` list columns become JSON text, empty ones ''."""
    if not lists_as_json:
        return rows.select(*EXPORT_COLUMNS)

    def text(c: str) -> Column:
        return F.when(F.size(c) > 0, F.to_json(c)).otherwise("").alias(c)

    return rows.select(
        *EXPORT_COLUMNS[:7], text("citation_chunk_ids"), text("retrieval_scores")
    )


def _write_text(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").text(path)


def _write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").options(header=True, quote='"', escape='"').csv(path)


def _write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


FORMATS: dict[str, tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame, str], None], str]] = {
    "csv": (csv_rows, _write_csv, ".csv"),
    "json": (json_records, _write_text, ".json"),
    "jsonl": (jsonl_records, _write_text, ".jsonl"),
    "alpaca": (instruction_records, _write_text, ".jsonl"),
    "openai": (chat_records, _write_text, ".jsonl"),
    "parquet": (parquet_rows, _write_parquet, ".parquet"),
}


def write_export(rows: DataFrame, fmt: str, folder: str, base_name: str = "dataset") -> str:
    """Write exported rows in a named format; returns the output folder."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported export format: {fmt}")
    shape, write, extension = FORMATS[fmt]
    path = f"{folder.rstrip('/')}/{base_name}{extension}"
    write(shape(rows), path)
    return path


def write_training_text(rows: DataFrame, path: str) -> str:
    _write_text(training_lines(rows), path)
    return path


def base_name(domain: str, stamp: str) -> str:
    return f"{domain.replace(' ', '_').replace('/', '_')}_{stamp}"


def export_project(
    pairs: DataFrame,
    folder: str,
    fmt: str,
    project_id: str,
    domain: str,
    stamp: str,
    generation_job_id: str | None = None,
    statuses: tuple[str, ...] = (),
    min_quality_score: float | None = None,
    train: float = 1.0,
    val: float = 0.0,
    seed: int = 42,
) -> dict[str, str]:
    """Filter, split and write a project's pairs; returns the output per split.

    With ``train`` below 1 the pairs go to up to three outputs, empty ones
    are skipped. No matching pair is an error.
    """
    wanted = filter_for_export(pairs, project_id, generation_job_id, statuses, min_quality_score)
    if wanted.isEmpty():
        raise ValueError("no pairs match the export filters")
    name = base_name(domain, stamp)
    if train >= 1.0:
        return {"all": write_export(export_rows(wanted), fmt, folder, name)}
    rows = export_rows(split_exact(wanted, "id", train, val, seed))
    sizes = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    return {
        s: write_export(rows.filter(F.col("split") == s), fmt, folder, f"{name}_{s}")
        for s in SPLITS
        if sizes.get(s)
    }
