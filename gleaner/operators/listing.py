"""Filters, sorting, paging and lookups over the pair and project tables."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EQUAL_FILTERS = [
    "project_id", "generation_job_id", "source_type", "source_document",
    "validation_status", "model_used",
]


def text_search(term: str) -> Column:
    """Case-insensitive match in question or answer; % and _ are wildcards."""
    pattern = f"%{term}%"
    return F.col("question").ilike(pattern) | F.col("answer").ilike(pattern)


def filter_pairs(
    pairs: DataFrame,
    search: str | None = None,
    min_quality_score: float | None = None,
    max_quality_score: float | None = None,
    **equals: str | None,
) -> DataFrame:
    """Pairs matching every filter given; score bounds leave out null scores."""
    unknown = set(equals) - set(EQUAL_FILTERS)
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    for column, value in equals.items():
        if value:
            pairs = pairs.filter(F.col(column) == value)
    if min_quality_score is not None:
        pairs = pairs.filter(F.col("quality_score") >= min_quality_score)
    if max_quality_score is not None:
        pairs = pairs.filter(F.col("quality_score") <= max_quality_score)
    return pairs.filter(text_search(search)) if search else pairs


def filter_for_export(
    pairs: DataFrame,
    project_id: str,
    generation_job_id: str | None = None,
    statuses: Iterable[str] = (),
    min_quality_score: float | None = None,
) -> DataFrame:
    out = filter_pairs(
        pairs,
        project_id=project_id,
        generation_job_id=generation_job_id,
        min_quality_score=min_quality_score,
    )
    wanted = list(statuses)
    return out.filter(F.col("validation_status").isin(wanted)) if wanted else out


def page(df: DataFrame, *order: Column, number: int = 1, size: int = 25) -> DataFrame:
    """One page of a sorted listing."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def newest_pairs(pairs: DataFrame, number: int = 1, size: int = 25) -> DataFrame:
    return page(pairs, F.desc("created_at"), F.col("id"), number=number, size=size)


def newest_projects(
    projects: DataFrame, status: str | None = None, number: int = 1, size: int = 25
) -> DataFrame:
    rows = with_status(projects, status)
    return page(rows, F.desc("updated_at"), F.col("id"), number=number, size=size)


def newest_first(df: DataFrame, at: str = "created_at") -> DataFrame:
    """Whole table, newest first."""
    return df.orderBy(F.desc(at), "id")


def page_counts(df: DataFrame, size: int = 25) -> DataFrame:
    """Row and page totals of a listing."""
    total = F.count("*")
    return df.agg(
        total.alias("total"), F.floor((total + size - 1) / size).cast("long").alias("total_pages")
    )


def with_status(df: DataFrame, status: str | None) -> DataFrame:
    return df.filter(F.col("status") == status) if status else df


def active_projects(projects: DataFrame) -> DataFrame:
    return projects.filter(F.col("status").isin("draft", "active"))


def archived_projects(projects: DataFrame) -> DataFrame:
    return projects.filter(F.col("status") == "archived")


def of_type(sources: DataFrame, *types: str) -> DataFrame:
    return sources.filter(F.col("file_type").isin(*types))


def by_ids(df: DataFrame, ids: DataFrame, project_id: str | None = None) -> DataFrame:
    """Rows whose id is listed, optionally of one project."""
    rows = df if project_id is None else df.filter(F.col("project_id") == project_id)
    return rows.join(ids.select("id"), "id", "left_semi")
