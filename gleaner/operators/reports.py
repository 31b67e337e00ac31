"""Statistics and analytics over pairs, projects and runs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ["approved", "pending", "rejected"]


def reported_mean(score: Column) -> Column:
    """Mean to four decimals; a mean of zero is reported as null."""
    return F.nullif(F.round(F.avg(score), 4), F.lit(0.0))


def _status_counts() -> list[Column]:
    return [F.count_if(F.col("validation_status") == s).alias(s) for s in STATUSES]


def pair_stats(pairs: DataFrame) -> DataFrame:
    """Totals by status and the mean score, one pass."""
    return pairs.agg(
        F.count("*").alias("total"),
        *_status_counts(),
        reported_mean(F.col("quality_score")).alias("avg_quality_score"),
    )


def count_by(pairs: DataFrame, column: str, keep_null: bool = True) -> DataFrame:
    rows = pairs if keep_null else pairs.filter(F.col(column).isNotNull())
    return rows.groupBy(column).agg(F.count("*").alias("count"))


def count_by_source_type(pairs: DataFrame) -> DataFrame:
    return count_by(pairs, "source_type")


def count_by_model(pairs: DataFrame) -> DataFrame:
    return count_by(pairs, "model_used", keep_null=False)


def top_source_documents(pairs: DataFrame, n: int = 50) -> DataFrame:
    """Most frequent source documents; equal counts are ordered by name."""
    counts = count_by(pairs, "source_document", keep_null=False)
    return counts.orderBy(F.desc("count"), "source_document").limit(n)


def file_name(pairs: DataFrame) -> Column:
    """First non-empty name: document, original file, source file name, source file."""
    names = [c for c in ("source_document", "original_file", "source_filename", "source_file")
             if c in pairs.columns]
    return F.coalesce(
        *[F.nullif(F.col(c), F.lit("")) for c in names],
        F.concat(F.lit("("), F.col("source_type"), F.lit(")")),
    )


def by_file(pairs: DataFrame) -> DataFrame:
    """Per-file counts and mean score; the source type is that of the last row."""
    kind = F.col("source_type")
    if "original_source" in pairs.columns:
        kind = F.coalesce("original_source", kind)
    status = F.col("validation_status")
    return (
        pairs.groupBy(file_name(pairs).alias("filename"))
        .agg(
            F.max_by(kind, F.struct("created_at", "id")).alias("source_type"),
            F.count("*").alias("pair_count"),
            F.round(F.avg("quality_score"), 4).alias("avg_quality"),
            F.count_if(status == "approved").alias("approved"),
            F.count_if(status == "rejected").alias("rejected"),
            F.count_if(F.coalesce(~status.isin("approved", "rejected"), F.lit(True))).alias(
                "pending"
            ),
        )
    )


def with_approval_percent(files: DataFrame) -> DataFrame:
    """Share of approved pairs per file in percent, 0 for an empty file."""
    total = F.col("approved") + F.col("rejected") + F.col("pending")
    return files.withColumn(
        "approval_percent", F.when(total > 0, F.col("approved") / total * 100).otherwise(0.0)
    )


def quality_histogram(pairs: DataFrame) -> DataFrame:
    """Pairs per tenth of the score; empty tenths are absent."""
    bucket = F.least(F.floor(F.col("quality_score") * 10), F.lit(9))
    return (
        pairs.filter(F.col("quality_score").isNotNull())
        .groupBy(bucket.alias("bucket"))
        .agg(F.count("*").alias("count"))
        .select(
            F.format_string("%.1f-%.1f", F.col("bucket") / 10, (F.col("bucket") + 1) / 10).alias(
                "range"
            ),
            "count",
        )
    )


def daily_timeline(pairs: DataFrame) -> DataFrame:
    return (
        pairs.filter(F.col("created_at").isNotNull())
        .groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("date"))
        .agg(F.count("*").alias("count"))
    )


def project_rollup(
    projects: DataFrame, pairs: DataFrame, sources: DataFrame
) -> DataFrame:
    """Projects with pair, approval and source counts and mean score.

    Each child table is aggregated once by project before it is joined, so
    a project holding most rows is one row by then.
    """
    pair_side = pairs.groupBy("project_id").agg(
        F.count("*").alias("total_qa_pairs"),
        F.count_if(F.col("validation_status") == "approved").alias("total_approved"),
        reported_mean(F.col("quality_score")).alias("avg_quality_score"),
    )
    source_side = sources.groupBy("project_id").agg(F.count("*").alias("total_sources"))
    joined = projects.join(pair_side, projects["id"] == pair_side["project_id"], "left").drop(
        "project_id"
    )
    joined = joined.join(source_side, joined["id"] == source_side["project_id"], "left").drop(
        "project_id"
    )
    counts = ["total_qa_pairs", "total_approved", "total_sources"]
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def run_summary(pairs: DataFrame, job_id: str) -> DataFrame:
    """Long table of run totals: all pairs, pairs of the run, by source, by status.

    One aggregation over both keys feeds every line.
    """
    base = pairs.groupBy("source_type", "validation_status").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("generation_job_id") == job_id).alias("run"),
    )
    facts = F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("").alias("name"), F.col("n")),
        F.struct(F.lit("run").alias("kind"), F.lit("").alias("name"), F.col("run").alias("n")),
        F.struct(F.lit("source").alias("kind"), F.col("source_type").alias("name"), F.col("n")),
        F.struct(
            F.lit("status").alias("kind"), F.col("validation_status").alias("name"), F.col("n")
        ),
    )
    return (
        base.select(F.explode(facts).alias("f"))
        .groupBy("f.kind", "f.name")
        .agg(F.sum("f.n").alias("count"))
    )


def approval_rates(stats: DataFrame) -> DataFrame:
    """Approval and rejection rates in percent of all pairs, null without pairs."""
    total = F.col("total")
    return stats.withColumns(
        {
            f"{s}_rate": F.when(total > 0, F.col(s) / total * 100)
            for s in ("approved", "rejected")
        }
    )


def status_slices(stats: DataFrame) -> DataFrame:
    """Status counts as rows, zeros left out."""
    return stats.select(*STATUSES).unpivot([], STATUSES, "status", "count").filter("count > 0")


def chart_name(name: Column) -> Column:
    """Source type as a chart label."""
    return F.regexp_replace(F.upper(name), r"\A([^_]*)_", "$1 + ")


def short_name(name: Column) -> Column:
    """Names over 40 characters cut to 37 and an ellipsis."""
    return F.when(
        F.length(name) > 40, F.concat(F.substring(name, 1, 37), F.lit("…"))
    ).otherwise(name)


def top_documents_chart(pairs: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent documents with shortened names."""
    return top_source_documents(pairs, n).select(
        short_name(F.col("source_document")).alias("name"),
        F.col("source_document").alias("full_name"),
        "count",
    )


def latest_state(events: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """Last written state per key; equal times are settled by the larger values."""
    state = F.struct(*columns)
    return (
        events.groupBy(key)
        .agg(F.max_by(state, F.struct(F.col(at), *columns)).alias("state"), F.max(at).alias(at))
        .select(key, at, "state.*")
    )
