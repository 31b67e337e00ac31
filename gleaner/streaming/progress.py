"""Latest run state and running counters over event streams."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

TERMINAL = ["completed", "failed", "cancelled"]  # fixed values


def latest_progress(events: DataFrame) -> DataFrame:
    """Last state per run from ``(job_id, ts, percentage, message, status)``.

    The first terminal state ends a run: later events of the run no longer
    count. Runs on a stream in update mode or on a table.
    """
    state = F.struct("percentage", "message", "status")
    done = F.col("status").isin(TERMINAL)
    return (
        events.groupBy("job_id")
        .agg(
            F.min_by(F.struct("ts", state.alias("state")), F.when(done, F.struct("ts", state))).alias(
                "end"
            ),
            F.max_by(F.struct("ts", state.alias("state")), F.struct("ts", state)).alias("last"),
        )
        .select("job_id", F.coalesce("end", "last").alias("now"))
        .select("job_id", "now.ts", "now.state.percentage", "now.state.message", "now.state.status")
    )


def running_counts(outcomes: DataFrame) -> DataFrame:
    """Validated rows per outcome; the reason of accepted rows reads ``accepted``."""
    return outcomes.groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(
        F.count("*").alias("count")
    )


def start_memory_query(df: DataFrame, name: str, mode: str) -> StreamingQuery:
    """Keep a small aggregated result queryable under ``name``."""
    return df.writeStream.outputMode(mode).format("memory").queryName(name).start()
