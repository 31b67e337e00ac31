"""Working tables: chunks, pairs and quality checks, appended or written by batch."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.validation import check_rows

COMMIT = "batch string, version long, attempt string, tables array<string>"


def append_chunks(chunks: DataFrame, path: str) -> None:
    """Partitioned by project, so that a project is read or dropped alone.

    A hash of the chunk id spreads a big project over many writers and files.
    """
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        chunks.repartition(parts, "project_id", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)))
        .write.mode("append")
        .partitionBy("project_id")
        .parquet(path)
    )


def append_pairs(pairs: DataFrame, pairs_path: str, checks_path: str) -> None:
    """Write pairs without their checks, and the checks as a long table."""
    check_rows(pairs, "id").write.mode("append").parquet(checks_path)
    pairs.drop("checks").write.mode("append").parquet(pairs_path)


def write_batch(folder: str, batch: str, tables: dict[str, DataFrame]) -> None:
    """Write the rows of a batch to several tables, visible together or not at all.

    Writing a batch again replaces its rows in every table, so a batch that is
    repeated after a failure doubles nothing. Each try goes to folders of its
    own; a line in ``commits``, one file written last, makes them current. A
    try that is lost half way leaves no line, and readers never see it. One
    writer a batch at a time; different batches may be written at once.
    """
    spark = next(iter(tables.values())).sparkSession
    attempt = uuid.uuid4().hex
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(_attempt_folder(folder, name, attempt))
    version = max((c["version"] for c in _commits(spark, folder) if c["batch"] == batch), default=-1) + 1
    line = spark.createDataFrame([(batch, version, attempt, sorted(tables))], COMMIT)
    line.coalesce(1).write.mode("append").parquet(f"{folder.rstrip('/')}/commits")


def write_pairs(folder: str, batch: str, pairs: DataFrame) -> None:
    """A batch of pairs without their checks, and its checks as a long table."""
    write_batch(folder, batch, {"pairs": pairs.drop("checks"), "checks": check_rows(pairs, "id")})


def read_batches(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The current rows of a table over all batches.

    Only folders of current tries are listed and read. A table no batch has
    written yet is an error.
    """
    newest: dict[str, tuple[int, str]] = {}
    for c in _commits(spark, folder):
        if table in c["tables"]:
            newest[c["batch"]] = max(newest.get(c["batch"], (-1, "")), (c["version"], c["attempt"]))
    if not newest:
        raise ValueError(f"no batch of {table} in {folder}")
    return spark.read.parquet(*[_attempt_folder(folder, table, a) for _, a in newest.values()])


def _attempt_folder(folder: str, table: str, attempt: str) -> str:
    return f"{folder.rstrip('/')}/{table}/{attempt}"


def _commits(spark: SparkSession, folder: str) -> list:
    """All lines of ``commits``: one a batch written, as many as a folder listing has."""
    path = f"{folder.rstrip('/')}/commits"
    spark.createDataFrame([], COMMIT).write.mode("append").parquet(path)  # it may be new
    return spark.read.schema(COMMIT).parquet(path).collect()
