"""Incremental ingest and validation with ``foreachBatch``."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.functions.vectors import Encoder, embed, hashing_encoder
from gleaner.operators.chunks import chunk_documents
from gleaner.operators.validation import validate_pairs
from gleaner.session import checkpointed

BUCKETS = 64  # of the chunk keys of an index


def _table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # nothing written yet
            return None
        raise


def ingest_documents(
    documents: DataFrame,
    index_path: str,
    checkpoint: str,
    encoder: Encoder = hashing_encoder,
    buckets: int = BUCKETS,
    **chunking,
) -> StreamingQuery:
    """Clean, chunk and embed arriving documents; add the chunks not indexed yet.

    A batch writes ``index_path/batch=<id>``, replaced if it is replayed, and
    the keys of its chunks to ``<index_path>_keys``, cut into buckets by hash.
    The index itself, with its texts and vectors, is never read: a batch looks
    up its chunks by their 8-byte hashes in the buckets they fall into, and
    reads chunk ids only for hashes found there, in the buckets of those.
    Equal chunks of one batch are kept once. ``<index_path>_arriving`` holds the
    chunks of the batch at work, so that texts are cut once. ``buckets`` must stay the same
    over the life of an index.
    """
    index_path = index_path.rstrip("/")
    keys_path, staged_path = f"{index_path}_keys", f"{index_path}_arriving"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        finger = F.xxhash64("chunk_id")
        chunk_documents(batch, **chunking).write.mode("overwrite").parquet(staged_path)
        chunks = spark.read.parquet(staged_path)
        ids = chunks.select("chunk_id").distinct().withColumns(
            {"finger": finger, "bucket": F.pmod(finger, F.lit(buckets)).cast("int")}
        )
        keys = _table_or_none(spark, keys_path)
        known = None if keys is None else keys.filter(F.col("batch") < batch_id)
        fresh = checkpointed(ids if known is None else _not_indexed(checkpointed(ids), known))
        # one shuffle by id serves the join, the copies of a batch and the encoder
        added = (
            chunks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk_id")
            .join(fresh.select("chunk_id"), "chunk_id", "left_semi")
            .dropDuplicates(["chunk_id"])
        )
        added.withColumn("vec", embed(F.col("content"), encoder)).write.mode("overwrite").parquet(
            f"{index_path}/batch={batch_id}"
        )
        (
            fresh.select("finger", "chunk_id", "bucket")
            .repartition(buckets, "bucket")  # one file a bucket, in the order of its hashes
            .sortWithinPartitions("bucket", "finger")
            .write.mode("overwrite")
            .partitionBy("bucket")
            .parquet(f"{keys_path}/batch={batch_id}")
        )

    return (
        documents.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _not_indexed(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """Chunks whose id is not in the keys: hashes first, ids for those that meet."""

    def inside(rows: DataFrame) -> DataFrame:
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # as many as buckets
        return known.filter(F.col("bucket").isin(touched))

    suspects = checkpointed(chunks.join(inside(chunks).select("finger"), "finger", "left_semi"))
    if suspects.isEmpty():
        return chunks
    ids = suspects.select("bucket", "finger", "chunk_id").join(
        inside(suspects).select("finger", "chunk_id"), ["finger", "chunk_id"], "left_semi"
    )
    return chunks.join(ids.select("chunk_id"), "chunk_id", "left_anti")


def validate_stream(
    pairs: DataFrame,
    position: str,
    outcome_path: str,
    checkpoint: str,
    min_score: float = 0.4,
    **options,
) -> StreamingQuery:
    """Validate arriving pairs against everything accepted before.

    Each batch writes its own folder, replaced if the batch is replayed;
    questions accepted by earlier batches are the seeds of the next.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = _table_or_none(spark, outcome_path)
        seeds = None
        if known is not None:
            seeds = known.filter(F.col("accepted") & (F.col("batch") < batch_id)).select(
                F.col(position).alias("position"), "question"
            )
        out = validate_pairs(batch, position, min_score, seeds, **options)
        out.write.mode("overwrite").parquet(f"{outcome_path}/batch={batch_id}")

    return (
        pairs.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
