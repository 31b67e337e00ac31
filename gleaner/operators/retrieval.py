"""Source-diverse evidence retrieval over an embedding table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.vectors import Encoder, embed, hashing_encoder
from gleaner.operators.similar_vectors import cosine_pairs

MIN_SCORE = 0.25
MAX_PER_SOURCE = 3
POOL = 10  # candidates considered per result wanted


def embed_chunks(chunks: DataFrame, encoder: Encoder = hashing_encoder) -> DataFrame:
    """Chunks with their vectors; dealt out first, as encoding is costly per row."""
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chunks.repartition(parts, "content").withColumn("vec", embed(F.col("content"), encoder))


def append_embeddings(
    indexed: DataFrame, chunks: DataFrame, encoder: Encoder = hashing_encoder
) -> DataFrame:
    """Embedding rows for the chunks not indexed yet; unchanged ones are skipped."""
    fresh = chunks.join(indexed.select("chunk_id"), "chunk_id", "left_anti")
    return embed_chunks(fresh, encoder)


def drop_project_embeddings(indexed: DataFrame, project_id: str) -> DataFrame:
    return indexed.filter(~F.col("project_id").eqNullSafe(project_id))


def scored_hits(
    queries: DataFrame, chunks: DataFrame, pool: int, min_score: float = MIN_SCORE
) -> DataFrame:
    """Best ``pool`` chunks per query: ``(query, chunk_id, source_filename, score, pool_rank)``.

    ``queries(query, vec)``; ``chunks(chunk_id, source_filename, vec)``. Ties
    go to the smaller chunk id. Queries and chunks meet in the tiles of the
    vector join, each of which keeps its best ``pool`` per query; those are
    merged by query, and no query vector visits the driver.
    """
    order = Window.partitionBy("query").orderBy(F.desc("score"), "chunk_id")
    best = (
        _near(queries, chunks, min_score, pool)
        .withColumn("pool_rank", F.row_number().over(order))
        .filter(F.col("pool_rank") <= pool)
    )
    return best.join(chunks.select("chunk_id", "source_filename"), "chunk_id").select(
        "query", "chunk_id", "source_filename", "score", "pool_rank"
    )


def all_hits(queries: DataFrame, chunks: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Every chunk at or above the score: ``(query, chunk_id, source_filename, score)``."""
    return _near(queries, chunks, min_score).join(chunks.select("chunk_id", "source_filename"), "chunk_id").select(
        "query", "chunk_id", "source_filename", "score"
    )


def _near(queries: DataFrame, chunks: DataFrame, min_score: float, best: int | None = None) -> DataFrame:
    return cosine_pairs(
        queries.select(F.col("query").alias("lid"), "vec"),
        chunks.select(F.col("chunk_id").alias("rid"), "vec"),
        min_score,
        best=best,
    ).select(F.col("lid").alias("query"), F.col("rid").alias("chunk_id"), "score")


def plain_top_k(hits: DataFrame, k: int) -> DataFrame:
    return hits.filter(F.col("pool_rank") <= k).withColumnRenamed("pool_rank", "rank")


def diverse_top_k(hits: DataFrame, k: int, max_per_source: int = MAX_PER_SOURCE) -> DataFrame:
    """Round-robin over sources, best source first, then by score.

    Round ``r`` takes every source's ``r``-th chunk, so ordering by (place in
    source, best place of the source) gives the same first ``k``.
    """
    in_source = Window.partitionBy("query", "source_filename")
    in_query = Window.partitionBy("query")
    turns = (
        hits.filter(F.col("pool_rank") <= POOL * k)
        .withColumn("turn", F.row_number().over(in_source.orderBy("pool_rank")))
        .withColumn("lead", F.min("pool_rank").over(in_source))
        .filter(F.col("turn") <= max_per_source)
        .withColumn("pick", F.row_number().over(in_query.orderBy("turn", "lead")))
        .filter(F.col("pick") <= k)
    )
    return turns.withColumn("rank", F.row_number().over(in_query.orderBy("pool_rank"))).select(
        "query", "rank", "chunk_id", "source_filename", "score"
    )


def with_chunk_text(selected: DataFrame, chunks: DataFrame) -> DataFrame:
    """Attach chunk text and metadata to retrieval results."""
    details = chunks.drop("vec", "source_filename")
    return selected.join(details, "chunk_id")


def retrieve(
    topics: DataFrame,
    chunks: DataFrame,
    top_k: int = 5,
    min_score: float = MIN_SCORE,
    diverse: bool = True,
    encoder: Encoder = hashing_encoder,
) -> DataFrame:
    """Evidence for every topic in one job, with text and index size.

    ``topics(query)`` or ``topics(query, vec)``.
    """
    queries = (
        topics if "vec" in topics.columns else topics.withColumn("vec", embed(F.col("query"), encoder))
    )
    pool = POOL * top_k if diverse else 2 * top_k
    hits = scored_hits(queries, chunks, pool, min_score)
    selected = diverse_top_k(hits, top_k) if diverse else plain_top_k(hits, top_k)
    return with_chunk_text(selected, chunks).withColumn("total_indexed", F.lit(chunks.count()))


def citation(score: Column) -> Column:
    """Citation struct of a retrieved chunk."""
    return F.struct(
        "chunk_id",
        "source_id",
        "source_filename",
        "chunk_index",
        F.round(score, 4).alias("score"),
        "word_count",
        F.substring("content", 1, 200).alias("content_preview"),
    )


def evidence_lists(retrieved: DataFrame, *keys: str) -> DataFrame:
    """Per query (and ``keys``): chunk ids, scores, citations and texts by rank."""
    rows = F.sort_array(
        F.collect_list(
            F.struct(
                "rank",
                F.col("score").alias("raw_score"),
                F.col("content").alias("text"),
                citation(F.col("score")).alias("cited"),
            )
        )
    )
    return (
        retrieved.groupBy("query", *keys)
        .agg(rows.alias("rows"))
        .select(
            "query",
            *keys,
            F.transform("rows", lambda r: r["cited"]["chunk_id"]).alias("citation_chunk_ids"),
            F.transform("rows", lambda r: r["raw_score"]).alias("retrieval_scores"),
            F.transform("rows", lambda r: r["cited"]).alias("citations"),
            F.transform(
                "rows",
                lambda r: F.struct(
                    r["cited"]["chunk_id"].alias("chunk_id"),
                    r["cited"]["source_filename"].alias("source_filename"),
                    r["text"].alias("content"),
                ),
            ).alias("evidence"),
        )
    )
