"""Chunk tables from documents and articles."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.chunking import chunk_article, create_chunks
from gleaner.functions.text import clean_text, word_count
from gleaner.operators.ranking import with_running_total
from gleaner.session import checkpointed
from gleaner.sources.articles import display_name, has_full_text

ARTICLE_SOURCE = "pubmed_articles"  # fixed value: all article chunks share one source


def chunk_id(source: Column, index: Column, content: Column) -> Column:
    """Content-derived id: a rerun yields the same ids."""
    return F.sha2(F.concat_ws(":", source, index.cast("string"), content), 256)


def chunk_documents(
    documents: DataFrame, strategy: str = "word_count", chunk_size: int = 500, overlap: int = 50
) -> DataFrame:
    """Chunks of ``documents(source_id, project_id, filename, text)``.

    Clean, chunk and number within one row: no shuffle.
    """
    pieces = create_chunks(clean_text(F.col("text")), strategy, chunk_size, overlap)
    return (
        documents.select("source_id", "project_id", "filename", F.posexplode(pieces))
        .withColumnsRenamed({"pos": "chunk_index", "col": "content"})
        .select(
            chunk_id(F.col("source_id").cast("string"), F.col("chunk_index"), F.col("content")).alias(
                "chunk_id"
            ),
            "source_id",
            "project_id",
            F.col("filename").alias("source_filename"),
            F.lit("PDF").alias("source_type"),
            "chunk_index",
            "content",
            word_count(F.col("content")).alias("word_count"),
        )
    )


def processing_status(sources: DataFrame, extracted: DataFrame) -> DataFrame:
    """Sources marked completed, or failed with the reason when text is missing."""
    found = extracted.select("path", F.col("text").alias("_text"), F.col("error").alias("_error"))
    ok = F.coalesce(F.col("_text") != "", F.lit(False))
    return (
        sources.join(found, sources["filepath"] == found["path"], "left")
        .withColumn("processing_status", F.when(ok, "completed").otherwise("failed"))
        .withColumn(
            "error_message", F.when(~ok, F.coalesce("_error", F.lit("no text extracted")))
        )
        .drop("_text", "_error", "path")
    )


def chunk_articles(
    articles: DataFrame,
    project_id: str,
    strategy: str = "word_count",
    chunk_size: int = 500,
    overlap: int = 50,
) -> DataFrame:
    """Chunks of ``articles(position, pmid, title, abstract, full_text, sections)``.

    Articles with full text are cut by section, others by strategy on the
    cleaned abstract. One running index counts through all articles, in the
    order of position and pmid: only a row of counts per article is sorted.
    """
    full = has_full_text(F.col("full_text"))
    by_section = chunk_article(
        F.col("full_text"), F.col("abstract"), F.col("sections"), chunk_size, overlap
    )
    by_strategy = F.transform(
        create_chunks(clean_text(F.col("abstract")), strategy, chunk_size, overlap),
        lambda c: F.struct(c.alias("content"), F.lit("abstract").alias("section")),
    )
    named = articles.withColumn("display_name", display_name(F.col("title"), F.col("pmid")))
    pieces = named.filter(full).withColumn("_chunks", by_section).unionByName(
        named.filter(~full).withColumn("_chunks", by_strategy)
    )
    # stored, so that texts are cut once and row numbers stay
    cut = checkpointed(
        pieces.select("position", "pmid", "display_name", "_chunks", F.monotonically_increasing_id().alias("_row"))
    )
    starts = with_running_total(
        cut.select("position", "pmid", "_row", F.size("_chunks").cast("long").alias("_n")),
        "_n", F.col("position"), F.col("pmid"), F.col("_row"), name="_start",
    )
    ranked = (
        cut.join(starts.select("_row", "_start"), "_row")
        .select("display_name", "_start", F.posexplode("_chunks"))
        .select("display_name", (F.col("_start") + F.col("pos")).alias("chunk_index"), "col.content", "col.section")
    )
    return ranked.select(
        chunk_id(F.lit(ARTICLE_SOURCE), F.col("chunk_index"), F.col("content")).alias("chunk_id"),
        F.lit(ARTICLE_SOURCE).alias("source_id"),
        F.lit(project_id).alias("project_id"),
        F.lit(ARTICLE_SOURCE).alias("source_filename"),
        "display_name",
        F.lit("PubMed").alias("source_type"),
        "chunk_index",
        "section",
        "content",
        word_count(F.col("content")).alias("word_count"),
    )


def with_source_name(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Attach the file name of each chunk's source, ``unknown`` when missing."""
    names = sources.select("source_id", F.col("filename").alias("source_filename"))
    return chunks.join(names, "source_id", "left").withColumn(
        "source_filename", F.coalesce("source_filename", F.lit("unknown"))
    )


def all_chunks(documents: DataFrame, articles: DataFrame) -> DataFrame:
    """Document and article chunks in one table."""
    return documents.unionByName(articles, allowMissingColumns=True)
