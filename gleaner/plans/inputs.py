"""Working tables derived by Spark from the given test tables.

The registered queries read these: whole tables, whole texts.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows: ``(conv_id, turn, asked, replied)``."""
    talk = table(spark, sf_dir, "conversations")
    asked = talk.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("asked"))
    replied = talk.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("replied")
    )
    return asked.join(replied, ["conv_id", "turn"])


def picked(index: Column, *names: str) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index % len(names)).cast("int") + 1)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question/answer pairs with every column the reports and filters use."""
    c = F.col("conv_id")
    question = F.when(c % 7 == 0, F.col("asked")).otherwise(
        F.concat(F.lit("What is "), "asked", F.lit("?"))
    )
    answer = (
        F.when(c % 11 == 0, F.lit("NOT FOUND"))
        .when(c % 13 == 0, F.concat("replied", F.lit("...")))
        .when(c % 17 == 0, F.concat(F.lit("As an AI "), "replied", F.lit(".")))
        .otherwise(F.concat("replied", F.lit(".")))
    )
    score = ((c * 37 + F.col("turn") * 11) % 101) / F.lit(101.0)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return turns(spark, sf_dir).select(
        (c * 100 + F.col("turn")).alias("id"),
        "conv_id",
        F.concat(F.lit("p"), (c % 5).cast("string")).alias("project_id"),
        F.concat(F.lit("job"), (c % 4).cast("string")).alias("generation_job_id"),
        question.alias("question"),
        answer.alias("answer"),
        picked(c, "medquad", "rag_ollama", "pdf_ollama", "pubmed_ollama").alias("source_type"),
        F.when(c % 6 != 0, F.concat(F.lit("doc"), (c % 9).cast("string"))).alias("source_document"),
        F.when(c % 5 != 0, picked(c, "gpt-4o", "gpt-4o-mini", "llama3")).alias("model_used"),
        F.when(c % 8 != 0, score).alias("quality_score"),
        picked(c, "approved", "pending", "rejected").alias("validation_status"),
        F.lit(False).alias("human_edited"),
        F.timestamp_add("HOUR", (c * 7).cast("int"), start).alias("created_at"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("doc_id").alias("source_id"),
        F.lit("p0").alias("project_id"),
        F.col("source").alias("filename"),
        "text",
        "lang",
        "n_chars",
    )


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded chunks: every vector, with the document of the same number as text."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        F.concat(F.lit("src"), F.col("label").cast("string")).alias("source_filename"),
        F.col("label").alias("source_id"),
        F.concat(F.lit("p"), (F.col("vec_id") % 5).cast("string")).alias("project_id"),
        (F.col("vec_id") % 40).cast("int").alias("chunk_index"),
        F.col("embedding").alias("vec"),
    )
    texts = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")
    )
    return (
        vectors.join(texts, "chunk_id", "left")
        .withColumn("content", F.coalesce("content", F.lit("")))
        .withColumn("word_count", F.length("content"))
    )


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per label: its first vector."""
    return (
        table(spark, sf_dir, "embeddings")
        .groupBy("label")
        .agg(F.min_by("embedding", "vec_id").alias("vec"))
        .select(
            F.col("label").cast("long").alias("position"),
            F.concat(F.lit("topic"), F.col("label").cast("string")).alias("query"),
            "vec",
        )
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"),
        F.col("c_name").alias("name"),
        picked(k, "draft", "active", "archived").alias("status"),
        F.timestamp_add("MINUTE", (k * 13).cast("int"), start).alias("updated_at"),
    )


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the part of pairs: children of the projects above."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("project_id"),
        F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending").alias(
            "validation_status"
        ),
        ((F.col("o_orderkey") % 101) / F.lit(101.0)).alias("quality_score"),
    )


def article_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the part of articles; even ones have full text in two sections."""
    docs = table(spark, sf_dir, "documents")
    even = F.col("doc_id") % 2 == 0
    sections = F.array(
        F.struct(F.lit("Methods").alias("name"), F.col("text").alias("text")),
        F.struct(
            F.lit("Final Results").alias("name"), F.concat_ws(" ", "lang", "text").alias("text")
        ),
    )
    return docs.select(
        F.col("doc_id").alias("position"),
        F.col("doc_id").cast("string").alias("pmid"),
        F.concat_ws(" ", F.lit("Article"), "source", "lang").alias("title"),
        F.col("text").alias("abstract"),
        F.when(even, F.col("text")).alias("full_text"),
        F.when(even, sections).alias("sections"),
    )


def escaped(text: Column) -> Column:
    """Text made safe inside an XML element; control characters are not XML."""
    safe = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(raw), F.lit(name))
    return safe


def review_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw review replies per labelled document, with every kind of defect planted."""
    d = F.col("doc_id")
    n = d % 13
    overall = F.when(d % 5 == 0, F.lit('"high"')).otherwise(n.cast("string"))
    body = F.concat(
        F.lit('{"accuracy": '), (d % 11).cast("string"),
        F.when(d % 7 == 0, F.lit("")).otherwise(F.lit(', "completeness": 7')),
        F.lit(', "clarity": 6.5, "relevance": '), (F.col("quality") * 9).cast("string"),
        F.lit(', "overall": '), overall,
        F.lit(', "recommendation": "'),
        picked(d, "approve", "revise", "reject", "maybe"),
        F.when(d % 6 == 0, F.lit('", "feedback": 12}')).otherwise(
            F.lit('", "feedback": "a {brace} inside"}')
        ),
    )
    raw = (
        F.when(d % 9 == 0, F.concat(F.lit("<think>first {</think>```json\n"), body, F.lit("\n```")))
        .when(d % 9 == 1, F.concat(F.lit("My review: "), body, F.lit(" Thanks.")))
        .when(d % 9 == 2, F.lit("no review, sorry"))
        .otherwise(body)
    )
    return table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", raw.alias("raw"))


def progress_events(events: DataFrame) -> DataFrame:
    """Events in the part of progress updates, one run per user."""
    status = (
        F.when(F.col("event_type") == "purchase", "completed")
        .when(F.col("event_type") == "error", "failed")
        .otherwise("in_progress")
    )
    return events.select(
        F.col("user_id").alias("job_id"),
        "ts",
        F.col("value").alias("percentage"),
        F.get_json_object("props", "$.k").alias("message"),
        status.alias("status"),
    )
