"""Question/answer XML dumps filtered by keyword."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import strip

_PAIRS = "array<struct<question:string,answer:string>>"
DOCUMENT = f"full_title string, qa_pairs struct<qa_pair:{_PAIRS}>, qa_pair {_PAIRS}"


def read_qa_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``document`` element; big files are split by Spark."""
    return _unwrapped(
        spark.read.format("xml")
        .option("rowTag", "document")
        .schema(DOCUMENT)
        .load(path)
        .withColumn("source_file", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)\z", 1))
    )


def parse_qa_documents(rows: DataFrame, content: str) -> DataFrame:
    """The same rows from a column holding ``document`` elements as text."""
    return rows.withColumn("_doc", F.from_xml(F.col(content), DOCUMENT)).select(
        *[c for c in rows.columns if c != content], "_doc.*"
    ).transform(_unwrapped)


def _unwrapped(documents: DataFrame) -> DataFrame:
    """Pairs that stand outside ``qa_pairs`` serve where it holds none."""
    loose = F.struct(F.col("qa_pair"))
    return documents.withColumn(
        "qa_pairs", F.when(F.size(F.coalesce("qa_pairs.qa_pair", F.array())) > 0, F.col("qa_pairs")).otherwise(loose)
    ).drop("qa_pair")


def mentions_any(text: Column, keywords: list[str]) -> Column:
    """True when any keyword occurs in the text, whatever the case."""
    low = [k.lower().strip() for k in keywords if k.strip()]
    if not low:
        return F.lit(False)
    lowered = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(k)) for k in low])


def keyword_pairs(documents: DataFrame, keywords: list[str]) -> DataFrame:
    """Pairs whose title, question or answer mentions a keyword.

    Pairs without question or answer are dropped; no keywords, no pairs.
    """
    pair = documents.withColumn("_pair", F.explode("qa_pairs.qa_pair"))
    question = strip(F.coalesce("_pair.question", F.lit("")))
    answer = strip(F.coalesce("_pair.answer", F.lit("")))
    rows = (
        pair.withColumns({"question": question, "answer": answer})
        .filter((F.col("question") != "") & (F.col("answer") != ""))
        .filter(
            mentions_any(
                F.concat_ws(" ", F.coalesce("full_title", F.lit("")), "question", "answer"), keywords
            )
        )
    )
    return rows.drop("_pair", "qa_pairs", "full_title")
