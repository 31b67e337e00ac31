"""Named queries and the SQL they are checked against."""
from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from gleaner.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL where one exists."""

    def add(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# Whitespace class for the SQL side, spelled out for its regular expressions.
SPACE = (
    r"[\t\n\x{0b}\f\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def sql_strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def sql_collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SPACE}+', ' ', 'g'))"


def sql_words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '{SPACE}+'), lambda w: w <> '')"


def sql_clean(c: str) -> str:
    flat = sql_collapse(f"coalesce({c}, '')")
    for pattern in (r"Page \p{Nd}+ of \p{Nd}+", r"\[\p{Nd}+(?:, *\p{Nd}+)*\]", r"\(cid:\p{Nd}+\)"):
        flat = f"regexp_replace({flat}, '{pattern}', '', 'g')"
    return f"(CASE WHEN length(trim({flat})) > 10 THEN trim({flat}) ELSE '' END)"


PAIRS = """
turns AS (
  SELECT u.conv_id, u.turn, u.text AS asked, a.text AS replied
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
pairs AS (
  SELECT conv_id * 100 + turn AS id, conv_id,
    'p' || (conv_id % 5) AS project_id, 'job' || (conv_id % 4) AS generation_job_id,
    CASE WHEN conv_id % 7 = 0 THEN asked ELSE 'What is ' || asked || '?' END AS question,
    CASE WHEN conv_id % 11 = 0 THEN 'NOT FOUND' WHEN conv_id % 13 = 0 THEN replied || '...'
         WHEN conv_id % 17 = 0 THEN 'As an AI ' || replied || '.' ELSE replied || '.' END AS answer,
    ['medquad','rag_ollama','pdf_ollama','pubmed_ollama'][conv_id % 4 + 1] AS source_type,
    CASE WHEN conv_id % 6 <> 0 THEN 'doc' || (conv_id % 9) END AS source_document,
    CASE WHEN conv_id % 5 <> 0 THEN ['gpt-4o','gpt-4o-mini','llama3'][conv_id % 3 + 1] END AS model_used,
    CASE WHEN conv_id % 8 <> 0 THEN ((conv_id * 37 + turn * 11) % 101) / 101.0::DOUBLE END AS quality_score,
    ['approved','pending','rejected'][conv_id % 3 + 1] AS validation_status,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id * 7) AS created_at
  FROM turns)
"""
