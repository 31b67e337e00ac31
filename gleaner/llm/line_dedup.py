"""Cross-site line dedup by distinct-site spread.

A line that stands on many sites is boilerplate (menus, licences, notices); one
that a single site repeats is not. Per line hash, a HyperLogLog sketch of the
sites is built on each task and merged by aggregation. Lines whose estimate is
clearly over ``min_sites`` are removed, lines clearly under it stay, and lines
near it, within the sketch's error, get an exact distinct count.

Only hashes and places are shuffled until the end, when each text meets the
places of its own removed lines once. Everything is DataFrame functions.

Defined results: a line is compared without spaces, tabs and carriage returns
at its ends; blank lines are neither counted nor removed; a null site is no
site; null text has no lines and stays null; equal rows get equal results;
other columns are kept as they are.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.names import unused
from gleaner.llm.store import stored

MIN_SITES = 5
LOG_K = 12  # sketch of 4,096 registers: about 1.6 % standard error
MARGIN = 0.1  # six standard errors


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, log_k: int = LOG_K) -> DataFrame:
    """Hashes of the lines on ``min_sites`` sites or more, from ``(line, site)`` rows."""
    sites = (
        lines.groupBy("line")
        .agg(F.hll_sketch_agg("site", F.lit(log_k)).alias("sketch"))
        .select("line", F.hll_sketch_estimate("sketch").alias("about"))
    )
    low, high = min_sites * (1 - MARGIN) - 1, min_sites * (1 + MARGIN) + 1
    likely = stored(sites.filter(F.col("about") >= low))
    sure = likely.filter(F.col("about") > high).select("line")
    near = likely.filter(F.col("about") <= high).select("line")
    exact = (
        lines.join(near, "line", "left_semi")
        .groupBy("line")
        .agg(F.count_distinct("site").alias("sites"))
        .filter(F.col("sites") >= min_sites)
        .select("line")
    )
    return sure.unionByName(exact)


def without_boilerplate(
    docs: DataFrame,
    text: str = "text",
    site: str = "source",
    min_sites: int = MIN_SITES,
    log_k: int = LOG_K,
) -> DataFrame:
    """``docs`` with boilerplate lines out of ``text``, and ``n_lines``, ``n_removed``.

    Columns of those two names in the input are replaced.
    """
    own = docs.drop("n_lines", "n_removed") if {"n_lines", "n_removed"} & set(docs.columns) else docs
    body, place = F.col(text).cast("string"), F.col(site).cast("string")
    row = F.xxhash64(body, F.lit(1))
    gone_at, gone_row = unused(own.columns, "gone_at", "gone_row")
    lines = stored(
        own.filter(body.isNotNull())
        .select(row.alias("row"), place.alias("site"), F.posexplode(_lines(body)).alias("pos", "raw"))
        .filter(_bare(F.col("raw")) != "")
        .select("row", "site", "pos", F.xxhash64(_bare(F.col("raw"))).alias("line"))
    )
    gone = spread_lines(lines.select("line", "site"), min_sites, log_k)
    # rows of equal text lose the same places: distinct before they are gathered
    places = (
        lines.select("row", "pos", "line")
        .join(gone, "line")
        .groupBy("row")
        .agg(F.collect_set("pos").alias(gone_at))
        .withColumnRenamed("row", gone_row)
    )
    joined = own.join(places, row == F.col(gone_row), "left")
    every = _lines(body)
    at = F.coalesce(gone_at, F.array().cast("array<int>"))
    kept = F.array_join(F.filter(every, lambda x, i: ~F.array_contains(at, i)), "\n")
    filled = F.size(F.filter(every, lambda x: _bare(x) != ""))
    return joined.select(
        *[F.when(F.col(gone_at).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text else F.col(c) for c in own.columns],
        F.when(body.isNull(), 0).otherwise(filled).cast("long").alias("n_lines"),
        F.size(at).cast("long").alias("n_removed"),
    )
