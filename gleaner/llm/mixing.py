"""Mixing sources to target weights by subset-sum budget fitting.

Targets: sources share ``share`` of all words by weight; a target stops at
``most`` times its source's words and what is over is shared again by weight.
A target is met by whole documents: as many full passes over the source as fit,
then a subset of it for the rest. The subset is chosen by length only:

1. documents are counted by exact length, per source;
2. an even share of every length is taken, longest first, each length making up
   for what rounding left over, but for a reserve of ``reserve`` words;
3. the reserve is fitted by bounded-knapsack dynamic programming over the
   lengths still free (bit sets of reachable sums), as close to the target
   from below as can be;
4. of each length, the documents with the smallest seeded hashes are taken.

A source's counts are one row per distinct length, of which there are at most
sqrt(2 x words): they meet in one task. Documents never do: a length that many
documents share is cut into buckets by hash, and only the bucket on the border
is ranked.

Defined results: null or empty text has size 0 and takes 0 words; the null
source is a source, last in order; rows that repeat an id count each; a source
without words has target 0; an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.names import unused
from gleaner.llm.store import stored
from gleaner.session import ship_package

WORD = r"[^\x20\x09-\x0D]+"
RESERVE = 20_000
HASH_BUCKETS = 1024


def fit_targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words each source should give: by weight, but ``most`` times its size at most."""
    total = share * sum(sizes)
    order = sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i])
    target, left, weight = [0.0] * len(sizes), total, float(sum(weights))
    for place, i in enumerate(order):
        if left * weights[i] / weight >= most * sizes[i]:
            target[i] = most * sizes[i]
            left -= target[i]
            weight -= weights[i]
        else:
            for j in order[place:]:
                target[j] = left * weights[j] / weight
            break
    return target


def knapsack(lengths: list[int], free: list[int], budget: int) -> list[int]:
    """How many of each length sum to ``budget`` or as little below it as possible."""
    full, reach, items = (1 << (budget + 1)) - 1, 1, []
    for at, (size, n) in enumerate(zip(lengths, free)):
        step = 1
        n = min(n, budget // size) if size else 0
        while n > 0:  # the count in powers of two
            some = min(step, n)
            n, step = n - some, step * 2
            before, reach = reach, (reach | reach << (size * some)) & full
            if reach != before:
                items.append((at, some, before))
        if reach >> budget & 1:
            break
    take, sum_ = [0] * len(lengths), reach.bit_length() - 1
    for at, some, before in reversed(items):
        if not before >> sum_ & 1:
            take[at] += some
            sum_ -= some * lengths[at]
    return take


def choose_counts(lengths: np.ndarray, n: np.ndarray, budget: int, reserve: int = RESERVE) -> np.ndarray:
    """Documents to take of each length so that their words come close to ``budget``.

    ``lengths`` are positive and distinct; never more words than the budget.
    """
    order = np.argsort(-lengths, kind="stable")
    total = int((lengths * n).sum())
    take = np.zeros(len(lengths), np.int64)
    if total <= budget:
        return n.astype(np.int64)
    even = max(0, budget - reserve)
    wanted = taken = seen = 0
    for i in order.tolist():
        seen += int(lengths[i]) * int(n[i])
        wanted = even * seen // total
        k = min(int(n[i]), (wanted - taken) // int(lengths[i]))
        take[i] = max(0, k)
        taken += int(take[i]) * int(lengths[i])
    # rounding can leave more than the reserve: fill from the longest down to it
    for i in order.tolist():
        k = min(int(n[i] - take[i]), max(0, (budget - taken - reserve) // int(lengths[i])))
        take[i] += k
        taken += k * int(lengths[i])
    left = budget - taken
    by = sorted((i for i in order.tolist() if n[i] > take[i] and lengths[i] <= left), key=lambda i: (lengths[i] != left, -lengths[i]))
    extra = knapsack([int(lengths[i]) for i in by], [int(n[i] - take[i]) for i in by], left)
    for i, k in zip(by, extra):
        take[i] += k
    return take


def _fitted(pdf: pd.DataFrame, reserve: int) -> pd.DataFrame:
    size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    passes = int(target // size) if size else 0
    own = pdf[pdf["size"] > 0]
    more = choose_counts(own["size"].to_numpy(), own["n"].to_numpy(), int(target) - passes * size, reserve)
    return pd.DataFrame(
        {"source_key": own["source_key"], "size": own["size"], "passes": passes, "more": more}
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    reserve: int = RESERVE,
) -> DataFrame:
    """Per row ``(doc_id, text_key, source_key, size, source_size, target, copies)``.

    ``weights`` repeat over the sources in code-point order, the null source
    last. ``copies`` is how often the mix holds the document.
    """
    spark = docs.sparkSession
    ship_package(spark)
    own = F.col(source).cast("string")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(F.col(text)).alias("text_key"),
        F.coalesce(F.concat(F.lit("s"), own), F.lit("z")).alias("source_key"),  # the null source sorts last
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_key"))
    rows = stored(rows)
    counts = rows.groupBy("source_key", "size").agg(F.count("*").alias("n"))
    sums = counts.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()
    sums = sorted((r.source_key.encode(), r.source_key, r.words) for r in sums)
    chosen = [weights[i % len(weights)] for i in range(len(sums))]
    targets = fit_targets([w for *_, w in sums], chosen, share, most)
    plan = spark.createDataFrame(
        [(k, int(w), float(t)) for (_, k, w), t in zip(sums, targets)], "source_key string, source_size long, target double"
    )
    # a row a source: as bounded as the list of sources that the weights are given for
    taken = (
        counts.join(plan, "source_key")
        .groupBy("source_key")
        .applyInPandas(lambda pdf: _fitted(pdf, reserve), "source_key string, size long, passes int, more long")
    )
    bucket = F.shiftrightunsigned("h", 54).cast("int")
    keyed = rows.withColumn("bucket", bucket)
    inside = (
        keyed.groupBy("source_key", "size", "bucket")
        .agg(F.count("*").alias("here"))
        .withColumn("before", F.sum("here").over(Window.partitionBy("source_key", "size").orderBy("bucket")) - F.col("here"))
        .join(taken, ["source_key", "size"])
        .select("source_key", "size", "bucket", "passes", F.greatest(F.lit(0), F.least("here", F.col("more") - F.col("before"))).alias("wanted"), "here")
    )
    joined = keyed.join(inside, ["source_key", "size", "bucket"], "left")
    border = (F.col("wanted") > 0) & (F.col("wanted") < F.col("here"))
    whole = joined.filter(~F.coalesce(border, F.lit(False))).withColumn("extra", (F.coalesce("wanted", F.lit(0)) > 0).cast("int"))
    order = Window.partitionBy("source_key", "size", "bucket").orderBy(F.col("h"), F.col("doc_id"), F.col("text_key"))
    ranked = (
        joined.filter(border)
        .withColumn("extra", (F.row_number().over(order) <= F.col("wanted")).cast("int"))
    )
    return (
        whole.unionByName(ranked)
        .join(plan, "source_key")
        .select(
            "doc_id", "text_key", "source_key", "size", "source_size", "target",
            (F.coalesce("passes", F.lit(0)) + F.col("extra")).alias("copies"),
        )
    )


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of the mix, each as often as the mix holds it."""
    names = unused(docs.columns, "mix_id", "mix_text", "mix_source", "mix_copies", "mix_rows", "mix_key", "mix_copy")
    of_id, of_text, of_source, copies, rows, key, copy = names
    count = (
        mix(docs, doc_id, text, source, **options)
        .filter("copies > 0")
        .groupBy(F.col("doc_id").alias(of_id), F.col("text_key").alias(of_text), F.col("source_key").alias(of_source))
        .agg(F.sum("copies").cast("int").alias(copies), F.count("*").cast("int").alias(rows))
    )
    own = docs.withColumn(key, F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("z"))).join(
        count,
        F.col(doc_id).eqNullSafe(F.col(of_id)) & (F.xxhash64(F.col(text)) == F.col(of_text)) & (F.col(key) == F.col(of_source)),
    )
    # rows equal in id, text and source are one row with the copies of all of them
    many = own.filter(F.col(rows) > 1).dropDuplicates([of_id, of_text, of_source])
    return (
        own.filter(F.col(rows) == 1)
        .unionByName(many)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
        .select(*docs.columns)
    )
