"""First-wins removal of exact, fuzzy and semantic near-duplicates."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import normalise_question
from gleaner.operators.similar_text import (
    DEFAULT_THRESHOLD,
    candidate_pairs,
    leading_texts,
    measured_pairs,
    similar_pairs,
)
from gleaner.operators.similar_vectors import (
    cosine_pairs,
    cosine_self_pairs,
    leading_vectors,
)
from gleaner.session import checkpointed


def exact_groups(df: DataFrame, text: Column, position: str) -> DataFrame:
    """One row per distinct text: size, first and last position.

    A plain hash aggregation, so a text held by a third of all rows is reduced
    before the shuffle.
    """
    return df.groupBy(text.alias("text")).agg(
        F.count("*").alias("copies"),
        F.min(position).alias("first"),
        F.max(position).alias("last"),
    )


def first_wins_rejected(edges: DataFrame) -> DataFrame:
    """Ids rejected when rows are taken in order and the first one wins.

    ``edges(earlier, later)`` links similar rows; a row is rejected when some
    accepted earlier row is similar. Each round accepts the rows no undecided
    row precedes, rejects their neighbours and drops the settled edges, until
    no edge is left: as many rounds as the longest chain of undecided rows.
    """
    left = checkpointed(edges.select("earlier", "later").distinct())
    done = left.select(F.col("later").alias("id")).limit(0)
    while not left.isEmpty():
        heads = left.select(F.col("earlier").alias("id")).distinct().join(
            left.select(F.col("later").alias("id")).distinct(), "id", "left_anti"
        )
        beaten = checkpointed(
            left.join(heads, left["earlier"] == heads["id"], "left_semi")
            .select(F.col("later").alias("id"))
            .distinct()
        )
        heads_or_beaten = heads.unionByName(beaten)
        left = checkpointed(
            left.join(heads_or_beaten, left["earlier"] == heads_or_beaten["id"], "left_anti").join(
                beaten, F.col("later") == beaten["id"], "left_anti"
            )
        )
        done = done.unionByName(beaten)
    return done


def fuzzy_edges(
    df: DataFrame, position: str, question: str, threshold: float = DEFAULT_THRESHOLD
) -> DataFrame:
    """Edges ``(earlier, later, similarity)`` between rows with similar questions.

    Copies of a text share one node: edges leave the first row holding a text
    and reach every later row holding an equal (1.0) or similar one.
    """
    rows = df.select(F.col(position).alias("at"), normalise_question(F.col(question)).alias("text"))
    groups = checkpointed(exact_groups(rows, F.col("text"), "at"))
    nodes = groups.select(F.col("first").alias("gid"), "text")
    found = checkpointed(candidate_pairs(nodes, threshold))
    nodes = nodes.withColumn("order", F.col("gid"))
    pairs = measured_pairs(found, nodes, threshold).unionByName(
        # a later copy of the first text comes after the other one: the ratio is not symmetric
        measured_pairs(found, nodes.withColumn("order", -F.col("gid")), threshold)
    )
    held = rows.join(groups.select("text", "first"), "text").select("at", "first")
    exact = held.filter("at > first").select(
        F.col("first").alias("earlier"), F.col("at").alias("later"), F.lit(1.0).alias("similarity")
    )
    fuzzy = held.join(pairs, (held["first"] == pairs["later"]) & (held["at"] > pairs["earlier"])).select(
        "earlier", F.col("at").alias("later"), F.col("ratio").alias("similarity")
    )
    return exact.unionByName(fuzzy)


def _text_edges(leaders: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    found = (
        candidate_pairs(leaders, threshold, others=nodes)
        .filter("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    return measured_pairs(found, nodes, threshold).select("earlier", "later")


def _vector_edges(leaders: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    found = cosine_pairs(
        leaders.select(F.col("gid").alias("lid"), "vec"),
        nodes.select(F.col("gid").alias("rid"), "vec"),
        threshold,
    ).filter("lid != rid")
    place = nodes.select("gid", "order")
    both = found.join(
        place.select(F.col("gid").alias("lid"), F.col("order").alias("lo")), "lid"
    ).join(place.select(F.col("gid").alias("rid"), F.col("order").alias("ro")), "rid")
    swap = F.col("lo") > F.col("ro")
    return both.select(
        F.when(swap, F.col("rid")).otherwise(F.col("lid")).alias("earlier"),
        F.when(swap, F.col("lid")).otherwise(F.col("rid")).alias("later"),
    ).distinct()


def thin_crowds(
    nodes: DataFrame,
    string_threshold: float | None = DEFAULT_THRESHOLD,
    vector_threshold: float | None = None,
) -> DataFrame:
    """Nodes left after crowds of near-copies lost all but certain winners.

    A crowd of ``m`` near-copies would make ``m * m`` pairs although its first
    member rejects the rest. So the first members of all pieces (or
    neighbourhoods of vectors) that at least the square root of ``n`` nodes
    share are compared with everything; those with no similar node before them
    are certain to be accepted, and all nodes similar to them leave. Rounds go
    on while one removes a crowd: fewer nodes mean that common phrases are
    shared, not copies. Smaller crowds make ``n`` pairs each at most; what stays
    is resolved pair by pair.

    ``nodes(gid, order, text[, vec])`` must be checkpointed.
    """
    size = nodes.count()
    while size:
        crowd = max(2, math.isqrt(size))
        leaders = None
        if string_threshold is not None:
            leaders = leading_texts(nodes, string_threshold, crowd)
        if vector_threshold is not None:
            near = leading_vectors(nodes, vector_threshold, crowd)
            leaders = near if leaders is None else leaders.unionByName(near).distinct()
        chosen = checkpointed(nodes.join(leaders, "gid", "left_semi"))
        if chosen.isEmpty():
            return nodes
        edges = None
        if string_threshold is not None:
            edges = _text_edges(chosen, nodes, string_threshold)
        if vector_threshold is not None:
            close = _vector_edges(chosen, nodes, vector_threshold)
            edges = close if edges is None else edges.unionByName(close)
        edges = checkpointed(edges)
        certain = chosen.select("gid").join(
            edges.select(F.col("later").alias("gid")), "gid", "left_anti"
        )
        beaten = (
            edges.join(certain, edges["earlier"] == certain["gid"], "left_semi")
            .select(F.col("later").alias("gid"))
            .distinct()
        )
        nodes = checkpointed(nodes.join(beaten, "gid", "left_anti"))
        before, size = size, nodes.count()
        if before - size < crowd:
            break
    return nodes


def dedup_questions(
    df: DataFrame,
    position: str,
    question: str,
    threshold: float = DEFAULT_THRESHOLD,
) -> DataFrame:
    """Rows that survive first-wins removal of near-equal questions.

    Only the first row of a set of copies can survive, so the order is
    resolved between distinct texts and copies never become edges.
    """
    rows = df.select(F.col(position).alias("at"), normalise_question(F.col(question)).alias("text"))
    nodes = checkpointed(
        exact_groups(rows, F.col("text"), "at").select(
            F.col("first").alias("gid"), F.col("first").alias("order"), "text"
        )
    )
    nodes = thin_crowds(nodes, threshold)
    lost = first_wins_rejected(similar_pairs(nodes.select("gid", "text"), threshold))
    kept = nodes.select("gid").join(lost.withColumnRenamed("id", "gid"), "gid", "left_anti")
    return df.join(kept, df[position] == kept["gid"], "left_semi")


def semantic_edges(
    df: DataFrame, position: str, vector: str, threshold: float = DEFAULT_THRESHOLD
) -> DataFrame:
    """Edges ``(earlier, later, similarity)`` between rows with close vectors."""
    return cosine_self_pairs(
        df.select(F.col(position).alias("gid"), F.col(vector).alias("vec")), threshold
    ).withColumnRenamed("score", "similarity")


def dedup_vectors(
    df: DataFrame,
    position: str,
    vector: str,
    threshold: float = DEFAULT_THRESHOLD,
) -> DataFrame:
    """Rows that survive first-wins removal of close vectors.

    Equal vectors are reduced to their first row before any comparison.
    """
    nodes = checkpointed(
        df.groupBy(F.col(vector).alias("vec"))
        .agg(F.min(position).alias("gid"))
        .select("gid", F.col("gid").alias("order"), "vec")
    )
    nodes = thin_crowds(nodes, None, threshold)
    lost = first_wins_rejected(cosine_self_pairs(nodes.select("gid", "vec"), threshold))
    kept = nodes.select("gid").join(lost.withColumnRenamed("id", "gid"), "gid", "left_anti")
    return df.join(kept, df[position] == kept["gid"], "left_semi")
