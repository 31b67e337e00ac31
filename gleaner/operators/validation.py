"""Ordered validation of generated pairs with one reason per rejection."""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import quality
from gleaner.functions.text import normalise_question
from gleaner.functions.vectors import Encoder, embed, hashing_encoder
from gleaner.operators.dedup import exact_groups, first_wins_rejected, thin_crowds
from gleaner.operators.similar_text import (
    DEFAULT_THRESHOLD,
    candidate_pairs,
    measured_pairs,
    similarity,
)
from gleaner.operators.similar_vectors import cosine_self_pairs
from gleaner.session import checkpointed

REASONS = ["not_found", "completeness", "quality", "duplicate", "semantic_dup"]

def with_pair_checks(pairs: DataFrame) -> DataFrame:
    """Add ``checks`` (length, format, relevance) and their ``quality_score``."""
    return pairs.withColumn("checks", quality.pair_checks(F.col("question"), F.col("answer"))).withColumn(
        "quality_score", quality.composite_score(F.col("checks"))
    )


def evaluate_pairs(pairs: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Add ``checks``, ``quality_score`` and ``passed``; no duplicate check."""
    return with_pair_checks(pairs).withColumn(
        "passed", quality.verdict(F.col("checks"), F.col("quality_score"), min_score)
    )


def _with_duplicate(pairs: DataFrame, min_score: float) -> DataFrame:
    """Append the duplicate check from ``similarity`` / ``duplicate_of``."""
    dup = quality.duplicate_check(F.col("similarity"), F.col("duplicate_of"))
    return (
        pairs.withColumn("checks", F.concat("checks", F.array(dup)))
        .withColumn("quality_score", quality.composite_score(F.col("checks")))
        .withColumn("passed", quality.verdict(F.col("checks"), F.col("quality_score"), min_score))
    )


def _first_match(rows: DataFrame, leaders: DataFrame, pairs: DataFrame) -> DataFrame:
    """First similar leader, in list order, of each row: ``(at, gid, ...)``.

    ``rows(at, gid)`` names the text each row holds, ``leaders(gid, order)``
    the texts that count and their list position; a leader counts for rows
    behind it. Returns ``(at, similarity, duplicate_gid)``.
    """
    own = leaders.select("gid", F.col("gid").alias("leader"), "order", F.lit(1.0).alias("ratio"))
    other = leaders.join(pairs, leaders["gid"] == pairs["leader"]).select(
        pairs["gid"].alias("gid"), pairs["leader"].alias("leader"), "order", "ratio"
    )
    # best leader per text and row: the texts are distinct, so this join grows
    # with the number of similar texts, not with copies squared
    matches = rows.join(own.unionByName(other), "gid").filter(F.col("order") < F.col("at"))
    return matches.groupBy("at").agg(
        F.min_by("ratio", "order").alias("similarity"),
        F.min_by("leader", "order").alias("duplicate_gid"),
    )


def validate_pairs(
    pairs: DataFrame,
    position: str,
    min_score: float = 0.4,
    seeds: DataFrame | None = None,
    encoder: Encoder = hashing_encoder,
    string_threshold: float = DEFAULT_THRESHOLD,
    semantic_threshold: float = DEFAULT_THRESHOLD,
) -> DataFrame:
    """Validate pairs in the order of ``position`` (unique, not negative).

    Adds ``accepted``, ``reason`` (null when accepted), ``quality_score`` and
    ``checks``. Order of tests: not found, completeness, quality with string
    duplicates, semantic duplicates. Only accepted questions, and the seed
    questions (``seeds(position, question)``), reject later ones; seeds count
    for the string test only. Vectors are those of the normalised question, so
    equal questions share one comparison.
    """
    judged = pairs.select(
        F.col(position).alias("at"),
        normalise_question(F.col("question")).alias("text"),
        quality.is_not_found(F.col("answer")).alias("not_found"),
        quality.check_completeness(F.col("question"), F.col("answer")).alias("completeness"),
        quality.pair_checks(F.col("question"), F.col("answer")).alias("checks"),
    )
    clean_dup = quality.duplicate_check(F.lit(None).cast("double"), F.lit(None).cast("string"))
    best = F.concat("checks", F.array(clean_dup))
    judged = checkpointed(
        judged.withColumn("stage", F.when(F.col("not_found"), 0).when(
            ~F.col("completeness.passed"), 1).otherwise(2))
        .withColumn(
            "eligible",
            (F.col("stage") == 2)
            & quality.verdict(best, quality.composite_score(best), min_score),
        )
    )
    tested = judged.filter("stage = 2")
    seeded = (
        judged.sparkSession.createDataFrame([], "seed_at long, text string")
        if seeds is None
        else seeds.select(
            F.col("position").cast("long").alias("seed_at"),
            normalise_question(F.col("question")).alias("text"),
        )
    )
    # One node per distinct text, with the first row that could be accepted.
    nodes = checkpointed(
        tested.select("text", "at", F.when(F.col("eligible"), F.col("at")).alias("lead"),
                      F.lit(None).cast("long").alias("seed_at"))
        .unionByName(
            seeded.select("text", F.lit(None).cast("long").alias("at"),
                          F.lit(None).cast("long").alias("lead"), "seed_at")
        )
        .groupBy("text")
        .agg(
            F.min("lead").alias("lead"),
            F.max("at").alias("last"),
            F.min("seed_at").alias("seed_at"),
        )
        .withColumn("gid", F.xxhash64("text"))
    )
    seed_nodes = nodes.filter("seed_at is not null")
    plain = nodes.filter("seed_at is null")
    if seeds is None:
        from_seeds = judged.sparkSession.createDataFrame([], "gid long, leader long, ratio double")
    else:
        from_seeds = checkpointed(
            _led(
                candidate_pairs(seed_nodes, string_threshold, others=plain),
                seed_nodes.withColumn("order", F.lit(-1).cast("long")),
                plain,
                string_threshold,
            )
        )
    # Texts equal or similar to a seed can never be accepted.
    open_leads = checkpointed(
        plain.filter("lead is not null")
        .join(from_seeds.select("gid"), "gid", "left_anti")
        .select("gid", F.col("lead").alias("order"), "text")
        .withColumn("vec", embed(F.col("text"), encoder))
    )
    rivals = thin_crowds(open_leads, string_threshold, semantic_threshold)
    string_edges = measured_pairs(
        candidate_pairs(rivals, string_threshold), rivals, string_threshold
    ).select("earlier", "later")
    order_of = rivals.select("gid", "order")
    close = cosine_self_pairs(
        rivals.select(F.col("order").alias("gid"), "vec"), semantic_threshold
    ).select("earlier", "later")
    by_order = (
        string_edges.join(order_of.select(F.col("gid").alias("earlier"), F.col("order").alias("e")),
                          "earlier")
        .join(order_of.select(F.col("gid").alias("later"), F.col("order").alias("l")), "later")
        .select(F.col("e").alias("earlier"), F.col("l").alias("later"))
    )
    lost = first_wins_rejected(by_order.unionByName(close))
    winners = checkpointed(
        rivals.select("gid", "order", "text").join(
            lost, rivals["order"] == lost["id"], "left_anti"
        )
    )
    # Every tested text against the winners, which are few in a crowd of copies.
    losers = plain.join(winners.select("gid"), "gid", "left_anti")
    from_winners = _led(
        candidate_pairs(winners, string_threshold, others=losers), winners, losers, string_threshold
    )
    leaders = winners.select("gid", "order").unionByName(
        # seeds precede every row; their own order decides between them
        seed_nodes.select("gid", (F.col("seed_at") - F.lit(1 << 62)).alias("order"))
    )
    first = _first_match(
        tested.select("at", F.xxhash64("text").alias("gid")),
        leaders,
        from_seeds.unionByName(from_winners),
    ).join(nodes.select(F.col("gid").alias("duplicate_gid"), F.col("text").alias("duplicate_of")),
           "duplicate_gid")
    accepted = winners.select(F.col("order").alias("at"), F.lit(True).alias("won"))
    checked = judged.join(first.select("at", "similarity", "duplicate_of"), "at", "left").join(
        accepted, "at", "left"
    )
    scored = _with_duplicate(checked, min_score)
    reason = (
        F.when(F.col("stage") == 0, "not_found")
        .when(F.col("stage") == 1, "completeness")
        .when(F.col("won"), F.lit(None))
        .when(F.col("similarity").isNotNull(), "duplicate")
        .when(~F.col("passed"), "quality")
        .otherwise("semantic_dup")
    )
    outcome = scored.select(
        F.col("at").alias(position),
        F.coalesce("won", F.lit(False)).alias("accepted"),
        reason.alias("reason"),
        F.when(F.col("stage") == 2, F.col("quality_score")).otherwise(0.0).alias("quality_score"),
        F.when(F.col("stage") == 2, F.concat("checks", F.array("completeness")))
        .when(F.col("stage") == 1, F.array("completeness"))
        .otherwise(F.array().cast(f"array<{quality.CHECK_TYPE}>"))
        .alias("checks"),
    )
    return pairs.join(outcome, position)


def _led(pairs: DataFrame, leaders: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs of a leader and a row text as ``(gid, leader, ratio)``.

    ``leaders(gid, order, text)``; ``rows(gid, last, text)``, ``last`` being the
    last position that holds the text: a leader behind it is not measured.
    """
    ends = pairs.select(F.col("a").alias("gid"), F.col("b").alias("leader")).unionByName(
        pairs.select(F.col("b").alias("gid"), F.col("a").alias("leader"))
    )
    listed = leaders.select(
        F.col("gid").alias("leader"), F.col("text").alias("leader_text"), "order"
    )
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        ends.join(listed, "leader")
        .join(rows.select("gid", "text", "last"), "gid")
        .filter(F.col("last") > F.col("order"))
        .repartition(parts, "gid", "leader")
        .select(
            "gid",
            "leader",
            similarity(F.col("text"), F.col("leader_text"), threshold).alias("ratio"),
        )
        .filter(F.col("ratio") >= threshold)
    )


def cut_at_target(validated: DataFrame, position: str, target: int) -> DataFrame:
    """Stop after ``target`` acceptances: later rows were never validated."""
    winners = validated.filter("accepted").select(position).orderBy(position).limit(target)
    stop = winners.agg(F.max(position).alias("stop"), F.count("*").alias("n")).first()
    if target <= 0:
        return validated.filter(F.lit(False))
    if stop["n"] < target:
        return validated
    return validated.filter(F.col(position) <= stop["stop"])


def validate_until(
    pairs: DataFrame,
    position: str,
    target: int,
    min_score: float = 0.4,
    seeds: DataFrame | None = None,
    encoder: Encoder = hashing_encoder,
    string_threshold: float = DEFAULT_THRESHOLD,
    semantic_threshold: float = DEFAULT_THRESHOLD,
    surplus: float = 2.0,
) -> DataFrame:
    """``cut_at_target`` of all pairs, validated range by range until the target is met.

    A range holds the next ``surplus`` rows per pair still wanted, more after a
    range that accepted few. The winners so far go ahead of each range: they
    were accepted before and are again, so they reject later rows under both
    tests as in one run. Rows behind the last range are only read for their
    position.
    """
    columns = pairs.columns
    done, winners, after, accepted = [], None, None, 0
    while accepted < target:
        rest = pairs if after is None else pairs.filter(F.col(position) > after)
        size = math.ceil((target - accepted) * surplus)
        last = rest.select(position).orderBy(position).limit(size).agg(F.max(position)).first()[0]
        if last is None:
            break
        fresh = rest.filter(F.col(position) <= last)
        batch = fresh if winners is None else winners.select(columns).unionByName(fresh)
        out = validate_pairs(batch, position, min_score, seeds, encoder, string_threshold, semantic_threshold)
        out = checkpointed(out if after is None else out.filter(F.col(position) > after))
        won = out.filter("accepted")
        gain = won.count()
        done.append(out)
        winners = won if winners is None else winners.unionByName(won)
        accepted += gain
        surplus = min(8 * surplus, max(surplus, size / max(gain, 1)))
        after = last
    if not done:
        return validate_pairs(pairs.limit(0), position, min_score, seeds, encoder)
    return cut_at_target(reduce(DataFrame.unionByName, done), position, target)


def validation_summary(validated: DataFrame) -> DataFrame:
    """Totals, acceptance rate and a zero-filled count per rejection reason."""
    per_reason = [F.count_if(F.col("reason") == r).alias(r) for r in REASONS]
    return validated.agg(
        F.count("*").alias("total_validated"),
        F.count_if("accepted").alias("total_accepted"),
        F.count_if(~F.col("accepted")).alias("total_rejected"),
        (F.count_if("accepted") / F.greatest(F.count("*"), F.lit(1))).alias("acceptance_rate"),
        *per_reason,
    )


def rejection_counts(validated: DataFrame) -> DataFrame:
    """Long form of the summary: one row per reason, zeros included."""
    one_row = validated.agg(*[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])
    return one_row.unpivot([], REASONS, "reason", "count")


def check_rows(validated: DataFrame, key: str) -> DataFrame:
    """Quality checks as a long table."""
    return validated.select(F.col(key).alias("qa_pair_id"), F.explode("checks").alias("c")).select(
        "qa_pair_id", "c.check_type", "c.passed", "c.score", "c.details"
    )


def store_curated(pairs: DataFrame, position: str) -> DataFrame:
    """Curated pairs are kept whatever their checks say.

    Every earlier question counts as a duplicate source, passed or not, so no
    chain has to be resolved. Passing rows are approved, others pending.
    """
    rows = pairs.select(F.col(position).alias("at"), normalise_question(F.col("question")).alias("text"))
    nodes = checkpointed(exact_groups(rows, F.col("text"), "at").withColumn("gid", F.col("first")))
    # First holder of each text leads; a pair of texts matters from the later
    # text's last row on, in either direction.
    found = _led(
        candidate_pairs(nodes.select("gid", "text")),
        nodes.withColumn("order", F.col("first")),
        nodes,
        DEFAULT_THRESHOLD,
    )
    held = rows.join(nodes.select("text", "gid"), "text").select("at", "gid")
    first = _first_match(held, nodes.select("gid", F.col("first").alias("order")), found).join(
        nodes.select(F.col("gid").alias("duplicate_gid"), F.col("text").alias("duplicate_of")),
        "duplicate_gid",
    )
    scored = _with_duplicate(
        with_pair_checks(pairs).join(
            first.select(F.col("at").alias(position), "similarity", "duplicate_of"),
            position,
            "left",
        ),
        0.0,
    )
    return scored.withColumn(
        "validation_status", F.when(F.col("passed"), "approved").otherwise("pending")
    ).drop("similarity", "duplicate_of")
