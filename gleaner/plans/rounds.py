"""Rounds of generation until a target is met, restartable after each."""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.vectors import Encoder, hashing_encoder
from gleaner.operators.generation import Generate, adapted_multiplier, generate_pairs, target_prompts
from gleaner.operators.validation import cut_at_target, validate_pairs

STATE = "round int, last long, prompts long, parsed long, accepted long, multiplier double"


@dataclass
class Rounds:
    generated: DataFrame  # every prompt of the rounds
    outcomes: DataFrame  # every pair judged, with its round
    states: DataFrame  # one row a round


def run_rounds(
    prompts: DataFrame,
    target_pairs: int,
    generate: Generate,
    model: str,
    folder: str,
    temperature: float = 0.7,
    multiplier: float = 2.0,
    min_quality_score: float = 0.4,
    seeds: DataFrame | None = None,
    encoder: Encoder = hashing_encoder,
) -> Rounds:
    """Generate and validate slices of ``prompts(prompt_index, prompt)`` until enough pairs pass.

    A round takes the next prompts in the order of ``prompt_index``: the pairs
    still wanted, times a factor that follows the rates so far. Its pairs are
    judged behind the seeds and the winners of all rounds before it. It ends
    when the target is met or no prompt is left.

    ``folder`` is in the shared store. It keeps each round's tables, the calls,
    and a row of state per finished round, so that a run started again with the
    same folder goes on behind the last one and repeats no answered call.
    """
    spark = prompts.sparkSession
    folder = folder.rstrip("/")
    spark.createDataFrame([], STATE).write.mode("append").parquet(f"{folder}/states")  # it may be new
    states = spark.read.schema(STATE).parquet(f"{folder}/states")
    known = sorted(states.distinct().collect(), key=lambda s: s["round"])  # a row a round
    outcomes = [spark.read.parquet(f"{folder}/outcomes-{s['round']}") for s in known]
    generated = [spark.read.parquet(f"{folder}/generated-{s['round']}") for s in known]
    sent, parsed, accepted = (sum(s[k] for s in known) for k in ("prompts", "parsed", "accepted"))
    after = known[-1]["last"] if known else None
    for state in known:  # the factor follows from the rounds alone
        multiplier = state["multiplier"]
    if known:
        multiplier = adapted_multiplier(multiplier, sent, parsed, accepted)
    number = len(known)
    while accepted < target_pairs:
        rest = prompts if after is None else prompts.filter(F.col("prompt_index") > after)
        size = max(1, target_prompts(target_pairs - accepted, multiplier))
        cut = rest.select("prompt_index").orderBy("prompt_index").limit(size)
        bounds = cut.agg(F.max("prompt_index").alias("last"), F.count("*").alias("n")).first()
        if not bounds["n"]:
            break
        batch = rest.filter(F.col("prompt_index") <= bounds["last"])
        generate_pairs(batch, generate, model, temperature, ledger=f"{folder}/calls").write.mode("overwrite").parquet(
            f"{folder}/generated-{number}"
        )
        made = spark.read.parquet(f"{folder}/generated-{number}")
        pairs = made.filter("question IS NOT NULL").withColumn("round", F.lit(number))
        won = [o.filter("accepted").select(pairs.columns) for o in outcomes]
        judged = validate_pairs(
            reduce(DataFrame.unionByName, [*won, pairs]), "prompt_index", min_quality_score, seeds, encoder
        ).filter(F.col("round") == number)
        cut_at_target(judged, "prompt_index", target_pairs - accepted).write.mode("overwrite").parquet(
            f"{folder}/outcomes-{number}"
        )
        outcomes.append(spark.read.parquet(f"{folder}/outcomes-{number}"))
        generated.append(made)
        counts = made.agg(F.count("question").alias("parsed")).first()
        gain = outcomes[-1].filter("accepted").count()
        state = [(number, bounds["last"], bounds["n"], counts["parsed"], gain, multiplier)]
        spark.createDataFrame(state, STATE).write.mode("append").parquet(f"{folder}/states")
        sent, parsed, accepted = sent + bounds["n"], parsed + counts["parsed"], accepted + gain
        multiplier = adapted_multiplier(multiplier, sent, parsed, accepted)
        after, number = bounds["last"], number + 1
    if not outcomes:
        none = generate_pairs(prompts.limit(0), generate, model, temperature)
        generated = [none]
        outcomes = [validate_pairs(none.withColumn("round", F.lit(0)), "prompt_index", min_quality_score, seeds, encoder)]
    return Rounds(
        reduce(DataFrame.unionByName, generated),
        reduce(DataFrame.unionByName, outcomes),
        spark.read.schema(STATE).parquet(f"{folder}/states").distinct(),
    )
