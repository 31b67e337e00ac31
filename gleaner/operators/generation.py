"""Batch generation through a caller-supplied function, and its statistics."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.parsing import parse_qa
from gleaner.session import checkpointed

# (prompt, temperature) -> response text, None when the call failed
Generate = Callable[[str, float], str | None]

REMINDER = "\n\nReply with these two fields and nothing else:\nQuestion: ...\nAnswer: ..."
CONCURRENCY = 5
CALLS_A_TASK = 500


LEDGER = "call string, response string, error string"


def call_key(prompt: Column, temperature: float) -> Column:
    """Name of a call: equal prompts at one temperature share an answer."""
    return F.sha2(F.concat_ws("\x1f", F.lit(str(temperature)), prompt), 256)


def ledger_rows(spark: SparkSession, ledger: str) -> DataFrame:
    """``(call, response, error)``: an answer where there is one, else the failure."""
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)  # it may be new
    rows = spark.read.schema(LEDGER).parquet(ledger)
    told = F.struct("response", "error")
    return rows.groupBy("call").agg(F.min_by(told, F.col("error").isNotNull()).alias("told")).select("call", "told.*")


def _asked(df: DataFrame, prompt: str, generate: Generate, temperature: float, concurrency: int, out: str, error: str) -> DataFrame:
    def ask(prompt_text: str) -> tuple[str | None, str | None]:
        try:
            return generate(prompt_text, temperature), None
        except Exception as problem:  # a failed call is a row, not a failed job
            return None, str(problem) or type(problem).__name__

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for pdf in batches:
                answers = list(pool.map(ask, pdf[prompt]))
                yield pdf.assign(
                    **{
                        out: pd.Series([a for a, _ in answers], index=pdf.index, dtype=object),
                        error: pd.Series([e for _, e in answers], index=pdf.index, dtype=object),
                    }
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, {out} string, {error} string")


def infer(
    df: DataFrame,
    prompt: str,
    generate: Generate,
    temperature: float,
    concurrency: int = CONCURRENCY,
    out: str = "response",
    ledger: str | None = None,
    after: Callable[[DataFrame], DataFrame] = lambda answered: answered,
) -> DataFrame:
    """Add the response to each prompt and ``{out}_error`` for failed calls.

    Responses are costly and may differ between calls, so they are written to
    the checkpoint folder before anything reads them; of what ``after`` makes of
    them, its result is written in their place. With ``ledger``, a folder
    of the shared store, they are kept there by prompt: only prompts without an
    answer are asked, about ``CALLS_A_TASK`` to a task, and a task's answers stay
    once it has ended, whatever becomes of the run. Failed calls are asked again
    by the next run.
    """
    if ledger is None:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartition(parts, prompt)  # a call is costly, whatever files the rows came from
        return checkpointed(after(_asked(df, prompt, generate, temperature, concurrency, out, f"{out}_error")))
    keyed = df.withColumn("_call", call_key(F.col(prompt), temperature))
    answered = ledger_rows(df.sparkSession, ledger).filter("error IS NULL").select(F.col("call").alias("_call"))
    missing = checkpointed(
        keyed.select("_call", prompt).dropDuplicates(["_call"]).join(answered, "_call", "left_anti")
    )
    tasks = max(1, -(-missing.count() // CALLS_A_TASK))
    (
        _asked(missing.repartition(tasks, "_call"), prompt, generate, temperature, concurrency, "response", "error")
        .select(F.col("_call").alias("call"), "response", "error")
        .write.mode("append")
        .option("mapreduce.fileoutputcommitter.algorithm.version", "2")  # a task's file is final when it ends
        .parquet(ledger)
    )
    told = ledger_rows(df.sparkSession, ledger).toDF("_call", out, f"{out}_error")
    return checkpointed(after(keyed.join(told, "_call", "left").drop("_call")))


def generate_pairs(
    prompts: DataFrame,
    generate: Generate,
    model: str,
    temperature: float = 0.7,
    concurrency: int = CONCURRENCY,
    ledger: str | None = None,
) -> DataFrame:
    """One attempt per prompt and one retry for responses that do not parse.

    Returns every prompt: ``(prompt_index, question, answer, model, attempts,
    error)``; question and answer are null where both attempts failed.
    """
    first = infer(
        prompts.select("prompt_index", "prompt"), "prompt", generate, temperature, concurrency, ledger=ledger
    ).withColumn("pair", parse_qa(F.col("response")))
    good = first.filter("pair is not null").select(
        "prompt_index", "pair", F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("error")
    )
    empty = F.coalesce(F.col("response"), F.lit("")) == ""
    silent = first.filter(F.col("pair").isNull() & empty).select(
        "prompt_index",
        "pair",
        F.lit(1).alias("attempts"),
        F.coalesce("response_error", F.lit("empty response")).alias("error"),
    )
    again = first.filter(F.col("pair").isNull() & ~empty).select(
        "prompt_index", F.concat("prompt", F.lit(REMINDER)).alias("prompt")
    )
    second = infer(
        again, "prompt", generate, max(0.3, temperature - 0.2), concurrency, ledger=ledger
    ).withColumn("pair", parse_qa(F.col("response")))
    retried = second.select(
        "prompt_index",
        "pair",
        F.lit(2).alias("attempts"),
        F.when(F.col("pair").isNull(), F.coalesce("response_error", F.lit("not parsed"))).alias(
            "error"
        ),
    )
    return (
        good.unionByName(silent)
        .unionByName(retried)
        .select(
            "prompt_index", "pair.question", "pair.answer", F.lit(model).alias("model"),
            "attempts", "error",
        )
    )


def batch_stats(generated: DataFrame, validated: DataFrame) -> DataFrame:
    """Prompt, parse and acceptance counts with their ratios, one row."""
    sent = generated.agg(
        F.count("*").alias("prompts_sent"), F.count("question").alias("parse_successes")
    )
    judged = validated.agg(
        F.count_if("accepted").alias("accepted"),
        F.count_if(~F.col("accepted")).alias("rejected"),
        F.count_if(F.col("reason") == "duplicate").alias("duplicates"),
        F.count_if(F.col("reason") == "semantic_dup").alias("semantic_dups"),
        F.count_if(F.col("reason") == "quality").alias("quality_failures"),
        F.count_if(F.col("reason") == "completeness").alias("truncated"),
        F.count_if(F.col("reason") == "not_found").alias("not_found"),
    )
    one = F.lit(1).alias("one")
    both = sent.select("*", one).join(judged.select("*", one), "one").drop("one")
    return both.select(
        "*",
        (F.col("prompts_sent") - F.col("parse_successes")).alias("parse_failures"),
        (F.col("parse_successes") / F.greatest("prompts_sent", F.lit(1))).alias("success_rate"),
        (F.col("accepted") / F.greatest("parse_successes", F.lit(1))).alias("acceptance_rate"),
        (F.col("accepted") / F.greatest("prompts_sent", F.lit(1))).alias("overall_efficiency"),
    )


def target_prompts(target_pairs: int, multiplier: float = 2.0) -> int:
    return int(target_pairs * multiplier)


def adapted_multiplier(
    multiplier: float,
    prompts_sent: int,
    parse_successes: int,
    accepted: int,
    low: float = 1.3,
    high: float = 3.5,
    interval: int = 10,
) -> float:
    """Over-generation factor for the next round, from the observed rate.

    The acceptance rate counts once something was accepted, else the parse rate.
    """
    if prompts_sent < interval:
        return multiplier
    rate = (
        accepted / max(parse_successes, 1) if accepted > 0 else parse_successes / max(prompts_sent, 1)
    )
    if rate < 0.3:
        return min(high, multiplier * 1.4)
    if rate < 0.5:
        return min(high, multiplier * 1.2)
    if rate > 0.8:
        return max(low, multiplier * 0.8)
    return multiplier
