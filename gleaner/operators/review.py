"""Batch review, fact-checking and approval decisions."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import parsing
from gleaner.functions.text import let
from gleaner.operators.generation import CONCURRENCY, Generate, infer

REVIEW_TEMPERATURE = 0.3

# Price per 1,000 tokens (input, output) by model.
MODEL_PRICES = {
    "gpt-4o-mini": (0.00015, 0.0006),
    "gpt-4o": (0.005, 0.015),
    "gpt-4-turbo": (0.01, 0.03),
    "gpt-3.5-turbo": (0.0005, 0.0015),
    "claude-3-5-haiku-20241022": (0.001, 0.005),
    "claude-3-5-sonnet-20241022": (0.003, 0.015),
    "claude-3-opus-20240229": (0.015, 0.075),
    "gemini-2.0-flash": (0.0001, 0.0004),
    "gemini-1.5-pro": (0.00125, 0.005),
    "gemini-1.5-flash": (0.000075, 0.0003),
    "anthropic/claude-3.5-sonnet": (0.003, 0.015),
    "anthropic/claude-3.5-haiku": (0.001, 0.005),
    "anthropic/claude-3-opus": (0.015, 0.075),
    "openai/gpt-4o": (0.005, 0.015),
    "openai/gpt-4o-mini": (0.00015, 0.0006),
    "openai/gpt-3.5-turbo": (0.0005, 0.0015),
    "google/gemini-pro-1.5": (0.00125, 0.005),
    "google/gemini-flash-1.5": (0.000075, 0.0003),
    "meta-llama/llama-3.1-405b-instruct": (0.003, 0.003),
    "meta-llama/llama-3.1-70b-instruct": (0.00035, 0.0004),
    "mistralai/mistral-large": (0.003, 0.009),
    "mistralai/mixtral-8x22b-instruct": (0.00065, 0.00065),
    "qwen/qwen-2.5-72b-instruct": (0.0004, 0.0004),
}
INPUT_TOKENS, OUTPUT_TOKENS = 500, 150  # assumed per pair

JSON_ONLY = "Reply with one valid JSON object and no other text.\n"
RETRY_NOTE = "\n\nThe previous reply was not valid. Reply with the JSON object only."

# what stands before the question, before the answer, and behind it
REVIEW_PROMPT = (
    JSON_ONLY + "Rate this question and answer.\n\nQuestion: ",
    "\nAnswer: ",
    "\n\nFields: accuracy, completeness, clarity, relevance, overall (integers 0-10), "
    "recommendation (approve, revise or reject), feedback (one or two sentences).",
)
FACT_PROMPT = (
    JSON_ONLY + "Check the facts of this answer.\n\nQuestion: ",
    "\nAnswer: ",
    "\n\nFields: factual_accuracy (integer 0-10), analysis (list of short findings), "
    "suggested_answer (better answer if factual_accuracy is below 8, else null), "
    "confidence (0.0-1.0).",
)


def _filled(parts: tuple[str, str, str], question: Column, answer: Column) -> Column:
    return F.concat(F.lit(parts[0]), question, F.lit(parts[1]), answer, F.lit(parts[2]))


def review_prompt(question: Column, answer: Column) -> Column:
    return _filled(REVIEW_PROMPT, question, answer)


def fact_prompt(question: Column, answer: Column) -> Column:
    return _filled(FACT_PROMPT, question, answer)


def parse_json_rows(df: DataFrame, raw: str) -> DataFrame:
    """Add ``doc`` (variant object or null) and ``method`` of parsing.

    Only rows whose whole text is not a JSON object are sent to the Python
    scan for the first balanced object.
    """
    clean = df.withColumn("_text", parsing.sanitise_json_text(F.col(raw))).withColumn(
        "_direct", parsing.json_object(F.col("_text"))
    )
    scanned = clean.withColumn(
        "_found", parsing.balanced_object(F.when(F.col("_direct").isNull(), F.col("_text")))
    ).withColumn("_inner", parsing.json_object(F.col("_found")))
    method = (
        F.when(F.col("_direct").isNotNull(), "direct")
        .when(F.col("_inner").isNotNull(), "extraction")
        .otherwise("failed")
    )
    return (
        scanned.withColumn("doc", F.coalesce("_direct", "_inner"))
        .withColumn("method", method)
        .drop("_text", "_direct", "_found", "_inner")
    )


def _judged(
    pairs: DataFrame,
    prompt: Callable[[Column, Column], Column],
    violations: Callable[[Column], Column],
    coerce: Callable[[Column], Column],
    fallback: Column,
    generate: Generate,
    concurrency: int,
    ledger: str | None = None,
) -> DataFrame:
    """``(id, result, error)``: ask, parse, check, ask once more, repair.

    A valid first reply wins; else the retry if it holds an object, else the
    first object, else the fallback. A failed first call gives the fallback
    and its error.
    """
    def read(doc: Column) -> Column:
        valid = doc.isNotNull() & (F.size(violations(doc)) == 0)
        return F.struct(valid.alias("valid"), F.when(doc.isNotNull(), coerce(doc)).alias("result"))

    def told(answered: DataFrame) -> DataFrame:
        """Each reply parsed once, before it is written; a prompt that is not asked again is dropped."""
        rows = parse_json_rows(answered, "response").withColumn("read", let(F.col("doc"), read))
        return rows.select(
            "id",
            F.when(~F.col("read.valid") & F.col("response_error").isNull(), F.col("prompt")).alias("again"),
            "read.result",
            F.col("response_error").alias("error"),
        )

    first = infer(
        pairs.select("id", prompt(F.col("question"), F.col("answer")).alias("prompt")),
        "prompt", generate, REVIEW_TEMPERATURE, concurrency, ledger=ledger, after=told,
    )
    second = infer(
        first.filter(F.col("again").isNotNull()).select("id", F.concat("again", F.lit(RETRY_NOTE)).alias("prompt")),
        "prompt", generate, REVIEW_TEMPERATURE, concurrency, ledger=ledger, after=told,
    ).select("id", F.col("result").alias("second"))
    return first.join(second, "id", "left").select(
        "id", F.coalesce("second", "result", fallback).alias("result"), "error"
    )


def review_pairs(
    pairs: DataFrame, generate: Generate, concurrency: int = CONCURRENCY, ledger: str | None = None
) -> DataFrame:
    """Reviews of ``pairs(id, question, answer)`` as ``(id, review, error)``."""
    fallback = parsing.fallback_review("No usable review after one retry")
    judged = _judged(
        pairs, review_prompt, parsing.review_violations, parsing.coerce_review, fallback,
        generate, concurrency, ledger,
    )
    return judged.withColumnRenamed("result", "review")


def fact_check_pairs(
    pairs: DataFrame, generate: Generate, concurrency: int = CONCURRENCY, ledger: str | None = None
) -> DataFrame:
    """Fact checks of ``pairs(id, question, answer)`` as ``(id, fact_check, error)``."""
    judged = _judged(
        pairs, fact_prompt, parsing.fact_violations, parsing.coerce_fact, parsing.fallback_fact(),
        generate, concurrency, ledger,
    )
    return judged.withColumnRenamed("result", "fact_check")


def newest_review(results: DataFrame, at: str = "reviewed_at") -> DataFrame:
    """Latest result per pair, decided before any shuffle of whole rows."""
    return (
        results.groupBy("id")
        .agg(F.max_by(F.struct("*"), F.col(at)).alias("row"))
        .select("row.*")
    )


def attach_reviews(pairs: DataFrame, reviews: DataFrame) -> DataFrame:
    return pairs.join(reviews.select("id", "review"), "id", "left")


def pending_for_review(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs a resumed session still has to review."""
    return pairs.join(done.select("id"), "id", "left_anti")


def run_review_session(
    pairs: DataFrame,
    done: DataFrame,
    generate: Generate,
    concurrency: int = CONCURRENCY,
    ledger: str | None = None,
) -> DataFrame:
    """All results of a session: those at hand plus the missing ones.

    Running it again reviews nothing twice; with a ledger that holds for calls
    of a run that was lost, too.
    """
    fresh = review_pairs(pending_for_review(pairs, done), generate, concurrency, ledger)
    return done.select("id", "review", "error").unionByName(fresh)


def threshold_status(status: Column, overall: Column, min_overall: float = 7.0) -> Column:
    """Pending pairs with a review: approved from the threshold, rejected below 4."""
    open_pair = (status == "pending") & overall.isNotNull()
    return (
        F.when(open_pair & (overall >= min_overall), "approved")
        .when(open_pair & (overall < 4.0), "rejected")
        .otherwise(status)
    )


def auto_approve(pairs: DataFrame, reviews: DataFrame, min_overall: float = 7.0) -> DataFrame:
    """Apply review scores to pending pairs; others keep their status."""
    joined = pairs.join(
        reviews.select("id", F.col("review.overall").cast("double").alias("overall")), "id", "left"
    )
    return joined.withColumn(
        "validation_status",
        threshold_status(F.col("validation_status"), F.col("overall"), min_overall),
    )


def is_borderline(
    score: Column, suggestion: Column, low: float = 6.0, high: float = 6.9
) -> Column:
    """A suggested answer is worth trying: between the bands, not empty."""
    return F.coalesce(score.between(low, high) & (suggestion != ""), F.lit(False))


def workflow_decision(
    score: Column, suggestion: Column, second_score: Column, failed: Column,
    threshold: float = 7.0, accept_suggestions: bool = False, low: float = 6.0, high: float = 6.9,
) -> Column:
    """``approved``, ``pending`` or ``error`` for one pair."""
    retried = is_borderline(score, suggestion, low, high) & F.lit(accept_suggestions)
    return (
        F.when(failed, "error")
        .when(score >= threshold, "approved")
        .when(retried & (second_score >= threshold), "approved")
        .otherwise("pending")
    )


def approval_workflow(
    pairs: DataFrame,
    generate: Generate,
    threshold: float = 7.0,
    accept_suggestions: bool = False,
    low: float = 6.0,
    high: float = 6.9,
    provider: str = "",
    model: str = "",
    concurrency: int = CONCURRENCY,
) -> DataFrame:
    """Review, fact-check, and re-check of borderline pairs with their suggestion.

    Three inference passes over shrinking inputs. Returns the pairs with their
    new answer and status, ``decision``, ``review``, ``fact_check``,
    ``re_evaluation`` and an audit struct; ``suggestion_applied`` tells of the
    row itself.
    """
    reviews = review_pairs(pairs, generate, concurrency).withColumnRenamed("error", "review_error")
    facts = fact_check_pairs(
        pairs.join(reviews.filter("review_error is null").select("id"), "id", "left_semi"),
        generate, concurrency,
    ).withColumnRenamed("error", "fact_error")
    joined = pairs.join(reviews, "id", "left").join(facts, "id", "left")
    score = F.col("fact_check.factual_accuracy")
    suggestion = F.col("fact_check.suggested_answer")
    failed = F.col("review_error").isNotNull() | F.col("fact_error").isNotNull()
    applied = (
        F.lit(accept_suggestions)
        & ~failed
        & F.coalesce(score < threshold, F.lit(False))
        & is_borderline(score, suggestion, low, high)
    )
    marked = joined.withColumn("_applied", applied)
    second = fact_check_pairs(
        marked.filter("_applied").select("id", "question", suggestion.alias("answer")),
        generate, concurrency,
    ).select(
        "id",
        F.when(F.col("error").isNull(), F.col("fact_check")).alias("re_evaluation"),
    )
    decided = marked.join(second, "id", "left").withColumn(
        "decision",
        workflow_decision(
            score, suggestion, F.col("re_evaluation.factual_accuracy"), failed,
            threshold, accept_suggestions, low, high,
        ),
    )
    return decided.select(
        *[c for c in pairs.columns if c not in ("answer", "validation_status", "human_edited")],
        F.when(F.col("_applied"), suggestion).otherwise(F.col("answer")).alias("answer"),
        F.when(F.col("decision") == "approved", F.lit("approved"))
        .otherwise(F.col("validation_status"))
        .alias("validation_status"),
        F.when(F.col("_applied"), F.lit(True)).otherwise(F.col("human_edited")).alias(
            "human_edited"
        ),
        F.when(
            F.col("_applied"),
            F.struct(
                F.col("answer").alias("old_answer"),
                F.lit("auto_approve_workflow").alias("source"),
                score.alias("fact_check_score"),
            ),
        ).alias("suggestion_applied"),
        "decision",
        "review",
        "fact_check",
        "re_evaluation",
        F.coalesce("review_error", "fact_error").alias("error"),
        F.struct(
            F.col("review.overall").alias("review_overall"),
            score.alias("fact_check_score"),
            F.lit(threshold).alias("threshold"),
            F.col("decision"),
            F.col("_applied").alias("suggestion_applied"),
            F.lit(provider).alias("provider"),
            F.lit(model).alias("model"),
        ).alias("audit"),
    )


def price_table(spark) -> DataFrame:
    rows = [(m, *p) for m, p in MODEL_PRICES.items()]
    return spark.createDataFrame(rows, "model string, input double, output double")


def estimate_costs(
    sessions: DataFrame, prices: DataFrame | None = None, calls_per_pair: int = 1
) -> DataFrame:
    """Add ``cost_usd`` to ``sessions(model, pair_count, ...)``; unknown models cost 0.

    The built-in price table is a constant of this module, so it is broadcast;
    a table passed in is joined as its size demands.
    """
    table = F.broadcast(price_table(sessions.sparkSession)) if prices is None else prices
    n = F.col("pair_count") * calls_per_pair
    cost = n * INPUT_TOKENS / 1000 * F.col("input") + n * OUTPUT_TOKENS / 1000 * F.col("output")
    return (
        sessions.join(table, "model", "left")
        .withColumn("cost_usd", F.round(F.coalesce(cost, F.lit(0.0)), 4))
        .drop("input", "output")
    )


def session_rollup(results: DataFrame) -> DataFrame:
    """Counts by recommendation and mean score per session, errors left out of the mean."""
    ok = F.col("error").isNull()
    rec = F.col("review.recommendation")
    return results.groupBy("session_id").agg(
        F.count_if(ok & (rec == "approve")).alias("approved_count"),
        F.count_if(ok & ~rec.isin("approve", "reject")).alias("revise_count"),
        F.count_if(ok & (rec == "reject")).alias("rejected_count"),
        F.count_if(~ok).alias("failed_pairs"),
        F.count("*").alias("completed_pairs"),
        F.round(F.avg(F.when(ok, F.col("review.overall"))), 2).alias("avg_overall_score"),
    )


def workflow_rollup(decided: DataFrame) -> DataFrame:
    """How many pairs were approved, left pending, failed or re-evaluated."""
    return decided.agg(
        F.count_if(F.col("decision") == "approved").alias("approved"),
        F.count_if(F.col("decision") == "pending").alias("pending"),
        F.count_if(F.col("decision") == "error").alias("errors"),
        F.count_if(F.col("re_evaluation").isNotNull()).alias("re_evaluated"),
    )
