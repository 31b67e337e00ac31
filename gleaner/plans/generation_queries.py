"""Queries over generation, parsing and review.

Generation and review call a stand-in that answers from the prompt alone; the
parsing and decision queries read replies derived from the tables.
"""
from __future__ import annotations

import hashlib
import json
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import parsing
from gleaner.operators import generation, review
from gleaner.plans import inputs
from gleaner.plans.curate import RunSettings, generate_dataset
from gleaner.plans.quality_queries import REASONED, reasoned
from gleaner.plans.registry import PAIRS, query, sql_collapse, sql_strip
from gleaner.plans.rounds import run_rounds
from gleaner.session import checkpoint_folder


def stub_generate(prompt: str, temperature: float) -> str | None:
    """A deterministic reply; some prompts need the retry, some give nothing."""
    n = zlib.crc32(prompt.encode("utf-8"))
    if n % 11 == 0:
        return None
    if n % 5 == 0:
        return "I would rather not."
    return (
        f"<think>{n}</think>Question: What follows from observation number {n} in this material?\n"
        f"Answer: Observation {n} means that the finding holds in general and needs no source."
    )


def md5_judge(prompt: str, temperature: float) -> str:
    """Reviews and fact checks that SQL can tell from the MD5 of the prompt."""
    h = hashlib.md5(prompt.encode("utf-8")).hexdigest()
    if h[0] == "f":
        raise ValueError("judge is away")
    if h[0] in "01":
        return "no opinion"
    digit = [int(x, 16) for x in h]
    scores = {k: digit[i] % 11 for i, k in enumerate(parsing.REVIEW_SCORES, 1)}
    facts = {
        "factual_accuracy": digit[6] % 11, "analysis": ["a"], "confidence": 0.5,
        "suggested_answer": f"A better answer {h[:6]}." if digit[7] % 3 else None,
    }
    return "Here: " + json.dumps({**scores, "recommendation": "revise", "feedback": "ok", **facts})


def judged_sql(name: str, rows: str, parts: tuple[str, str, str], answer: str = "answer") -> str:
    """``name(id, h, error)``: the hash whose reply counts for each of ``rows``, null for the fallback."""
    before, middle, behind = parts
    return f"""{name}_asked AS (SELECT id, '{before}' || question || '{middle}' || {answer} || '{behind}' AS prompt FROM {rows}),
{name}_hashed AS (SELECT id, md5(prompt) AS h1, md5(prompt || '{review.RETRY_NOTE}') AS h2 FROM {name}_asked),
{name} AS (SELECT id, CASE WHEN h1 >= 'f' THEN NULL WHEN h1 >= '2' THEN h1 WHEN h2 >= '2' AND h2 < 'f' THEN h2 END AS h,
  CASE WHEN h1 >= 'f' THEN 'judge is away' END AS error FROM {name}_hashed)"""


def digit_sql(place: int) -> str:
    return f"(strpos('0123456789abcdef', substr(h, {place}, 1)) - 1)"


SCORES_SQL = ", ".join(
    f"(CASE WHEN h IS NULL THEN 0 ELSE {digit_sql(i)} % 11 END)::INT AS {k}" for i, k in enumerate(parsing.REVIEW_SCORES, 2)
) + ", 'revise' AS recommendation, CASE WHEN h IS NULL THEN 'No usable review after one retry' ELSE 'ok' END AS feedback"
ACCURACY_SQL = f"(CASE WHEN h IS NULL THEN 0 ELSE {digit_sql(7)} % 11 END)::DOUBLE"
SUGGESTED_SQL = f"CASE WHEN {digit_sql(8)} % 3 <> 0 THEN 'A better answer ' || substr(h, 1, 6) || '.' END"
REVIEWED = f"{PAIRS}, {judged_sql('reviewed', 'pairs', review.REVIEW_PROMPT)}"


@query()
def generated_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run: chunk, embed, retrieve, prompt, generate, validate, store."""
    from gleaner.operators.chunks import chunk_documents

    topics = inputs.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("position"), F.col("text").alias("query")
    )
    settings = RunSettings("p0", "job0", "general", target_pairs=60)
    chunks = chunk_documents(inputs.documents(spark, sf_dir))
    return generate_dataset(chunks, topics, settings, stub_generate).pairs.select(
        "id", "question", "source_type", "source_document", "quality_score", "validation_status"
    )


def md5_generate(prompt: str, temperature: float) -> str | None:
    """A stand-in whose replies SQL can tell from the MD5 of the prompt."""
    h = hashlib.md5(prompt.encode("utf-8")).hexdigest()
    if h[0] in "01":
        return None
    if h[0] in "23456":
        return "I would rather not."
    one, two = (hashlib.md5(f"{h[1:4]}{x}".encode()).hexdigest() for x in "ab")
    answer = "NOT FOUND in the material, which says nothing of it." if h[4] == "0" else (
        f"Record {one} holds that the finding stands as it was first described."
    )
    return f"Question: What does record {one} say about {two}?\nAnswer: {answer}"


# the hash that answers a prompt: its own, or that of the retry
ANSWERED = f"""asked AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS o, 'Ask about: ' || coalesce(text, '') AS prompt FROM documents),
hashed AS (SELECT doc_id, o, md5(prompt) AS h1, md5(prompt || '{generation.REMINDER}') AS h2 FROM asked),
told AS (SELECT doc_id, o, CASE WHEN h1 < '2' THEN NULL WHEN h1 >= '7' THEN h1 WHEN h2 >= '7' THEN h2 END AS h,
  CASE WHEN h1 >= '2' AND h1 < '7' THEN 2 ELSE 1 END AS attempts FROM hashed)"""
QUESTION = "'What does record ' || md5(substr(h, 2, 3) || 'a') || ' say about ' || md5(substr(h, 2, 3) || 'b') || '?'"


def md5_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.documents(spark, sf_dir).select(
        F.col("doc_id").alias("prompt_index"),
        F.concat(F.lit("Ask about: "), F.coalesce("text", F.lit(""))).alias("prompt"),
    )


ANSWER = """CASE WHEN substr(h, 5, 1) = '0' THEN 'NOT FOUND in the material, which says nothing of it.'
  WHEN h IS NOT NULL THEN 'Record ' || md5(substr(h, 2, 3) || 'a') || ' holds that the finding stands as it was first described.' END"""


@query(f"""WITH {ANSWERED} SELECT doc_id AS prompt_index, {QUESTION} AS question, {ANSWER} AS answer, 'stub' AS model, attempts,
  CASE WHEN h IS NULL AND attempts = 1 THEN 'empty response' WHEN h IS NULL THEN 'not parsed' END AS error FROM told""")
def generated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generation.generate_pairs(md5_prompts(spark, sf_dir), md5_generate, "stub")


@query(f"WITH {ANSWERED} SELECT doc_id AS prompt_index, {QUESTION} AS question, attempts FROM told")
def answered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prompt, its retry where the first reply does not parse, through a ledger."""
    folder = f"{checkpoint_folder(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    made = generation.generate_pairs(md5_prompts(spark, sf_dir), md5_generate, "stub", ledger=folder)
    return made.select("prompt_index", "question", "attempts")


TARGET = 150


@query(f"""WITH RECURSIVE {ANSWERED},
judged AS (SELECT doc_id, o, h, h IS NOT NULL AND substr(h, 5, 1) <> '0' AS good FROM told),
firsts AS (SELECT *, good AND o = min(CASE WHEN good THEN o END) OVER (PARTITION BY substr(h, 2, 3)) AS won FROM judged),
sums AS (SELECT doc_id, o, coalesce(won, false) AS won, count(h) OVER (ORDER BY o) AS parsed,
  count(*) FILTER (won) OVER (ORDER BY o) AS accepted, count(*) OVER () AS n FROM firsts),
rounds AS (
  SELECT -1 AS round, 0::BIGINT AS last, 0::BIGINT AS accepted, NULL::DOUBLE AS multiplier, 2.0::DOUBLE AS next
  UNION ALL
  SELECT round + 1, s.o, least(s.accepted, {TARGET}), next,
    CASE WHEN s.o < 10 THEN next WHEN rate < 0.3 THEN least(3.5, next * 1.4) WHEN rate < 0.5 THEN least(3.5, next * 1.2)
      WHEN rate > 0.8 THEN greatest(1.3, next * 0.8) ELSE next END
  FROM (SELECT r.*, s.o, s.accepted AS got, CASE WHEN s.accepted > 0
      THEN least(s.accepted, {TARGET}) / greatest(s.parsed, 1) ELSE s.parsed / s.o END AS rate
    FROM rounds r JOIN sums s ON s.o = least(s.n, r.last + greatest(1, floor(({TARGET} - r.accepted) * r.next)))
    WHERE r.accepted < {TARGET} AND r.last < s.n) r JOIN sums s ON s.o = r.o)
SELECT r.round, s.doc_id AS prompt_index, round(r.multiplier, 9) AS multiplier
FROM sums s JOIN (SELECT *, lag(last) OVER (ORDER BY round) AS before FROM rounds) r ON s.o > r.before AND s.o <= r.last
WHERE s.won AND s.accepted <= {TARGET}""")
def rounds_until_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of all rounds, with the factor their round was planned by."""
    folder = f"{checkpoint_folder(spark).rstrip('/')}/rounds-{uuid.uuid4().hex}"
    done = run_rounds(md5_prompts(spark, sf_dir), TARGET, md5_generate, "stub", folder)
    return (
        done.outcomes.filter("accepted")
        .join(F.broadcast(done.states.select("round", "multiplier")), "round")
        .select("round", "prompt_index", F.round("multiplier", 9).alias("multiplier"))
    )


@query(f"""WITH {PAIRS}, base AS (SELECT id, {REASONED} AS reason, conv_id % 4 <> 0 AS parsed FROM pairs),
c AS (SELECT count(*) AS s, count(*) FILTER (parsed) AS p, count(*) FILTER (reason IS NULL) AS a,
  count(reason) AS rejected, count(*) FILTER (reason = 'duplicate') AS duplicates,
  count(*) FILTER (reason = 'semantic_dup') AS semantic_dups, count(*) FILTER (reason = 'quality') AS quality_failures,
  count(*) FILTER (reason = 'completeness') AS truncated, count(*) FILTER (reason = 'not_found') AS not_found FROM base)
SELECT s AS prompts_sent, p AS parse_successes, s - p AS parse_failures, a AS accepted, rejected, duplicates,
  semantic_dups, quality_failures, truncated, not_found, round(p / greatest(s, 1), 6) AS success_rate,
  round(a / greatest(p, 1), 6) AS acceptance_rate, round(a / greatest(s, 1), 6) AS overall_efficiency FROM c""")
def batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    generated = inputs.pairs(spark, sf_dir).select(
        F.col("id").alias("prompt_index"),
        F.when(F.col("conv_id") % 4 != 0, F.col("question")).alias("question"),
    )
    rates = ("success_rate", "acceptance_rate", "overall_efficiency")
    return generation.batch_stats(generated, reasoned(spark, sf_dir)).withColumns(
        {r: F.round(r, 6) for r in rates}
    )


def _tidy_sql(c: str) -> str:
    return sql_strip(f"regexp_replace({c}, '[ \\t]+', ' ', 'g')")


@query(f"""WITH {PAIRS}, tidied AS (SELECT conv_id * 100 + turn AS id, conv_id % 8 <> 7 AS readable,
  {sql_collapse('asked')} AS q, {_tidy_sql('replied')} AS a FROM turns)
SELECT id, CASE WHEN readable AND length(q) >= 10 AND length(a) >= 20 THEN q END AS question,
  CASE WHEN readable AND length(q) >= 10 AND length(a) >= 20 THEN a END AS answer FROM tidied""")
def parsed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in eight layouts, read back as pairs."""
    layouts = [
        ("Question: ", "\nAnswer: ", ""),
        ("**Question**: ", "\n**Answer**: ", ""),
        ("<think>Question: no\nAnswer: no</think>\nQ: ", "\nA: ", ""),
        ("## Question：", "\n## Answer：", "\n---\nend"),
        ("Sure.\nQuestion: ", "\n\nAnswer: ", "\nNote: generated"),
        ("Question: ", " [Evidence 1, 2]\nAnswer: ", " [Ref 3]"),
        ("question: ", "\nanswer: ", "<reasoning>open"),
        ("Nothing: ", "\nhere ", ""),
    ]
    at = (F.col("conv_id") % 8).cast("int") + 1

    def part(i: int):
        return F.element_at(F.array(*[F.lit(x[i]) for x in layouts]), at)

    raw = F.concat(part(0), "asked", part(1), "replied", part(2))
    rows = inputs.turns(spark, sf_dir).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), parsing.parse_qa(raw).alias("p")
    )
    return rows.select("id", "p.question", "p.answer")


REPLIES = """replies AS (
  SELECT doc_id, doc_id % 9 AS form, doc_id % 11 AS accuracy,
    CASE WHEN doc_id % 7 <> 0 THEN 7 END AS completeness, quality * 9 AS relevance,
    CASE WHEN doc_id % 5 <> 0 THEN doc_id % 13 END AS overall,
    ['approve','revise','reject','maybe'][doc_id % 4 + 1] AS rec, doc_id % 6 = 0 AS bad_feedback FROM labels)"""


@query(f"""WITH {REPLIES}
SELECT doc_id, CASE WHEN form IN (0, 3, 4, 5, 6, 7, 8) THEN 'direct' WHEN form = 1 THEN 'extraction' ELSE 'failed' END AS method,
  CASE WHEN form <> 2 THEN array_to_string(list_filter([
    CASE WHEN completeness IS NULL THEN 'completeness:missing' END,
    CASE WHEN overall IS NULL THEN 'overall:not_numeric' WHEN overall > 10 THEN 'overall:out_of_range' END,
    CASE WHEN rec = 'maybe' THEN 'recommendation:invalid' END,
    CASE WHEN bad_feedback THEN 'feedback:not_text' END], lambda x: x IS NOT NULL), ';') END AS violations
FROM replies""")
def review_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.parse_json_rows(inputs.review_replies(spark, sf_dir), "raw")
    broken = F.array_join(parsing.review_violations(F.col("doc")), ";")
    return rows.select(
        "doc_id", "method", F.when(F.col("doc").isNotNull(), broken).alias("violations")
    )


COERCED = f"""{REPLIES}, coerced AS (SELECT doc_id, accuracy, coalesce(completeness, 5) AS completeness,
  6 AS clarity, relevance, CASE WHEN overall IS NULL THEN 5 WHEN overall > 10 THEN 10 ELSE overall END AS overall, rec, bad_feedback FROM replies WHERE form <> 2)"""


@query(f"""WITH {COERCED} SELECT doc_id, accuracy::INT AS accuracy, completeness::INT AS completeness, clarity,
  relevance::INT AS relevance, overall::INT AS overall,
  CASE WHEN rec <> 'maybe' THEN rec WHEN overall >= 7 THEN 'approve' WHEN overall >= 4 THEN 'revise' ELSE 'reject' END
    AS recommendation, CASE WHEN bad_feedback THEN '' ELSE 'a {{brace}} inside' END AS feedback FROM coerced""")
def coerced_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.parse_json_rows(inputs.review_replies(spark, sf_dir), "raw")
    return rows.filter("doc is not null").select(
        "doc_id", parsing.coerce_review(F.col("doc")).alias("r")
    ).select("doc_id", "r.*")


FACTS = """facts AS (SELECT conv_id, (conv_id % 11)::DOUBLE AS accuracy, conv_id % 4 AS shape FROM
  (SELECT DISTINCT conv_id FROM conversations))"""


@query(f"""WITH {FACTS} SELECT conv_id,
  CASE WHEN shape = 3 THEN 5.0 ELSE accuracy END AS factual_accuracy,
  CASE shape WHEN 0 THEN 'one;2' WHEN 1 THEN 'single' ELSE '' END AS analysis,
  CASE WHEN shape = 2 THEN '7' WHEN shape = 0 THEN 'Better "answer"' END AS suggested_answer,
  CASE shape WHEN 0 THEN 0.25 WHEN 2 THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence,
  CASE shape WHEN 0 THEN '' WHEN 1 THEN 'analysis:not_list'
    WHEN 2 THEN 'confidence:out_of_range;suggested_answer:not_text' ELSE 'factual_accuracy:missing' END AS violations
FROM facts""")
def coerced_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    n = (c % 11).cast("string")
    raw = (
        F.when(c % 4 == 0, F.concat(
            F.lit('{"factual_accuracy": '), n,
            F.lit(', "analysis": ["one", 2], "suggested_answer": "Better \\"answer\\"", "confidence": 0.25}')))
        .when(c % 4 == 1, F.concat(F.lit('{"factual_accuracy": '), n, F.lit(', "analysis": "single"}')))
        .when(c % 4 == 2, F.concat(
            F.lit('{"factual_accuracy": '), n, F.lit(', "suggested_answer": 7, "confidence": 3}')))
        .otherwise(F.lit('{"analysis": null}'))
    )
    rows = inputs.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    parsed = review.parse_json_rows(rows.withColumn("raw", raw), "raw")
    return parsed.select(
        "conv_id",
        parsing.coerce_fact(F.col("doc")).alias("f"),
        F.array_join(parsing.fact_violations(F.col("doc")), ";").alias("violations"),
    ).select("conv_id", "f.*", "violations").withColumn("analysis", F.array_join("analysis", ";"))


@query(f"WITH {REVIEWED} SELECT id, {SCORES_SQL}, error FROM reviewed")
def reviewed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.review_pairs(inputs.pairs(spark, sf_dir), md5_judge)
    return rows.select("id", "review.*", "error")


@query(f"""WITH {PAIRS}, {judged_sql('checked', 'pairs', review.FACT_PROMPT)}
SELECT id, {ACCURACY_SQL} AS factual_accuracy, {SUGGESTED_SQL} AS suggested_answer,
  (CASE WHEN h IS NULL THEN 0 ELSE 0.5 END)::DOUBLE AS confidence, error FROM checked""")
def fact_checked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.fact_check_pairs(inputs.pairs(spark, sf_dir), md5_judge)
    return rows.select(
        "id", "fact_check.factual_accuracy", "fact_check.suggested_answer", "fact_check.confidence", "error"
    )


@query(f"""WITH {REVIEWED} SELECT id, {SCORES_SQL}, error FROM reviewed
WHERE id NOT IN (SELECT id FROM pairs WHERE validation_status = 'approved')
UNION ALL SELECT id, {', '.join('0' for _ in parsing.REVIEW_SCORES)}, 'revise', 'earlier', NULL FROM pairs
WHERE validation_status = 'approved'""")
def resumed_review_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.pairs(spark, sf_dir)
    done = rows.filter("validation_status = 'approved'").select(
        "id", parsing.fallback_review("earlier").alias("review"), F.lit(None).cast("string").alias("error")
    )
    folder = f"{checkpoint_folder(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    return review.run_review_session(rows, done, md5_judge, ledger=folder).select("id", "review.*", "error")


@query(f"""WITH {REVIEWED}, {judged_sql('checked', '(SELECT p.* FROM pairs p JOIN reviewed USING (id) WHERE error IS NULL)', review.FACT_PROMPT)},
marked AS (SELECT p.*, r.error IS NOT NULL OR c.error IS NOT NULL AS failed, c.score, c.suggestion,
    coalesce(r.error IS NULL AND c.error IS NULL AND c.score >= 6.0 AND c.score <= 6.9 AND c.suggestion <> '', false) AS applied
  FROM pairs p JOIN reviewed r USING (id)
  LEFT JOIN (SELECT id, error, {ACCURACY_SQL} AS score, {SUGGESTED_SQL} AS suggestion FROM checked) c USING (id)),
{judged_sql('again', '(SELECT * FROM marked WHERE applied)', review.FACT_PROMPT, 'suggestion')},
decided AS (SELECT m.*, CASE WHEN failed THEN 'error' WHEN score >= 7.0 THEN 'approved'
    WHEN applied AND a.error IS NULL AND a.second >= 7.0 THEN 'approved' ELSE 'pending' END AS decision
  FROM marked m LEFT JOIN (SELECT id, error, {ACCURACY_SQL} AS second FROM again) a USING (id))
SELECT id, CASE WHEN applied THEN suggestion ELSE answer END AS answer,
  CASE WHEN decision = 'approved' THEN 'approved' ELSE validation_status END AS validation_status,
  applied AS human_edited, decision, score AS fact_check_score, applied AS suggestion_applied FROM decided""")
def approval_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.approval_workflow(
        inputs.pairs(spark, sf_dir), md5_judge, threshold=7.0, accept_suggestions=True
    )
    return rows.select(
        "id", "answer", "validation_status", "human_edited", "decision", "audit.fact_check_score",
        "audit.suggestion_applied",
    )


DECIDED = """decided AS (SELECT id, (conv_id % 100) / 10.0::DOUBLE AS score,
  CASE WHEN conv_id % 3 = 0 THEN 'Better' WHEN conv_id % 3 = 1 THEN '' END AS suggestion,
  (conv_id % 9 + 1)::DOUBLE AS second, conv_id % 19 = 0 AS failed FROM pairs),
decisions AS (SELECT *, CASE WHEN failed THEN 'error' WHEN score >= 7.0 THEN 'approved'
  WHEN suggestion <> '' AND score BETWEEN 6.0 AND 6.9 AND second >= 7.0 THEN 'approved' ELSE 'pending' END AS decision,
  CASE WHEN NOT failed AND suggestion <> '' AND score BETWEEN 6.0 AND 6.9 THEN second END AS re_evaluation FROM decided)"""


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    rows = inputs.pairs(spark, sf_dir).select(
        "id",
        ((c % 100) / F.lit(10.0)).alias("score"),
        F.when(c % 3 == 0, "Better").when(c % 3 == 1, "").alias("suggestion"),
        (c % 9 + 1).cast("double").alias("second"),
        (c % 19 == 0).alias("failed"),
    )
    score, suggestion = F.col("score"), F.col("suggestion")
    return rows.select(
        "id",
        review.workflow_decision(
            score, suggestion, F.col("second"), F.col("failed"), accept_suggestions=True
        ).alias("decision"),
        F.when(~F.col("failed") & review.is_borderline(score, suggestion), F.col("second")).alias(
            "re_evaluation"
        ),
    )


@query(f"WITH {PAIRS}, {DECIDED} SELECT id, decision, re_evaluation FROM decisions")
def workflow_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir)


@query(f"""WITH {PAIRS}, {DECIDED} SELECT count(*) FILTER (decision = 'approved') AS approved,
  count(*) FILTER (decision = 'pending') AS pending, count(*) FILTER (decision = 'error') AS errors,
  count(re_evaluation) AS re_evaluated FROM decisions""")
def workflow_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.workflow_rollup(decided(spark, sf_dir))


def label_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per labelled conversation; the score follows from its number."""
    labels = inputs.table(spark, sf_dir, "labels")
    overall = (F.col("doc_id") % 11).cast("int")
    body = F.struct(
        overall.alias("overall"),
        inputs.picked(F.col("doc_id"), "approve", "revise", "reject").alias("recommendation"),
    )
    return labels.select(
        "doc_id", body.alias("review"), F.when(F.col("toxic") == 1, "failed").alias("error")
    )


@query(f"""WITH {PAIRS} SELECT id, CASE WHEN validation_status = 'pending' AND doc_id % 11 >= 7 THEN 'approved'
  WHEN validation_status = 'pending' AND doc_id % 11 < 4 THEN 'rejected' ELSE validation_status END
  AS validation_status FROM pairs LEFT JOIN labels ON doc_id = conv_id""")
def auto_approved_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.pairs(spark, sf_dir)
    reviews = label_reviews(spark, sf_dir)
    by_pair = rows.select("id", "conv_id").join(reviews, F.col("conv_id") == F.col("doc_id"))
    return review.auto_approve(rows, by_pair.select("id", "review")).select("id", "validation_status")


@query("""SELECT doc_id % 10 AS session_id,
  count(*) FILTER (toxic <> 1 AND doc_id % 3 = 0) AS approved_count,
  count(*) FILTER (toxic <> 1 AND doc_id % 3 = 1) AS revise_count,
  count(*) FILTER (toxic <> 1 AND doc_id % 3 = 2) AS rejected_count,
  count(*) FILTER (toxic = 1) AS failed_pairs, count(*) AS completed_pairs,
  round(avg(doc_id % 11) FILTER (toxic <> 1), 2) AS avg_overall_score FROM labels GROUP BY 1""")
def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = label_reviews(spark, sf_dir).withColumn("session_id", F.col("doc_id") % 10)
    return review.session_rollup(results)


@query("""SELECT id, recommendation FROM (SELECT user_id AS id, event_type AS recommendation,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1""")
def newest_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = inputs.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), F.col("ts").alias("reviewed_at"),
        F.col("event_type").alias("recommendation"),
    )
    return review.newest_review(results).select("id", "recommendation")


@query(f"""WITH {PAIRS}, n AS (SELECT coalesce(model_used, 'none') AS model, count(*) AS pair_count FROM pairs GROUP BY 1)
SELECT model, pair_count, round(coalesce(pair_count * 2 * 500 / 1000 * i + pair_count * 2 * 150 / 1000 * o, 0), 4) AS cost_usd
FROM n LEFT JOIN (VALUES ('gpt-4o', 0.005::DOUBLE, 0.015::DOUBLE), ('gpt-4o-mini', 0.00015::DOUBLE, 0.0006::DOUBLE))
  AS price(m, i, o) ON m = model""")
def cost_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of a workflow (two calls per pair) by model."""
    sessions = (
        inputs.pairs(spark, sf_dir)
        .groupBy(F.coalesce("model_used", F.lit("none")).alias("model"))
        .agg(F.count("*").alias("pair_count"))
    )
    return review.estimate_costs(sessions, calls_per_pair=2)
