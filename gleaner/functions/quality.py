"""Quality checks on question/answer pairs as native check structs.

Every check is ``struct<check_type, passed, score, details>``; ``details`` is
JSON text because its keys differ per check.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import let, strip, words

# Accepted and ideal lengths in characters.
QUESTION_RANGE, QUESTION_IDEAL = (10, 500), (20, 200)
ANSWER_RANGE, ANSWER_IDEAL = (20, 3000), (50, 1000)

# Openings that make a text look like a question.
QUESTION_STARTERS = [
    "what", "how", "why", "when", "where", "which", "who",
    "can", "do", "is", "are", "does", "will", "should",
    "explain", "describe", "define", "compare", "discuss",
]

# Refusal phrases.
REFUSALS = [
    "I cannot generate",
    "I am a language model",
    "I don't have enough information",
    "Based on the text provided",
    "As an AI",
    "I'm sorry",
    "I apologize",
]

# Phrases that point at a source instead of standing alone.
SOURCE_PHRASES = [
    "according to the text",
    "according to the passage",
    "according to the article",
    "according to the study",
    "according to the document",
    "according to the source",
    "the text states",
    "the text mentions",
    "the text describes",
    "the text explains",
    "the text indicates",
    "the text suggests",
    "the text notes",
    "the passage states",
    "the passage mentions",
    "the passage describes",
    "the article states",
    "the article mentions",
    "the study found",
    "the study states",
    "the study shows",
    "the study suggests",
    "the study reports",
    "as mentioned in the text",
    "as stated in the text",
    "as described in the text",
    "as noted in the text",
    "based on the passage",
    "based on the text",
    "based on the article",
    "based on the given text",
    "based on the provided text",
    "in the text",
    "in the passage",
    "in the given text",
    "in the provided text",
    "from the text",
    "from the passage",
    "the given text",
    "the provided text",
    "the above text",
    "this text",
    "this passage",
]

# Bracketed citations that make an answer depend on its source.
CITATION_MARK = (
    r"(?i)\[Evidence\s*\d+\]|\[Ref(?:erence)?\s*\d+\]|\[Source\s*\d+\]|\(\s*Evidence\s*\d+\s*\)"
)

# Weight of each check in the composite score.
WEIGHTS = {"length": 0.25, "format": 0.20, "relevance": 0.30, "duplicate": 0.25}
OTHER_WEIGHT = 0.1

CHECK_TYPE = "struct<check_type:string,passed:boolean,score:double,details:string>"


def _check(kind: str, passed: Column, score: Column, **details: Column) -> Column:
    info = F.to_json(F.struct(*[c.alias(k) for k, c in details.items()]))
    return F.struct(
        F.lit(kind).alias("check_type"),
        passed.alias("passed"),
        score.cast("double").alias("score"),
        info.alias("details"),
    )


def _hits(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(p).cast("int") for p in phrases])


def _graded(n: Column, ideal: tuple, allowed: tuple, fair: float) -> Column:
    return F.when(n.between(*ideal), 1.0).when(n.between(*allowed), fair).otherwise(0.0)


def check_length(question: Column, answer: Column) -> Column:
    q, a = F.length(question), F.length(answer)
    score = (
        _graded(q, QUESTION_IDEAL, QUESTION_RANGE, 0.7) + _graded(a, ANSWER_IDEAL, ANSWER_RANGE, 0.6)
    ) / 2
    return _check(
        "length",
        q.between(*QUESTION_RANGE) & a.between(*ANSWER_RANGE),
        score,
        question_length=q,
        answer_length=a,
    )


def check_format(question: Column) -> Column:
    marked = strip(question).endswith("?")
    opened = strip(F.lower(question)).rlike("^(?:" + "|".join(QUESTION_STARTERS) + ")")
    score = F.when(marked & opened, 1.0).when(marked | opened, 0.7).otherwise(0.0)
    return _check(
        "format", marked | opened, score, has_question_mark=marked, starts_with_qword=opened
    )


def check_content(question: Column, answer: Column) -> Column:
    """Refusals, leaked citations, source phrases and word diversity."""
    low_q, low_a = F.lower(question), F.lower(answer)
    refusals = _hits(low_a, [p.lower() for p in REFUSALS])
    citations = F.regexp_count(answer, F.lit(CITATION_MARK))
    sources = _hits(low_a, SOURCE_PHRASES) + _hits(low_q, SOURCE_PHRASES)
    repetitive = let(
        words(low_a),
        lambda w: (F.size(w) > 10)
        & (F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1)) < 0.25),
    )

    def judged(f: Column) -> Column:
        penalty = (
            f["refusals"] * F.lit(0.3)
            + F.when(f["citations"] > 0, 0.4).otherwise(0.0)
            + f["sources"] * F.lit(0.1)
            + F.when(f["repetitive"], 0.3).otherwise(0.0)
        )
        clean = (f["refusals"] == 0) & (f["citations"] == 0) & ~f["repetitive"]
        return _check(
            "relevance",
            clean,
            F.greatest(F.lit(0.0), 1.0 - penalty),
            refusals=f["refusals"],
            citations=f["citations"],
            source_phrases=f["sources"],
            repetitive=f["repetitive"],
        )

    found = F.struct(
        refusals.alias("refusals"),
        citations.alias("citations"),
        sources.alias("sources"),
        repetitive.alias("repetitive"),
    )
    return let(found, judged)


def completeness_issues(question: Column, answer: Column) -> Column:
    """Names of the completeness rules a pair breaks, in rule order."""

    def cut_off(t: Column) -> Column:
        return (t.endswith("...") | t.endswith("…")) & ~t.endswith("....")

    def listed(p: Column) -> Column:
        q, a = p["q"], p["a"]
        rules = [
            (~q.endswith("?"), "question_mark_missing"),
            (F.length(q) < 30, "question_short"),
            (~a.rlike(r"[.!?]\z"), "answer_end_missing"),
            (F.length(a) < 50, "answer_short"),
            (cut_off(q), "question_truncated"),
            (cut_off(a), "answer_truncated"),
        ]
        return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for broken, name in rules]))

    return let(F.struct(strip(question).alias("q"), strip(answer).alias("a")), listed)


def check_completeness(question: Column, answer: Column) -> Column:
    return let(
        completeness_issues(question, answer),
        lambda issues: _check(
            "completeness",
            F.size(issues) == 0,
            F.greatest(F.lit(0.0), 1.0 - F.size(issues) * F.lit(0.25)),
            issues=issues,
        ),
    )


def is_not_found(answer: Column) -> Column:
    """The generator declined: NOT FOUND among the first 50 characters."""
    return F.substring(F.upper(answer), 1, 50).contains("NOT FOUND")


def duplicate_check(similarity: Column, duplicate_of: Column) -> Column:
    """Duplicate check from the first similar accepted question (null: none)."""
    return F.when(
        similarity.isNull(),
        F.struct(
            F.lit("duplicate").alias("check_type"),
            F.lit(True).alias("passed"),
            F.lit(1.0).alias("score"),
            F.lit("{}").alias("details"),
        ),
    ).otherwise(
        _check(
            "duplicate",
            F.lit(False),
            1.0 - similarity,
            duplicate_of=F.substring(duplicate_of, 1, 100),
            similarity=F.round(similarity, 3),
        )
    )


def composite_score(checks: Column) -> Column:
    """Weighted mean of the checks present, four decimals, 0 when none."""
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("weight"))

    def add(acc: Column, check: Column) -> Column:
        w = F.coalesce(F.try_element_at(weight, check["check_type"]), F.lit(OTHER_WEIGHT))
        return F.struct(
            (acc["sum"] + check["score"] * w).alias("sum"), (acc["weight"] + w).alias("weight")
        )

    return F.aggregate(
        checks,
        zero,
        add,
        lambda acc: F.when(acc["weight"] > 0, F.round(acc["sum"] / acc["weight"], 4)).otherwise(0.0),
    )


def verdict(checks: Column, score: Column, min_score: float = 0.0) -> Column:
    """Pass when every hard check passes and the score is high enough."""
    hard = F.filter(checks, lambda c: c["check_type"].isin("length", "relevance", "duplicate"))
    return F.forall(hard, lambda c: c["passed"]) & (score >= min_score)


def pair_checks(question: Column, answer: Column) -> Column:
    """Length, format and relevance, the checks that need no other row."""
    return F.array(
        check_length(question, answer), check_format(question), check_content(question, answer)
    )
