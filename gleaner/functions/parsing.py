"""Expressions that turn generator responses into pairs, reviews and facts."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleaner.functions.text import collapse_spaces, let, strip

# Reasoning wrappers some models emit.
REASONING_TAGS = ["think", "reasoning", "thought"]

# Citation marks removed from parsed pairs, in this order.
CITATION_PATTERNS = [
    r"(?i)\[Evidence\s*\d+(?:\s*,\s*\d+)*\]",
    r"(?i)\*?\[Evidence\s*\d+\]\*?",
    r"(?i)\(Evidence\s*\d+(?:\s*,\s*\d+)*\)",
    r"(?i)\[Ref(?:erence)?\s*\d+\]",
    r"(?i)\[Source\s*\d+\]",
    r"(?i)\[\d+\]",
]

# How the question and the answer are labelled.
LABELLED_QUESTION = (
    r"(?is)(?:^|\n)\s*(?:#*\s*)?(?:Question|Q)\s*[:：]\s*(.*?)"
    r"(?=\s*\n\s*(?:#*\s*)?(?:Answer|A)\s*[:：])"
)
LABELLED_ANSWER = r"(?is)(?:^|\n)\s*(?:#*\s*)?(?:Answer|A)\s*[:：]\s*(.*)"
COMPACT_QUESTION = r"(?ism)^Q\s*[:：]\s*(.*?)(?=\nA\s*[:：])"
COMPACT_ANSWER = r"(?ism)^A\s*[:：]\s*(.*)"

MIN_QUESTION, MIN_ANSWER = 10, 20
REVIEW_SCORES = ["accuracy", "completeness", "clarity", "relevance", "overall"]
RECOMMENDATIONS = ["approve", "revise", "reject"]


def strip_reasoning(text: Column) -> Column:
    """Drop closed reasoning blocks, then anything after an unclosed one."""
    for tag in REASONING_TAGS:
        text = F.regexp_replace(text, rf"(?is)<{tag}>.*?</{tag}>", "")
    for tag in REASONING_TAGS:
        text = F.regexp_replace(text, rf"(?is)<{tag}>.*\z", "")
    return text


def _without_marks(text: Column, mark: str) -> Column:
    return F.regexp_replace(text, rf"\A{mark}+|{mark}+\z", "")


def _tidy_question(text: Column) -> Column:
    return _without_marks(_without_marks(collapse_spaces(text), '"'), r"\*")


def _tidy_answer(text: Column) -> Column:
    text = strip(F.regexp_replace(text, r"[ \t]+", " "))
    text = _without_marks(_without_marks(text, '"'), r"\*")
    text = strip(F.regexp_replace(text, r"(?s)\n-{3,}.*\z", ""))
    return strip(F.regexp_replace(text, r"(?is)\n(?:Note|Disclaimer|Sources?)\s*:.*\z", ""))


def _without_citations(text: Column) -> Column:
    for pattern in CITATION_PATTERNS:
        text = F.regexp_replace(text, pattern, "")
    return strip(F.regexp_replace(text, "  +", " "))


def parse_qa(response: Column) -> Column:
    """``struct<question, answer>`` of a response, null when none is found."""
    body = strip(
        F.regexp_replace(
            strip_reasoning(F.coalesce(response, F.lit(""))),
            r"(?i)\*\*(Question|Answer|Q|A)\*\*",
            "$1",
        )
    )

    def matched(t: Column, question: str, answer: str) -> Column:
        return F.when(
            t.rlike(question) & t.rlike(answer),
            F.struct(
                F.regexp_extract(t, question, 1).alias("q"),
                F.regexp_extract(t, answer, 1).alias("a"),
            ),
        )

    def cleaned(raw: Column) -> Column:
        return F.struct(
            _without_citations(_tidy_question(strip(raw["q"]))).alias("question"),
            _without_citations(_tidy_answer(strip(raw["a"]))).alias("answer"),
        )

    raw = let(
        body,
        lambda t: F.coalesce(
            matched(t, LABELLED_QUESTION, LABELLED_ANSWER),
            matched(t, COMPACT_QUESTION, COMPACT_ANSWER),
        ),
    )
    pair = let(raw, cleaned)
    return let(
        pair,
        lambda p: F.when(
            (F.length(p["question"]) >= MIN_QUESTION) & (F.length(p["answer"]) >= MIN_ANSWER), p
        ),
    )


def sanitise_json_text(raw: Column) -> Column:
    """Remove reasoning blocks and code fences around a JSON answer."""
    text = strip_reasoning(F.coalesce(raw, F.lit("")))
    return strip(F.regexp_replace(text, r"```(?:json|JSON)?\s*\n?", ""))


def _first_object(text: str | None) -> str | None:
    """First balanced ``{...}``; braces inside JSON strings do not count."""
    at = text.find("{") if text else -1
    if at < 0:
        return None
    depth, quoted, i, n = 0, False, at, len(text)
    while i < n:
        ch = text[i]
        if quoted and ch == "\\":
            i += 1
        elif ch == '"':
            quoted = not quoted
        elif not quoted and ch == "{":
            depth += 1
        elif not quoted and ch == "}":
            depth -= 1
            if depth == 0:
                return text[at : i + 1]
        i += 1
    return None


@F.pandas_udf(StringType())
def balanced_object(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(_first_object)


def json_object(text: Column) -> Column:
    """Variant of a JSON object text, null for anything else."""
    v = F.try_parse_json(text)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def _kind(doc: Column, field: str) -> Column:
    """JSON type of a field: absent and JSON null both read as ``VOID``."""
    value = F.try_variant_get(doc, f"$.{field}", "variant")
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _is_number(kind: Column) -> Column:
    # JSON booleans count as the numbers 0 and 1.
    return kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)")


def _number(doc: Column, field: str) -> Column:
    path = f"$.{field}"
    flag = F.try_variant_get(doc, path, "boolean")
    number = F.try_variant_get(doc, path, "double")
    return F.when(_kind(doc, field) == "BOOLEAN", flag.cast("int").cast("double")).otherwise(number)


def _range_violations(doc: Column, field: str, low: float, high: float, required: bool) -> Column:
    kind = _kind(doc, field)
    return (
        F.when(kind == "VOID", F.lit(f"{field}:missing") if required else F.lit(None))
        .when(~_is_number(kind), F.lit(f"{field}:not_numeric"))
        .when(~_number(doc, field).between(low, high), F.lit(f"{field}:out_of_range"))
    )


def _text_violation(doc: Column, field: str) -> Column:
    return F.when(~_kind(doc, field).isin("VOID", "STRING"), F.lit(f"{field}:not_text"))


def review_violations(doc: Column) -> Column:
    """Schema violations of a review object, in field order."""
    rec = F.when(
        _kind(doc, "recommendation") == "STRING",
        F.try_variant_get(doc, "$.recommendation", "string"),
    )
    found = [_range_violations(doc, f, 0, 10, True) for f in REVIEW_SCORES]
    found.append(
        F.when(
            ~F.coalesce(rec.isin(*RECOMMENDATIONS), F.lit(False)), F.lit("recommendation:invalid")
        )
    )
    found.append(_text_violation(doc, "feedback"))
    return F.array_compact(F.array(*found))


def fact_violations(doc: Column) -> Column:
    """Schema violations of a fact-check object, in field order."""
    analysis = _kind(doc, "analysis")
    return F.array_compact(
        F.array(
            _range_violations(doc, "factual_accuracy", 0, 10, True),
            F.when(
                (analysis != "VOID") & ~analysis.startswith("ARRAY"), F.lit("analysis:not_list")
            ),
            _range_violations(doc, "confidence", 0, 1, False),
            _text_violation(doc, "suggested_answer"),
        )
    )


def _clamped(doc: Column, field: str, low: float, high: float, default: float) -> Column:
    """Number (also from numeric text) clamped to a range, else the default."""
    kind = _kind(doc, field)
    text = F.when(kind == "STRING", F.try_variant_get(doc, f"$.{field}", "string"))
    value = F.when(_is_number(kind), _number(doc, field)).otherwise(strip(text).try_cast("double"))
    return let(
        value,
        lambda x: F.when(x.isNull() | F.isnan(x), F.lit(float(default)))
        .when(x < low, F.lit(float(low)))
        .when(x > high, F.lit(float(high)))
        .otherwise(x),
    )


def coerce_review(doc: Column) -> Column:
    """Review struct with integer scores 0-10 and a recommendation."""

    def completed(s: Column) -> Column:
        rec = F.when(s["rec"].isin(*RECOMMENDATIONS), s["rec"])
        by_score = (
            F.when(s["overall"] >= 7, "approve").when(s["overall"] >= 4, "revise").otherwise("reject")
        )
        return F.struct(
            *[s[f].alias(f) for f in REVIEW_SCORES],
            F.coalesce(rec, by_score).alias("recommendation"),
            F.coalesce(s["feedback"], F.lit("")).alias("feedback"),
        )

    def text(field: str) -> Column:
        return F.when(
            _kind(doc, field) == "STRING", F.try_variant_get(doc, f"$.{field}", "string")
        )

    scores = [F.bround(_clamped(doc, f, 0, 10, 5), 0).cast("int").alias(f) for f in REVIEW_SCORES]
    return let(
        F.struct(*scores, text("recommendation").alias("rec"), text("feedback").alias("feedback")),
        completed,
    )


def coerce_fact(doc: Column) -> Column:
    """Fact-check struct with clamped numbers and a list of findings."""
    items = F.try_variant_get(doc, "$.analysis", "array<string>")
    single = F.try_variant_get(doc, "$.analysis", "string")
    analysis = (
        F.when(_kind(doc, "analysis").startswith("ARRAY"), items)
        .when(_kind(doc, "analysis") != "VOID", F.array(single))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.struct(
        _clamped(doc, "factual_accuracy", 0, 10, 5).alias("factual_accuracy"),
        analysis.alias("analysis"),
        F.try_variant_get(doc, "$.suggested_answer", "string").alias("suggested_answer"),
        _clamped(doc, "confidence", 0, 1, 0.5).alias("confidence"),
    )


def fallback_review(feedback: str) -> Column:
    """The review of a pair that could not be reviewed."""
    return F.struct(
        *[F.lit(0).alias(f) for f in REVIEW_SCORES],
        F.lit("revise").alias("recommendation"),
        F.lit(feedback).alias("feedback"),
    )


def fallback_fact() -> Column:
    return F.struct(
        F.lit(0.0).alias("factual_accuracy"),
        F.array().cast("array<string>").alias("analysis"),
        F.lit(None).cast("string").alias("suggested_answer"),
        F.lit(0.0).alias("confidence"),
    )
