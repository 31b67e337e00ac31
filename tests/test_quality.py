import pytest
from pyspark.sql import functions as F

from gleaner.functions import quality

GOOD_Q = "What are the symptoms of heart failure?"
GOOD_A = "Common symptoms of heart failure include shortness of breath, fatigue and swelling in the legs."


def checks(spark, q, a):
    df = spark.createDataFrame([(q, a)], "q string, a string")
    row = df.select(
        quality.pair_checks(F.col("q"), F.col("a")).alias("c"),
        quality.check_completeness(F.col("q"), F.col("a")).alias("complete"),
        quality.is_not_found(F.col("a")).alias("not_found"),
    ).withColumn("score", quality.composite_score(F.col("c"))).withColumn(
        "passed", quality.verdict(F.col("c"), F.col("score"))
    ).first()
    return {c["check_type"]: c for c in row["c"]}, row


@pytest.mark.parametrize(
    "q, a, ok",
    [
        ("What is diabetes mellitus?", "Diabetes mellitus is a chronic condition of blood sugar.", True),
        ("What?", "A valid answer with enough content to pass the minimum.", False),
        ("What is the treatment for hypertension?", "Medication.", False),
    ],
)
def test_length(spark, q, a, ok):
    assert checks(spark, q, a)[0]["length"]["passed"] is ok


@pytest.mark.parametrize(
    "q, ok, score",
    [
        ("What is the recommended dosage?", True, 1.0),
        ("Explain the mechanism of action", True, 0.7),
        ("The patient was given medication", False, 0.0),
        ("island medicine", True, 0.7),
    ],
)
def test_format(spark, q, ok, score):
    got = checks(spark, q, GOOD_A)[0]["format"]
    assert (got["passed"], got["score"]) == (ok, score)


def test_content(spark):
    assert checks(spark, GOOD_Q, GOOD_A)[0]["relevance"]["passed"]
    assert not checks(spark, GOOD_Q, "I am a language model and cannot help.")[0]["relevance"]["passed"]
    cited = checks(spark, GOOD_Q, "As shown [Evidence 2] the text states so.")[0]["relevance"]
    assert not cited["passed"] and cited["score"] == pytest.approx(1 - 0.4 - 0.1)
    assert not checks(spark, GOOD_Q, "same " * 40)[0]["relevance"]["passed"]


def test_composite(spark):
    got, row = checks(spark, GOOD_Q, GOOD_A)
    assert row["passed"] and row["score"] > 0.5 and len(got) == 3
    assert not checks(spark, "Hi", "No")[1]["passed"]


def test_completeness_and_not_found(spark):
    assert checks(spark, GOOD_Q, GOOD_A)[1]["complete"]["passed"]
    broken = checks(spark, "Why so...", "It ends…")[1]["complete"]
    assert broken["score"] == 0.0 and "question_truncated" in broken["details"]
    assert "truncated" not in checks(spark, "Why....?", "x....")[1]["complete"]["details"]
    assert checks(spark, GOOD_Q, "Sorry, not found in the evidence.")[1]["not_found"]
    assert not checks(spark, GOOD_Q, "x" * 50 + "NOT FOUND")[1]["not_found"]
