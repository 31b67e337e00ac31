import json
import re

import pytest
from pyspark.sql import functions as F

from gleaner.functions import parsing
from gleaner.operators import changes, review

PAIRS = [(i, f"What is question {i}?", f"Answer {i}", "pending", False) for i in range(6)]


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame(
        PAIRS, "id long, question string, answer string, validation_status string, human_edited boolean"
    )


@pytest.mark.parametrize(
    "raw, question, answer",
    [
        ("Question: What is a heart?\nAnswer: It is a muscular organ here.", "What is a heart?", "It is a muscular organ here."),
        ("<THINK>x\ny</think>**Q**: What is a heart?\n**A**: It is a muscular organ here.", "What is a heart?", "It is a muscular organ here."),
        ("Q：What is\n a heart?\n\n A： It is [1] a  (Evidence 2) muscular organ.\n---\nbye", "What is a heart?", "It is a muscular organ."),
        ('Question: "What is a heart?"\nAnswer: *It is a muscular organ here.*\nSources: x', "What is a heart?", "It is a muscular organ here.*"),
        ("Question: Short?\nAnswer: It is a muscular organ here.", None, None),
        ("<think>Question: What is a heart?\nAnswer: It is a muscular organ here.", None, None),
        ("no labels at all", None, None),
        ("", None, None),
    ],
)
def test_pair_layouts(spark, raw, question, answer):
    row = spark.createDataFrame([(raw,)], "r string").select(parsing.parse_qa(F.col("r")).alias("p")).first()
    assert (row["p"] and tuple(row["p"])) == (question and (question, answer))


@pytest.mark.parametrize(
    "raw, method, value",
    [
        ('{"a": 1}', "direct", 1),
        ('```json\n{"a": 1}\n```', "direct", 1),
        ('<think>{"a": 2}</think>Sure {"a": 1, "s": "}{\\""} done', "extraction", 1),
        ("[1, 2]", "failed", None),
        ('{"a": 1', "failed", None),
        (None, "failed", None),
    ],
)
def test_json_from_noise(spark, raw, method, value):
    df = review.parse_json_rows(spark.createDataFrame([(raw,)], "r string"), "r")
    row = df.select("method", F.try_variant_get("doc", "$.a", "int").alias("a")).first()
    assert (row["method"], row["a"]) == (method, value)


def test_coercion_defaults_and_rounding(spark):
    docs = [
        '{"accuracy": 2.5, "completeness": "8", "clarity": -3, "relevance": null, "overall": 99}',
        '{"overall": 3, "recommendation": "maybe", "feedback": 5}',
    ]
    df = spark.createDataFrame([(d,) for d in docs], "d string").select(
        parsing.coerce_review(F.parse_json("d")).alias("r")
    )
    a, b = [r["r"] for r in df.collect()]
    assert tuple(a)[:5] == (2, 8, 0, 5, 10) and a["recommendation"] == "approve"
    assert tuple(b)[:5] == (5, 5, 5, 5, 3) and tuple(b)[5:] == ("reject", "")


def reply(**kw):
    base = {"accuracy": 8, "completeness": 8, "clarity": 8, "relevance": 8, "overall": 8, "recommendation": "approve"}
    return json.dumps({**base, **kw})


def test_review_retries_then_coerces_then_falls_back(spark, pairs):
    def judge(prompt, temperature):
        n = int(re.search(r"What is question (\d+)", prompt)[1])
        again = "previous reply" in prompt
        if n == 0:
            return reply()
        if n == 1:
            return reply(overall=9) if again else "bad"
        if n == 2:
            return reply(overall=20) if again else "bad"
        if n == 3:
            return "bad" if again else reply(clarity=12)
        if n == 4:
            return "bad"
        raise RuntimeError("limit")

    got = {r["id"]: r for r in review.review_pairs(pairs, judge).collect()}
    assert [got[i]["review"]["overall"] for i in range(6)] == [8, 9, 10, 8, 0, 0]
    assert got[3]["review"]["clarity"] == 10
    assert got[4]["review"]["recommendation"] == "revise"
    assert [got[i]["error"] for i in (4, 5)] == [None, "limit"]


def test_replies_are_parsed_before_they_are_written(spark, pairs, capsys):
    def judge(prompt, temperature):
        return "Here: " + json.dumps({"factual_accuracy": 4, "suggested_answer": "A better one."})

    facts = review.fact_check_pairs(pairs, judge)
    assert {tuple(r["fact_check"])[::2] for r in facts.collect()} == {(4.0, "A better one.")}
    capsys.readouterr()
    facts.explain()
    plan = capsys.readouterr().out.lower()
    assert "scan" in plan and "parse" not in plan and "balanced_object" not in plan


def test_workflow_decides_and_tries_suggestions(spark, pairs):
    scores = {0: 9, 1: 6, 2: 6, 3: 2, 4: 6.95, 5: 9}

    def judge(prompt, temperature):
        n = int(re.search(r"What is question (\d+)", prompt)[1])
        if "Rate this" in prompt:
            if n == 5:
                raise RuntimeError("down")
            return reply()
        if "better one" in prompt:
            return json.dumps({"factual_accuracy": 8 if n == 1 else 5})
        return json.dumps({"factual_accuracy": scores[n], "suggested_answer": "A better one."})

    def fixed(prompt, temperature):
        return judge(prompt.replace("A better one.", "A better one"), temperature)

    rows = review.approval_workflow(pairs, fixed, accept_suggestions=True).collect()
    got = {r["id"]: r for r in rows}
    assert [got[i]["decision"] for i in range(6)] == ["approved", "approved", "pending", "pending", "pending", "error"]
    assert [got[i]["audit"]["suggestion_applied"] for i in range(5)] == [False, True, True, False, False]
    assert got[1]["suggestion_applied"]["old_answer"] == "Answer 1" and got[1]["answer"] == "A better one."
    assert got[4]["answer"] == "Answer 4"


def test_session_resumes_without_repeating(spark, pairs):
    asked = spark.sparkContext.accumulator(0)

    def judge(prompt, temperature):
        asked.add(1)
        return reply()

    done = pairs.filter("id < 4").select(
        "id", parsing.fallback_review("before").alias("review"), F.lit(None).cast("string").alias("error")
    )
    assert review.run_review_session(pairs, done, judge).count() == 6
    assert asked.value == 2


def test_costs(spark):
    df = spark.createDataFrame([("gpt-4o", 10), ("unknown", 10)], "model string, pair_count long")
    got = {r["model"]: r["cost_usd"] for r in review.estimate_costs(df).collect()}
    assert got == {"gpt-4o": 0.0475, "unknown": 0.0}


def test_edits_and_suggestions_round_trip(spark, pairs):
    edits = spark.createDataFrame([(1, "New question?", None), (2, None, "approved")], "id long, question string, validation_status string")
    got = {r["id"]: r for r in changes.edit_pairs(pairs, edits).collect()}
    assert (got[1]["question"], got[1]["human_edited"]) == ("New question?", True)
    assert (got[2]["validation_status"], got[2]["human_edited"]) == ("approved", False)
    facts = pairs.withColumns(
        {
            "fact_check": F.struct(F.lit(5.0).alias("factual_accuracy"), F.lit("Better").alias("suggested_answer")),
            "suggestion_applied": F.lit(None).cast("struct<old_answer:string,source:string,fact_check_score:double>"),
        }
    )
    ids = pairs.filter("id = 3").select("id")
    applied = changes.accept_suggestions(facts, ids)
    assert applied.filter("answer = 'Better'").count() == 1
    back = changes.revert_suggestions(applied, ids)
    assert back.filter("id = 3").first()["answer"] == "Answer 3"
    assert back.filter("suggestion_applied is not null").count() == 0
