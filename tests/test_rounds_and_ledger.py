"""Answers that outlive a lost run, and rounds that go on until the target."""
import os
import time
from collections import Counter

import pytest

from gleaner.operators import generation, review
from gleaner.plans.generation_queries import md5_generate
from gleaner.plans.rounds import run_rounds


def prompts(spark, n):
    return spark.createDataFrame([(i, f"prompt {i}") for i in range(n)], "prompt_index long, prompt string")


def noting(generate, log):
    def noted(prompt, temperature):
        with open(log, "a") as f:
            f.write(prompt.split("\n")[0] + "\n")
        return generate(prompt, temperature)

    return noted


def test_a_lost_run_repeats_no_answered_call(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(generation, "CALLS_A_TASK", 5)
    log, mended, ledger = str(tmp_path / "calls"), str(tmp_path / "mended"), str(tmp_path / "ledger")

    def generate(prompt, temperature):
        if prompt == "prompt 17" and not os.path.exists(mended):
            time.sleep(5)
            os._exit(1)
        with open(log, "a") as f:
            f.write(prompt + "\n")
        return f"reply to {prompt}"

    df = prompts(spark, 40)
    with pytest.raises(Exception):
        generation.infer(df, "prompt", generate, 0.5, ledger=ledger)
    kept = {r["response"].removeprefix("reply to ") for r in generation.ledger_rows(spark, ledger).collect()}
    assert len(kept) >= 15 and "prompt 17" not in kept
    open(mended, "w").close()
    got = {r["prompt"]: r["response"] for r in generation.infer(df, "prompt", generate, 0.5, ledger=ledger).collect()}
    assert got == {f"prompt {i}": f"reply to prompt {i}" for i in range(40)}
    calls = Counter(open(log).read().splitlines())
    assert all(calls[p] == 1 for p in kept)
    again = generation.infer(df.unionByName(df), "prompt", generate, 0.5, ledger=ledger)
    assert again.count() == 80 and Counter(open(log).read().splitlines()) == calls


def test_failed_calls_are_asked_again_by_the_next_run(spark, tmp_path):
    mended, ledger = str(tmp_path / "mended"), str(tmp_path / "ledger")

    def generate(prompt, temperature):
        if prompt == "prompt 1" and not os.path.exists(mended):
            raise ValueError("busy")
        return None if prompt == "prompt 2" else "fine"

    df = prompts(spark, 3)
    first = {r["prompt_index"]: (r["response"], r["response_error"]) for r in generation.infer(df, "prompt", generate, 0.5, ledger=ledger).collect()}
    assert first == {0: ("fine", None), 1: (None, "busy"), 2: (None, None)}
    open(mended, "w").close()
    second = {r["prompt_index"]: (r["response"], r["response_error"]) for r in generation.infer(df, "prompt", generate, 0.5, ledger=ledger).collect()}
    assert second == {0: ("fine", None), 1: ("fine", None), 2: (None, None)}


def test_a_review_session_with_a_ledger_asks_once(spark, tmp_path):
    log = str(tmp_path / "calls")
    judge = noting(lambda p, t: '{"accuracy": 8, "completeness": 8, "clarity": 8, "relevance": 8, "overall": 8, "recommendation": "approve", "feedback": "ok"}', log)
    pairs = spark.createDataFrame([(i, f"What is number {i}?", "An answer.") for i in range(6)], "id long, question string, answer string")
    for _ in range(2):
        done = review.review_pairs(pairs, judge, ledger=str(tmp_path / "ledger"))
        assert {r["review"]["overall"] for r in done.collect()} == {8}
    assert len(open(log).read().splitlines()) >= 6 and done.count() == 6
    calls = len(open(log).read().splitlines())
    review.run_review_session(pairs, done.limit(2), judge, ledger=str(tmp_path / "ledger")).collect()
    assert len(open(log).read().splitlines()) == calls


def test_rounds_go_on_behind_the_last_one(spark, tmp_path):
    log, folder = str(tmp_path / "calls"), str(tmp_path / "run")
    ask = noting(md5_generate, log)
    few = run_rounds(prompts(spark, 90), 6, ask, "stub", folder)
    assert few.outcomes.filter("accepted").count() == 6
    first = {r["prompt_index"] for r in few.outcomes.filter("accepted").collect()}
    more = run_rounds(prompts(spark, 90), 20, ask, "stub", folder)
    won = [r["prompt_index"] for r in more.outcomes.filter("accepted").orderBy("round", "prompt_index").collect()]
    assert len(won) == 20 and first <= set(won) and won == sorted(won)
    states = more.states.orderBy("round").collect()
    assert len(states) >= 2 and sum(s["accepted"] for s in states) == 20
    assert all(a["last"] < b["last"] for a, b in zip(states, states[1:]))
    # a prompt is asked once, and once more where its first reply did not parse
    assert max(Counter(open(log).read().splitlines()).values()) <= 2
    calls = len(open(log).read().splitlines())
    same = run_rounds(prompts(spark, 90), 20, ask, "stub", folder)
    assert same.outcomes.filter("accepted").count() == 20 and len(open(log).read().splitlines()) == calls


def test_rounds_end_when_no_prompt_is_left(spark, tmp_path):
    done = run_rounds(prompts(spark, 12), 1_000, md5_generate, "stub", str(tmp_path / "run"))
    assert done.generated.count() == 12 and done.states.count() == 1
    none = run_rounds(prompts(spark, 0), 5, md5_generate, "stub", str(tmp_path / "none"))
    assert none.outcomes.count() == 0 and none.states.count() == 0
