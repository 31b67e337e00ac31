import difflib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import quality
from gleaner.functions.vectors import hashing_encoder, unit_rows
from gleaner.operators import validation

VOCAB = "what is the treatment for diabetes cause of heart failure risk in adults symptom dose drug".split()
ANSWERS = [
    "NOT FOUND", "short.",
    "The answer is long enough to pass all of the checks we have here today.",
    "Another answer that is long enough to pass all of the checks we have.",
    "As an AI I can say the answer is long enough to pass the check we have.",
    "Truncated answer that is long enough but ends with dots indeed yes...",
]


def norm(text):
    return re.sub(r"\s+", " ", text.lower().strip())


def made_rows(n, seed):
    rng, rows = random.Random(seed), []
    while len(rows) < n:
        q = "What " + " ".join(rng.choice(VOCAB) for _ in range(rng.randint(5, 14))) + "?"
        if rows and rng.random() < 0.5:
            q, kind = rng.choice(rows)[1], rng.random()
            if kind < 0.3:
                q = q.upper()
            elif kind < 0.7:
                j = rng.randrange(5, len(q) - 2)
                q = q[:j] + rng.choice("abc") + q[j + 1 :]
            else:
                w = q[:-1].split()[1:]
                rng.shuffle(w)
                q = "What " + " ".join(w) + "?"
        rows.append((len(rows), q, rng.choice(ANSWERS)))
    return rows


def sequential(rows, facts, seeds, semantic):
    accepted, vectors, out = list(seeds), [], {}
    for pos, q, _ in rows:
        f = facts[pos]
        if f["nf"]:
            out[pos] = ("not_found", 0.0)
            continue
        if not f["complete"]:
            out[pos] = ("completeness", 0.0)
            continue
        dup = None
        for e in accepted:
            if norm(q) == norm(e):
                dup = 0.0
            else:
                r = difflib.SequenceMatcher(None, norm(q), norm(e)).ratio()
                dup = 1 - r if r >= 0.92 else None
            if dup is not None:
                break
        l, fm, c = f["checks"]
        score = round(
            l["score"] * 0.25 + fm["score"] * 0.2 + c["score"] * 0.3 + (1.0 if dup is None else dup) * 0.25, 4
        )
        if not (l["passed"] and c["passed"] and dup is None and score >= 0.4):
            out[pos] = ("quality" if dup is None else "duplicate", score)
            continue
        v = unit_rows(hashing_encoder([norm(q)]))[0].astype(float)
        if vectors and max(np.array(vectors) @ v) >= semantic:
            out[pos] = ("semantic_dup", score)
            continue
        accepted.append(q)
        vectors.append(v)
        out[pos] = (None, score)
    return out


@pytest.mark.parametrize("semantic", [0.92, 0.8])
def test_validation_equals_a_sequential_run(spark, semantic):
    rows = made_rows(160, 7)
    df = spark.createDataFrame(rows, "pos long, question string, answer string")
    q, a = F.col("question"), F.col("answer")
    facts = {
        r["pos"]: r
        for r in df.select(
            "pos",
            quality.is_not_found(a).alias("nf"),
            quality.check_completeness(q, a)["passed"].alias("complete"),
            quality.pair_checks(q, a).alias("checks"),
        ).collect()
    }
    seeds = [rows[3][1], "What is the treatment for heart failure in adults?"]
    seed_df = spark.createDataFrame(list(enumerate(seeds)), "position long, question string")
    want = sequential(rows, facts, seeds, semantic)
    out = validation.validate_pairs(df, "pos", 0.4, seed_df, semantic_threshold=semantic)
    got = {r["pos"]: (r["reason"], r["quality_score"]) for r in out.collect()}
    assert got.keys() == want.keys()
    for pos, (reason, score) in want.items():
        assert got[pos][0] == reason, pos
        assert got[pos][1] == pytest.approx(score, abs=2e-4)
    target = validation.cut_at_target(out, "pos", 10)
    last = sorted(p for p, (r, _) in want.items() if r is None)[9]
    assert {r["pos"] for r in target.collect()} == {p for p in want if p <= last}
    summary = validation.validation_summary(out).first()
    assert summary["total_accepted"] == sum(r is None for r, _ in want.values())
    if semantic > 0.9:  # the ranges are many jobs: once is enough
        return
    ranges = validation.validate_until(df, "pos", 10, 0.4, seed_df, semantic_threshold=semantic)
    assert {r["pos"]: r["reason"] for r in ranges.collect()} == {r["pos"]: r["reason"] for r in target.collect()}


def test_curated_pairs_are_all_kept(spark):
    rows = made_rows(80, 9)
    df = spark.createDataFrame(rows, "pos long, question string, answer string")
    seen, dup = [], {}
    for pos, q, _ in rows:
        dup[pos] = any(
            norm(q) == norm(e) or difflib.SequenceMatcher(None, norm(q), norm(e)).ratio() >= 0.92
            for e in seen
        )
        seen.append(q)
    got = validation.store_curated(df, "pos").collect()
    assert len(got) == len(rows)
    for r in got:
        checks = {c["check_type"]: c["passed"] for c in r["checks"]}
        assert checks["duplicate"] is not dup[r["pos"]]
        ok = checks["length"] and checks["relevance"] and checks["duplicate"]
        assert r["validation_status"] == ("approved" if ok else "pending")
