import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import dedup
from gleaner.operators.similar_text import candidate_pairs, similar_pairs
from gleaner.operators.similar_vectors import TILE, cosine_pairs, cosine_self_pairs, tiled

VOCAB = "what is the treatment for diabetes cause of heart failure risk in adults dose drug aspirin".split()


def mutated(rng, text):
    chars = list(text)
    for _ in range(rng.randint(1, max(1, len(chars) // 14))):
        i, kind = rng.randrange(len(chars)), rng.random()
        if kind < 0.4:
            chars[i] = rng.choice("abcde ")
        elif kind < 0.7:
            chars.insert(i, rng.choice("xyz"))
        elif len(chars) > 3:
            del chars[i]
    return "".join(chars)


@pytest.fixture(scope="module")
def texts():
    rng, out = random.Random(1), {}
    while len(out) < 220:
        base = " ".join(rng.choice(VOCAB) for _ in range(rng.randint(1, 34)))
        for t in [base] + [mutated(rng, base) for _ in range(rng.randint(0, 2))]:
            out.setdefault(t, None)
    return list(out)


def brute(texts, threshold):
    return {
        (j, i)
        for i in range(len(texts))
        for j in range(i)
        if difflib.SequenceMatcher(None, texts[i], texts[j]).ratio() >= threshold
    }


def greedy(n, edges):
    lost = set()
    for v in range(n):
        if any(a not in lost for a, b in edges if b == v):
            lost.add(v)
    return lost


@pytest.mark.parametrize("threshold, per_task", [(0.92, 20_000), (0.92, 20), (0.8, 20_000)])
def test_similar_pairs_equal_brute_force(spark, texts, threshold, per_task):
    df = spark.createDataFrame(list(enumerate(texts)), "gid long, text string")
    got = {(r["earlier"], r["later"]) for r in similar_pairs(df, threshold, per_task).collect()}
    assert got == brute(texts, threshold)


def test_two_table_candidates_cover_all_similar_pairs(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "gid long, text string")
    found = candidate_pairs(df.filter("gid % 3 = 0"), 0.92, others=df.filter("gid % 3 != 0"))
    got = {(r["a"], r["b"]) for r in found.collect()}
    want = {(a, b) for a, b in brute(texts, 0.92) if (a % 3 == 0) != (b % 3 == 0)}
    assert want <= got
    assert all((a % 3 == 0) != (b % 3 == 0) for a, b in got)


def test_threshold_bounds(spark):
    with pytest.raises(ValueError):
        candidate_pairs(spark.createDataFrame([(1, "a")], "gid long, text string"), 0.5)


def test_first_wins_rounds_equal_a_loop(spark):
    rng = random.Random(3)
    edges = sorted({tuple(sorted(rng.sample(range(120), 2))) for _ in range(200)})
    df = spark.createDataFrame(edges, "earlier long, later long")
    assert {r["id"] for r in dedup.first_wins_rejected(df).collect()} == greedy(120, edges)


def test_questions_keep_the_first_of_each_family(spark, texts):
    shown = [t.upper() if i % 5 == 0 else t for i, t in enumerate(texts + texts[:40])]
    norm = [" ".join(t.lower().split()) for t in shown]
    edges = brute(norm, 0.92)
    df = spark.createDataFrame(list(enumerate(shown)), "pos long, q string")
    kept = {r["pos"] for r in dedup.dedup_questions(df, "pos", "q").collect()}
    assert kept == set(range(len(shown))) - greedy(len(shown), edges)


def test_crowds_of_near_copies_give_the_same_result(spark):
    crowd = [f"what is the usual dose of drug number {i:03d} for adults with heart failure" for i in range(150)]
    rng = random.Random(4)
    rest = [" ".join(rng.choice(VOCAB) for _ in range(12)) for _ in range(60)]
    rows = crowd + rest
    rng.shuffle(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "pos long, q string")
    kept = {r["pos"] for r in dedup.dedup_questions(df, "pos", "q").collect()}
    assert kept == set(range(len(rows))) - greedy(len(rows), brute(rows, 0.92))


def test_fuzzy_edges_reach_copies_from_the_first_holder(spark):
    rows = [(0, "What is asthma in adults?"), (1, "what is  asthma in adults?"), (2, "What is asthma in adult?")]
    df = spark.createDataFrame(rows, "pos long, q string")
    got = {(r["earlier"], r["later"]) for r in dedup.fuzzy_edges(df, "pos", "q").collect()}
    assert got == {(0, 1), (0, 2)}


def test_fuzzy_edges_reach_later_copies_of_an_earlier_text(spark):
    rows = [(0, "What is severe asthma?"), (1, "What was severe asthma?"), (2, "WHAT  is severe asthma?")]
    df = spark.createDataFrame(rows, "pos long, q string")
    got = {(r["earlier"], r["later"]) for r in dedup.fuzzy_edges(df, "pos", "q", 0.9).collect()}
    assert got == {(0, 1), (0, 2), (1, 2)}


def unit(rng, n, d):
    m = rng.normal(size=(n, d))
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("tile", [4_096, 17])
def test_cosine_pairs_equal_brute_force(spark, tile):
    rng = np.random.default_rng(5)
    base = unit(rng, 40, 8)
    m = np.vstack([base, base + rng.normal(scale=0.05, size=base.shape)]).astype(np.float32)
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "gid long, vec array<float>")
    scores = m.astype(np.float64) @ m.astype(np.float64).T
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if scores[i, j] >= 0.92}
    got = {(r["earlier"], r["later"]) for r in cosine_self_pairs(df, 0.92, tile).collect()}
    assert got == want and want
    none = cosine_pairs(df.filter("gid < 0").withColumnRenamed("gid", "lid"), df.withColumnRenamed("gid", "rid"), 0.9)
    assert none.count() == 0


def test_vector_dedup_equals_a_loop(spark):
    rng = np.random.default_rng(6)
    crowd = np.repeat(unit(rng, 1, 8), 40, axis=0) + rng.normal(scale=0.03, size=(40, 8))
    m = np.vstack([unit(rng, 60, 8), crowd])[rng.permutation(100)]
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    s = m.astype(np.float64) @ m.astype(np.float64).T
    edges = [(i, j) for i in range(100) for j in range(i + 1, 100) if s[i, j] >= 0.9]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<float>")
    kept = {r["id"] for r in dedup.dedup_vectors(df, "id", "v", 0.9).collect()}
    assert kept == set(range(100)) - greedy(100, edges)


def clustered(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    centres = unit(rng, n // 40, 16)
    m = centres[rng.integers(0, len(centres), n)] + rng.normal(scale=0.02, size=(n, 16))
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    return m, spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "gid long, vec array<float>")


def test_tiles_grow_slower_than_the_square_of_clustered_rows(spark):
    visited = {}
    for n in (600, 2_400):
        m, df = clustered(spark, n)
        rows, _ = tiled(df.withColumnRenamed("gid", "lid"), df.withColumnRenamed("gid", "rid"), 0.95, 64)
        visited[n] = rows.count(), rows.select(*TILE).distinct().count()
    assert visited[2_400][0] < 8 * visited[600][0]  # 16 times without pruning
    assert visited[2_400][1] < 8 * visited[600][1]
    scores = m.astype(np.float64) @ m.astype(np.float64).T
    assert cosine_self_pairs(df, 0.95, 64).count() == int((np.triu(scores, 1) >= 0.95).sum())


def test_the_best_of_tiles_hold_the_best_of_all(spark):
    m, df = clustered(spark, 400)
    few = df.filter("gid % 20 = 0")
    near = cosine_pairs(few.withColumnRenamed("gid", "lid"), df.withColumnRenamed("gid", "rid"), 0.3, 32, best=3).collect()
    scores = m.astype(np.float64) @ m.astype(np.float64).T
    for q in range(0, 400, 20):
        got = sorted((-r["score"], r["rid"]) for r in near if r["lid"] == q)[:3]
        want = sorted((-scores[q, i], i) for i in range(400) if scores[q, i] >= 0.3)[:3]
        assert [i for _, i in got] == [i for _, i in want]


def test_visits_repeat_vectors_a_few_at_a_time(spark, monkeypatch):
    """A batch whose rows visit every tile leaves in pieces, and a row goes to a tile once."""
    from gleaner.operators import similar_vectors

    rng = np.random.default_rng(8)
    m = unit(rng, 900, 16)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "gid long, vec array<float>").coalesce(1)
    monkeypatch.setattr(similar_vectors, "SLICE", 1_600)  # 100 vectors of 16
    rows, homes = tiled(df.withColumnRenamed("gid", "lid"), df.withColumnRenamed("gid", "rid"), 0.3, 64)
    by_row = rows.groupBy("lid", *TILE).count()
    assert by_row.filter("count > 1").count() == 0
    # unclustered rows are sent once per tile of up to 64 rows, not once per cell of 4
    assert rows.count() < 900 * 2.5 * 900 / 64
    scores = m.astype(np.float64) @ m.astype(np.float64).T
    assert cosine_self_pairs(df, 0.3, 64).count() == int((np.triu(scores, 1) >= 0.3).sum())


def test_hits_are_made_in_slices_of_bounded_size(monkeypatch):
    from gleaner.operators import similar_vectors

    monkeypatch.setattr(similar_vectors, "SLICE", 4_096)
    m = unit(np.random.default_rng(9), 500, 16)
    for threshold in (-1.0, 0.5):
        found = list(similar_vectors._hits(m, m, threshold, None))
        assert max(len(i) for i, _, _ in found) <= 4_096
        got = {(x, y) for i, j, _ in found for x, y in zip(i.tolist(), j.tolist())}
        scores = m.astype(np.float64) @ m.astype(np.float64).T
        assert len(got) == sum(len(i) for i, _, _ in found)
        assert got == {(x, y) for x, y in zip(*(v.tolist() for v in np.nonzero(scores >= threshold)))}


def test_rows_without_a_vector_meet_nothing(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.0])], "gid long, vec array<float>")
    assert [(r["earlier"], r["later"]) for r in cosine_self_pairs(df, 0.9).collect()] == [(1, 3)]
