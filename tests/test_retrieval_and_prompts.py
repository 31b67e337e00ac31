import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.functions import vectors
from gleaner.operators import generation, prompts, ranking, retrieval
from gleaner.operators.ranking import with_global_rank, with_group_rank
from gleaner.plans.curate import RunSettings, generate_dataset
from gleaner.plans.generation_queries import stub_generate


def round_robin(hits, k, per_source):
    """The diverse choice, one chunk at a time."""
    groups = defaultdict(list)
    for h in hits[: 10 * k]:
        groups[h[1]].append(h)
    order = sorted(groups, key=lambda s: -groups[s][0][2])
    used, out = defaultdict(int), []
    while len(out) < k:
        before = len(out)
        for s in order:
            if len(out) < k and used[s] < min(per_source, len(groups[s])):
                out.append(groups[s][used[s]])
                used[s] += 1
        if len(out) == before:
            break
    return sorted(out, key=lambda h: -h[2])


@pytest.fixture(scope="module")
def chunk_vectors():
    rng = np.random.default_rng(8)
    m = rng.normal(size=(120, 6))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.fixture
def chunks(spark, chunk_vectors):
    rows = [
        (i, f"s{i % 4 if i % 3 else 0}", i % 4, i, f"text {i} {{domain}}", 2, [float(x) for x in v])
        for i, v in enumerate(chunk_vectors)
    ]
    return spark.createDataFrame(
        rows,
        "chunk_id long, source_filename string, source_id int, chunk_index int, content string, "
        "word_count int, vec array<float>",
    )


def test_diverse_retrieval_equals_round_robin(spark, chunks, chunk_vectors):
    topics = chunks.filter("chunk_id < 3").select(F.concat(F.lit("q"), "chunk_id").alias("query"), "vec")
    hits = retrieval.scored_hits(topics, chunks, 60, 0.25)
    got = defaultdict(list)
    for r in retrieval.diverse_top_k(hits, 6).orderBy("query", "rank").collect():
        got[r["query"]].append(r["chunk_id"])
    f32 = chunk_vectors.astype(np.float32).astype(np.float64)
    for q in range(3):
        scored = sorted(
            [(i, f"s{i % 4 if i % 3 else 0}", float(f32[i] @ f32[q])) for i in range(120)],
            key=lambda h: (-h[2], h[0]),
        )
        want = round_robin([h for h in scored if h[2] >= 0.25], 6, 3)
        assert got[f"q{q}"] == [h[0] for h in want]
    most = retrieval.diverse_top_k(hits, 6).groupBy("query", "source_filename").count()
    assert most.agg(F.max("count")).first()[0] <= 3


def test_new_chunks_only_are_embedded(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "c d")], "chunk_id long, content string")
    done = retrieval.embed_chunks(rows.filter("chunk_id = 1"))
    assert [r["chunk_id"] for r in retrieval.append_embeddings(done, rows).collect()] == [2]


def test_rag_prompts_skip_terms_without_evidence_and_cycle(spark, chunks):
    far = [[0.0] * 6]
    terms = chunks.filter("chunk_id in (5, 9)").select(
        F.col("chunk_id").alias("position"), F.concat(F.lit("t"), "chunk_id").alias("query"), "vec"
    ).unionByName(
        spark.createDataFrame([(7, "none", far[0])], "position long, query string, vec array<float>")
    )
    plan = prompts.rag_prompts(terms, chunks, "dom", ["factual", "reasoning"], ["advanced"], 12, ["Old?"])
    got = plan.orderBy("prompt_index").collect()
    assert [r["prompt_index"] for r in got] == list(range(8))
    assert [r["query_term"] for r in got] == ["t5"] * 4 + ["t9"] * 4
    assert [r["question_type"] for r in got] == ["factual", "reasoning"] * 4
    assert len(got[1]["citation_chunk_ids"]) == 6 and len(got[3]["citation_chunk_ids"]) == 5
    assert got[1]["primary_chunk_id"] == got[1]["citation_chunk_ids"][1]
    assert "{domain}" in got[0]["prompt"] and got[0]["prompt"].endswith("  - Old?")


def test_balanced_sample_fills_from_leftovers(spark):
    rows = [(i, "PDF" if i < 30 else "PubMed", f"c{i}", "f") for i in range(34)]
    df = spark.createDataFrame(rows, "chunk_id long, source_type string, content string, source_filename string")
    got = prompts.balanced_sample(df, 20).collect()
    kinds = [r["source_type"] for r in got]
    assert (kinds.count("PDF"), kinds.count("PubMed")) == (16, 4)
    assert sorted(r["prompt_index"] for r in got) == list(range(20))
    limited = prompts.balanced_sample(df, 20, {"PDF": 5}).collect()
    assert len(limited) == 9


@pytest.mark.parametrize("border", [ranking.BORDER, 3])
def test_draw_cuts_match_a_sort(spark, monkeypatch, border):
    monkeypatch.setattr(ranking, "BORDER", border)  # 3: several rounds, keys repeated more often than that
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(400)) for _ in range(1200)]
    df = spark.createDataFrame(rows, "g string, k int").withColumn("d", ranking.seeded_draw(1, F.col("k")))
    places = [(g, f"p{p}", p) for g in ("a", "b", None, "z") for p in (0, 1, 100, 390, 10**6)]
    got = ranking.draw_cuts(df, places, "g", "d")
    for g, name, place in places:
        draws = sorted(hashlib.md5(f"1:{k}".encode()).hexdigest() for kind, k in rows if kind == g)
        want = (draws[place], draws.index(draws[place])) if place < len(draws) else None
        assert got.get((g, name)) == want
    assert ranking.draw_cuts(df.limit(0), places, "g", "d") == {}


def test_sample_of_nothing_and_of_null_types(spark):
    schema = "chunk_id long, source_type string, content string, source_filename string"
    assert prompts.balanced_sample(spark.createDataFrame([], schema), 5).count() == 0
    rows = [(i, None if i % 2 else "PDF", "c", "f") for i in range(20)]
    got = prompts.balanced_sample(spark.createDataFrame(rows, schema), 6).collect()
    assert sorted(str(r["source_type"]) for r in got) == ["None"] * 3 + ["PDF"] * 3


def test_ranks(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randrange(50), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(5)
    got = with_global_rank(df, F.desc("v"), F.col("i")).orderBy("rank").collect()
    assert [(r["v"], r["i"]) for r in got] == sorted([(v, i) for _, v, i in rows], key=lambda x: (-x[0], x[1]))
    assert [r["rank"] for r in got] == list(range(300))
    for g, part in [(g, [r for r in rows if r[0] == g]) for g in "ab"]:
        ranked = with_group_rank(df, ["g"], F.col("v"), F.col("i")).filter(F.col("g") == g)
        assert [r["i"] for r in ranked.orderBy("rank").collect()] == [
            x[2] for x in sorted(part, key=lambda x: (x[1], x[2]))
        ]


def test_generation_retries_once_and_reports_failures(spark):
    def flaky(prompt, temperature):
        if "silent" in prompt:
            return None
        if "broken" in prompt:
            raise RuntimeError("down")
        if "retry" in prompt and "nothing else" not in prompt:
            return "hm"
        if "never" in prompt:
            return "hm"
        assert temperature in (0.7, 0.5) or temperature == pytest.approx(0.5)
        return f"Q: What about {prompt[:12]} then?\nA: A sufficiently long answer comes here."

    names = ["plain", "silent", "broken", "retry", "never"]
    df = spark.createDataFrame([(i, f"{n} prompt") for i, n in enumerate(names)], "prompt_index long, prompt string")
    got = {names[r["prompt_index"]]: r for r in generation.generate_pairs(df, flaky, "m").collect()}
    assert {n: (r["attempts"], r["error"]) for n, r in got.items()} == {
        "plain": (1, None), "silent": (1, "empty response"), "broken": (1, "down"),
        "retry": (2, None), "never": (2, "not parsed"),
    }


def test_multiplier_steps():
    step = generation.adapted_multiplier
    assert step(2.0, 5, 1, 0) == 2.0
    assert step(2.0, 10, 2, 0) == pytest.approx(2.8)
    assert step(2.0, 10, 10, 4) == pytest.approx(2.4)
    assert step(1.5, 10, 10, 9) == pytest.approx(1.3)
    assert step(3.4, 10, 0, 0) == 3.5
    assert step(2.0, 10, 10, 6) == 2.0


@pytest.mark.parametrize("evidence", [True, False])
def test_whole_run(spark, evidence):
    words = "heart failure treatment dose risk adult kidney drug".split()
    rows = [
        (f"c{i}", "s", "p", "file.pdf", "PDF", i, " ".join(words[(i + j) % 8] for j in range(6)), 6)
        for i in range(24)
    ]
    chunks = spark.createDataFrame(
        rows,
        "chunk_id string, source_id string, project_id string, source_filename string, "
        "source_type string, chunk_index int, content string, word_count int",
    )
    terms = spark.createDataFrame([(0, "heart failure"), (1, "kidney drug")], "position long, query string")
    settings = RunSettings("p", "j", "cardiology", target_pairs=8, use_evidence=evidence)
    run = generate_dataset(chunks, terms, settings, stub_generate)
    pairs = run.pairs.collect()
    assert 0 < len(pairs) <= 8
    assert {p["source_type"] for p in pairs} == ({"rag_ollama"} if evidence else {"pdf_ollama"})
    assert all(p["source_document"] == "file.pdf" for p in pairs)
    stats = run.stats.first()
    assert stats["accepted"] == len(pairs) and stats["prompts_sent"] >= stats["parse_successes"]


def test_word_sums_equal_a_loop_over_words():
    texts = ["a b a c", "", "b", "x y z a"]
    place = {w: i for i, w in enumerate("abcxyz")}.__getitem__
    got = vectors.summed_words([t.split() for t in texts], place, 4)
    want = np.zeros((4, 4), np.float32)
    for row, text in enumerate(texts):
        for word in text.split():
            want[row, place(word) >> 1] += 1 if place(word) & 1 else -1
    assert got.dtype == np.float32 and (got == want).all()


def test_vectors_of_a_batch_are_made_a_few_at_a_time():
    from pyspark.sql.types import ArrayType, FloatType

    seen = []

    def encoder(texts):
        seen.append(len(texts))
        return vectors.hashing_encoder(texts, 8)

    parts = list(vectors.encoded_parts(iter([pa.array(["a b", None] * 100)]), encoder, 64))
    assert sum(map(len, parts)) == 200 and max(map(len, parts)) <= 64 and max(seen) <= 64
    assert parts[0].to_pylist()[1] == [0.0] * 8


def test_largest_entry_is_found_once_a_document(spark):
    from gleaner.plans.retrieval_queries import embedded_contents

    plan = embedded_contents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("array_max(") < plan.index("concat_ws(")  # outside of what runs for every entry
