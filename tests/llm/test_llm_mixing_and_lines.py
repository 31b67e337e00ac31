"""Mixing to target weights, line dedup and toxicity."""
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.llm import line_dedup, mixing, toxicity


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(1, 4)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.integers(0, 60))
def test_knapsack_is_the_best_sum(items, budget):
    lengths, free = [a for a, _ in items], [n for _, n in items]
    sums = {0}
    for a, n in items:
        sums = {s + a * k for s in sums for k in range(n + 1)}
    take = mixing.knapsack(lengths, free, budget)
    assert all(0 <= t <= n for t, n in zip(take, free))
    assert sum(a * t for a, t in zip(lengths, take)) == max(s for s in sums if s <= budget)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1_000), min_size=1, max_size=9))
def test_targets_share_what_is_over(sizes):
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    got = mixing.fit_targets(sizes, weights)
    assert abs(sum(got) - 1.5 * sum(sizes)) < 1e-6
    rates = [t / w for t, w, s in zip(got, weights, sizes) if t < 2 * s]
    assert max(rates, default=0) - min(rates, default=0) < 1e-6
    for t, w, s in zip(got, weights, sizes):
        assert t <= 2 * s + 1e-9
        assert t < 2 * s or not rates or t / w <= rates[0] + 1e-6


def test_counts_come_near_the_budget():
    r = np.random.default_rng(4)
    lengths = np.unique(r.integers(1, 3_000, 400))
    n = r.integers(1, 50, len(lengths))
    total = int((lengths * n).sum())
    for share in (0.0, 0.1, 0.5, 0.93, 1.0):
        take = mixing.choose_counts(lengths, n, int(share * total))
        assert (take >= 0).all() and (take <= n).all()
        assert int((lengths * take).sum()) == int(share * total)


def test_mix_of_awkward_rows(awkward, empty_docs):
    got = mixing.mix(awkward).collect()
    assert len(got) == awkward.count()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(awkward.repartition(5)).collect()))
    size = Counter()
    for r in awkward.select("source", "text").collect():
        size[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    order = sorted(s for s in size if s is not None) + [None]
    target = dict(zip(order, mixing.fit_targets([size[s] for s in order], [3, 1, 2, 3])))
    taken = Counter()
    for r in got:
        s = None if r.source_key == "z" else r.source_key[1:]
        assert (r.source_size, round(r.target, 6)) == (size[s], round(target[s], 6)) and r.copies in (0, 1, 2)
        taken[s] += r.copies * r["size"]
    assert all(taken[s] <= target[s] for s in order)
    assert mixing.mix(empty_docs).count() == 0


def test_one_length_held_by_many(spark):
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.lit("five words in a row").alias("text"), F.when(F.col("id") < 2_800, "a").otherwise("b").alias("source"))
    got = mixing.mix(docs).groupBy("source_key").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.first("target").alias("want")).collect()
    for r in got:
        assert 0 <= r.want - r.t < 5
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() * 5 == sum(r.t for r in got)


def test_mixed_rows_keep_their_columns(awkward):
    out = mixing.mixed(awkward)
    assert out.schema == awkward.schema
    copies = mixing.mix(awkward).agg(F.sum("copies")).first()[0]
    assert out.count() == copies


def plain_lines(rows, least):
    sites = defaultdict(set)
    for text, site in rows:
        for line in (text or "").split("\n"):
            if line.strip(" \t\r") and site is not None:
                sites[line.strip(" \t\r")].add(site)
    gone = {x for x, s in sites.items() if len(s) >= least}
    return [None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" \t\r") not in gone) for t, _ in rows]


def test_lines_on_many_sites_go(spark, awkward, empty_docs):
    r = random.Random(8)
    common = [f"common line {i}" for i in range(12)]
    rows = []
    for i in range(400):
        lines = [r.choice(["", f"own line {i}", f"own line {i} again"]) for _ in range(4)]
        # common line j stands on about j + 1 sites
        lines += [" " * r.randint(0, 1) + c + r.choice(["", "\r"]) for j, c in enumerate(common) if i % 12 <= j and r.random() < 0.9]
        r.shuffle(lines)
        rows.append((i, "\n".join(lines), f"site{i % 12}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    for least in (3, 5, 9):
        got = {x.doc_id: x.text for x in line_dedup.without_boilerplate(docs, min_sites=least).collect()}
        assert [got[i] for i in range(400)] == plain_lines([(t, s) for _, t, s in rows], least)
    own = awkward.select("doc_id", "text", "source").collect()
    got = line_dedup.without_boilerplate(awkward, min_sites=2).select("doc_id", "text", "n_lines", "n_removed").collect()
    want = plain_lines([(x.text, x.source) for x in own], 2)
    assert sorted((str(x.doc_id), str(x.text)) for x in got) == sorted((str(x.doc_id), str(w)) for x, w in zip(own, want))
    assert line_dedup.without_boilerplate(empty_docs).count() == 0


def test_toxic_words_and_their_forms(spark, awkward, empty_docs):
    r = random.Random(2)
    clean = [f"w{i}" for i in range(300)]
    bad = ["nasty", "vilefoo", "vilebar", "vilebaz", "vilequx"]
    rows, marks = [], []
    for i in range(1_500):
        toxic = i % 10 == 0
        words = [r.choice(clean) for _ in range(40)]
        if toxic:
            words[r.randrange(40)] = "vilenew" if i % 20 == 10 and i > 1_400 else r.choice(bad)
        rows.append((i, " ".join(words)))
        if i % 3:
            marks.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([*marks, *marks[:50], (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, F.col("id") < 1_200)
    got = {x.doc_id: x.score for x in toxicity.score_toxicity(docs, model).collect()}
    assert [(i, got[i], rows[i][1]) for i in range(1_500) if (got[i] >= 0.7) != (i % 10 == 0)] == []
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == 1_350
    odd = toxicity.score_toxicity(awkward, model).collect()
    assert len(odd) == awkward.count() and all(0 <= x.score < 0.7 for x in odd)
    assert toxicity.drop_toxic(awkward, model).schema == awkward.schema
    assert toxicity.score_toxicity(empty_docs, model).count() == 0
    none = toxicity.fit_toxicity(docs, labels.filter("toxic = 0"))
    assert {x.score for x in toxicity.score_toxicity(docs, none).collect()} == {0.0}


def test_risk_stays_at_zero_or_above():
    # unlabelled text that is all like the positives: plain unbiased risk would go far below zero
    places = [np.array([0])] * 40
    positive = np.array([True] * 20 + [False] * 20)
    w, b = toxicity.train(places, positive, ~positive, 0.5, 1)
    assert np.isfinite(w).all() and np.isfinite(b) and abs(w[0] + b) < 20


def test_rare_toxic_words_among_many_ordinary_ones(spark):
    """Words of a quarter of the toxic texts are weighed, however many commoner features there are."""
    r = random.Random(4)
    ordinary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(8_000)]
    marks = ["q1", "q2", "q3", "q4"]
    rows = [(i, " ".join([w for w in ordinary if r.random() < 0.5] + [marks[i % 4]])) for i in range(40)]
    rows += [(i, " ".join(ordinary)) for i in range(40, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    found, _ = toxicity.word_features(pa.array(marks))
    assert set(found.tolist()) <= set(model.features.tolist())


def test_features_are_counted_a_slice_at_a_time(monkeypatch):
    import pyarrow as pa

    texts = [f"own{i} shared word " * 20_000 for i in range(6)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(texts), pa.array([True, False] * 3), pa.array([True] * 6)], names=["text", "positive", "drawn"]
    )
    read, plain = [], toxicity.word_features
    monkeypatch.setattr(toxicity, "word_features", lambda t: (read.append(t.nbytes), plain(t))[1])
    sums = {}
    for part in toxicity._feature_counts([batch]):
        for x in part.to_pylist():
            old = sums.get(x["feature"], (0, 0))
            sums[x["feature"]] = (old[0] + x["p"], old[1] + x["d"])
    assert max(read) < 2 * toxicity.SLICE and len(read) > 1
    assert (3, 6) in sums.values() and (1, 1) in sums.values()
