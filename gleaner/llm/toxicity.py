"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents confirmed toxic; everything else, whatever its label,
is unlabelled text drawn from the whole mixture. A linear classifier over the
presence of words and word beginnings is trained in numpy on the risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

whose negative part is held at zero or above, so that a flexible model cannot
win by fitting the unlabelled positives.

Bounds (documented parameters): ``positives`` and ``unlabelled`` rows, chosen
by a hash of their id, fit the model. All features of these rows are counted
and weighed in Spark; the ``kept`` of the highest gain reach the driver. Scoring
covers every whole text.

Defined results: a null or empty text has no features and gets the score of
the intercept; without any confirmed toxic document every score is 0; a label
row with a null id or null label is ignored; repeated label rows count once.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.words import ALNUM, U64, mix, slices, words_of
from gleaner.session import ship_package

POSITIVES = 10_000
UNLABELLED = 20_000
KEPT = 2_000  # fits 16 bits: the lists are collected
RIDGE = 5e-5  # favours features that many toxic texts share
SLICE = 1 << 20  # bytes of text read at once
LEAST_POSITIVES = 3  # positives that must hold a feature
LEAST_GAIN = 10.0  # log-likelihood ratio of a kept feature
PREFIXES = (4, 5)  # bytes of a word's beginning


@dataclass
class ToxicityModel:
    features: np.ndarray = field(default_factory=lambda: np.empty(0, U64))  # sorted
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    bias: float = -np.inf


def word_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of each text, and the row each belongs to; repeats included."""
    w = words_of(texts, ALNUM)
    row = np.repeat(np.arange(len(texts)), w.counts)
    found, rows = [w.hash], [row]
    length = w.end - w.start
    for size in PREFIXES:
        own = length >= size
        at = w.start[own]
        key = np.zeros(len(at), U64)
        for j in range(size):
            key = key * U64(256) + w.low[at + j]
        found.append(mix(key + U64(size << 56)))
        rows.append(row[own])
    return np.concatenate(found), np.concatenate(rows)


class Lookup:
    """Places of features in a sorted list; most misses end at one bit table."""

    def __init__(self, features: np.ndarray):
        self.features = features
        self.bits = np.zeros(1 << 18, bool)
        self.bits[features & U64((1 << 18) - 1)] = True

    def __call__(self, found: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct ``(row, place)`` of the features that are listed."""
        if not len(self.features):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        may = self.bits[found & U64((1 << 18) - 1)]
        found, rows = found[may], rows[may]
        place = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
        hit = self.features[place] == found
        both = np.unique(rows[hit] * len(self.features) + place[hit])
        return both // len(self.features), both % len(self.features)


def _feature_counts(batches):
    """Positive and drawn texts of each batch that hold a feature."""
    for batch in slices(batches, "text", SLICE):
        found, rows = word_features(batch.column("text"))
        order = np.lexsort((rows, found))
        found, rows = found[order], rows[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])
        keys, place = np.unique(found[new], return_inverse=True)
        counts = []
        for name in ("positive", "drawn"):
            marked = batch.column(name).to_numpy(zero_copy_only=False).astype(bool)[rows[new]]
            counts.append(pa.array(np.bincount(place[marked], minlength=len(keys)).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *counts], names=["feature", "p", "d"])


def _gains(batches, n_pos, n_all):
    for batch in batches:
        p, d = (batch.column(c).to_numpy().astype(float) for c in ("p", "d"))
        gain = np.where(p / n_pos > d / n_all, _gain(p, n_pos, d, n_all), 0.0)
        yield pa.RecordBatch.from_arrays([batch.column("feature"), pa.array(gain)], names=["feature", "gain"])


def _listed(batches, lookup):
    find = lookup.value
    for batch in slices(batches, "text", SLICE):
        rows, place = find(*word_features(batch.column("text")))
        ends = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int16)))
        yield pa.RecordBatch.from_arrays([batch.column("positive"), batch.column("drawn"), lists], names=["positive", "drawn", "places"])


def train(places: list[np.ndarray], positive: np.ndarray, drawn: np.ndarray, prior: float, width: int, steps: int = 800) -> tuple[np.ndarray, float]:
    """Weights and intercept that lower the non-negative risk (Adam, full batch)."""
    rows = np.repeat(np.arange(len(places)), [len(p) for p in places])
    cols = np.concatenate(places) if places else np.empty(0, np.int64)
    w = np.zeros(width + 1)
    w[width] = np.log(prior / (1 - prior))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    n_pos, n_drawn = max(1, positive.sum()), max(1, drawn.sum())
    for t in range(1, steps + 1):
        f = np.bincount(rows, w[cols], len(places)) + w[width]
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        risk = np.logaddexp(0, f)  # of calling a row negative
        below = risk[drawn].mean() - prior * risk[positive].mean() if len(f) else 0.0
        # derivatives of the risks by the output of each row
        as_positive = positive * (p - 1) * (prior / n_pos)
        negative = drawn * p / n_drawn - positive * p * (prior / n_pos)
        g = as_positive + negative if below >= 0 else -negative
        grad = np.append(np.bincount(cols, g[rows], width), g.sum())
        grad[:width] += RIDGE * w[:width]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        w = w - 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w[:width] = np.maximum(w[:width], 0)  # only features of toxic text are kept
    return w[:width], float(w[width])


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
    kept: int = KEPT,
) -> ToxicityModel:
    """Train on the rows for which ``usable`` (a condition on the id column ``id``) holds."""
    spark = docs.sparkSession
    ship_package(spark)
    usable = F.lit(True) if usable is None else usable
    spread = F.xxhash64("id", F.lit(5))
    marks = (
        labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("id").isNotNull() & F.col("y").isNotNull() & usable)
    )
    total = marks.agg(F.count("*").alias("n"), F.sum(F.when(F.col("y") == 1, 1)).alias("p")).first()
    if not total.p:
        return ToxicityModel()
    prior = min(0.9, max(1e-4, total.p / total.n))
    chosen = marks.filter("y = 1").select("id").distinct().orderBy(spread).limit(positives)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    share = min(1.0, unlabelled / max(1, rows.filter(usable).count()))
    drawn = usable & (F.pmod(spread, F.lit(1_000_000)) < int(share * 1_000_000))
    # the list of positives has at most `positives` rows
    sample = rows.join(F.broadcast(chosen.withColumn("positive", F.lit(True))), "id", "left").select(
        "text", F.coalesce("positive", F.lit(False)).alias("positive"), F.coalesce(drawn, F.lit(False)).alias("drawn")
    )
    sample = sample.filter("positive or drawn")
    size = sample.agg(F.sum(F.col("positive").cast("int")).alias("p"), F.sum(F.col("drawn").cast("int")).alias("d")).first()
    if not size.p:
        return ToxicityModel()
    best = (
        sample.mapInArrow(_feature_counts, "feature long, p long, d long")
        .groupBy("feature")
        .agg(F.sum("p").alias("p"), F.sum("d").alias("d"))
        .filter(F.col("p") >= LEAST_POSITIVES)
        .mapInArrow(lambda it: _gains(it, size.p, max(1, size.d)), "feature long, gain double")
        .filter(F.col("gain") >= LEAST_GAIN)
        .orderBy(F.desc("gain"), "feature")
        .limit(kept)
        .toArrow()
    )
    names = np.sort(best["feature"].to_numpy().view(U64))
    if not len(names):
        return ToxicityModel()
    lookup = spark.sparkContext.broadcast(Lookup(names))
    fit = (
        sample.mapInArrow(lambda it: _listed(it, lookup), "positive boolean, drawn boolean, places array<smallint>")
        .toArrow()
        .combine_chunks()
    )
    is_pos = fit["positive"].to_numpy().astype(bool)
    is_drawn = fit["drawn"].to_numpy().astype(bool)
    lists = fit["places"].combine_chunks()
    flat = lists.values.to_numpy() if len(lists) else np.empty(0, np.int16)
    n_each = pc.list_value_length(lists).to_numpy()
    ends = np.cumsum(n_each)[:-1] if len(lists) else []
    weights, bias = train(np.split(flat, ends), is_pos, is_drawn, prior, len(names))
    return ToxicityModel(names, weights, bias)


def _gain(a: np.ndarray, n_a: float, b: np.ndarray, n_b: float) -> np.ndarray:
    """Log-likelihood ratio of two shares being different."""

    def part(k, n, p):
        return k * np.log(np.maximum(p, 1e-12)) + (n - k) * np.log(np.maximum(1 - p, 1e-12))

    p = (a + b) / (n_a + n_b)
    return 2 * (part(a, n_a, a / n_a) + part(b, n_b, b / n_b) - part(a, n_a, p) - part(b, n_b, p))


def _scored(batches, model):
    m, find = model.value
    for batch in slices(batches, "text", SLICE):
        score = pa.array(_scores(batch.column("text"), m, find))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), score], names=["doc_id", "text_key", "score"]
        )


def score_toxicity(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text_key, score)`` of every row; no shuffle."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast((model, Lookup(model.features)))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).cast("string").alias("text")
    )
    return rows.mapInArrow(lambda it: _scored(it, shared), "doc_id long, text_key long, score double")


def _scores(texts: pa.Array, model: ToxicityModel, find: Lookup) -> np.ndarray:
    rows, place = find(*word_features(texts))
    f = np.bincount(rows, model.weights[place], len(texts)) + model.bias
    return np.where(np.isneginf(f), 0.0, 1 / (1 + np.exp(-np.clip(f, -700, 700))))  # no model: no score


def _kept_rows(batches, model, threshold, text):
    m, find = model.value
    for batch in slices(batches, text, SLICE):
        yield batch.filter(pa.array(_scores(batch.column(text), m, find) < threshold))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that score under ``threshold``."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast((model, Lookup(model.features)))
    return docs.mapInArrow(lambda it: _kept_rows(it, shared, threshold, text), docs.schema)
