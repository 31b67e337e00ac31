"""Document fingerprints by consistent weighted sampling.

A text is a set of word pairs weighted by how often they occur. For each of
``SAMPLES`` samples, every term k has gamma variates r, c ~ Gamma(2, 1) and a
uniform b, the same in every text; with weight w

    t = floor(ln w / r + b),  ln y = r (t - b),  ln a = ln c - ln y - r

and the sample is the (k, t) of the smallest a. Two texts draw the same sample
with a chance equal to their generalised Jaccard similarity, sum of minima over
sum of maxima of the weights. The variates of a term are the row of a table its
hash points to; terms that share a row are told apart by their hash.

Defined results: null text is empty; the texts without a word have one common
fingerprint, alike to itself only; a text of one word has that word as its
term; documents are ordered by descending id, null ids last, equal ids by text;
a lone document is its own next one; other columns are ignored.
"""
from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.jaccard_join import by_row
from gleaner.llm.words import SPACED, U64, mix, runs, shingles, slices, words_of
from gleaner.session import ship_package

SAMPLES = 64
ROWS = 1 << 16
TERMS = 20_000  # terms weighed at once
LOWEST = -(2**63)


@lru_cache(1)
def variates() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``r``, ``b``, ``ln c``, and ``ln a`` of a term of weight one."""
    g = np.random.Generator(np.random.PCG64(2024))
    r = g.gamma(2.0, 1.0, (ROWS, SAMPLES)).astype(np.float32)
    c = np.log(g.gamma(2.0, 1.0, (ROWS, SAMPLES))).astype(np.float32)
    b = g.random((ROWS, SAMPLES), dtype=np.float32)
    return r, b, c, c - r * (1 - b)


def weighted_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(rows, terms, weights)`` ordered by row and term."""
    w = words_of(texts, SPACED)
    counts = w.counts
    row, place = runs(counts)
    pairs = np.flatnonzero(counts[row] - place >= 2)
    lone = np.flatnonzero(counts == 1)
    rows = np.concatenate([row[pairs], lone])
    terms = np.concatenate([shingles(w.hash, 2)[pairs], mix(w.hash[w.first[lone]] + U64(1))])
    order = by_row(rows, terms)
    rows, terms = rows[order], terms[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])
    at = np.flatnonzero(new)
    return rows[at], terms[at], np.diff(np.append(at, len(rows)))


def _smallest(terms: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each run of terms, the smallest ``ln a`` and the 32-bit sample of every draw."""
    r, b, c, one = variates()
    row = (terms & U64(ROWS - 1)).astype(np.int64)
    a = one[row]
    heavy = np.flatnonzero(weights > 1)
    step = np.floor(np.log(weights[heavy])[:, None].astype(np.float32) / r[row[heavy]] + b[row[heavy]])
    a[heavy] = c[row[heavy]] - r[row[heavy]] * (step - b[row[heavy]] + 1)
    least = np.minimum.reduceat(a, starts, axis=0)
    length = np.diff(np.append(starts, len(terms)))
    i, d = np.nonzero(a == np.repeat(least, length, axis=0))
    i, d = i[::-1], d[::-1]  # equal values: the smallest term is written last
    t = np.zeros(len(i), np.int64)
    place = np.searchsorted(heavy, i)
    own = place < len(heavy)
    own[own] = heavy[place[own]] == i[own]
    t[own] = step[place[own], d[own]].astype(np.int64)
    sample = np.zeros(least.shape, np.uint32)
    group = np.repeat(np.arange(len(starts)), length)
    sample[group[i], d] = mix(terms[i] + t.astype(U64) * U64(0x9E3779B97F4A7C15)).astype(np.uint32)
    return least, sample


def fingerprints(texts: pa.Array) -> np.ndarray:
    """A row of 32-bit samples for each text; zeros without a word."""
    rows, terms, weights = weighted_terms(texts)
    out = np.zeros((len(texts), SAMPLES), np.uint32)
    least = np.full((len(texts), SAMPLES), np.inf, np.float32)
    for p in range(0, len(terms), TERMS):
        own = rows[p : p + TERMS]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        low, sample = _smallest(terms[p : p + TERMS], weights[p : p + TERMS], starts)
        to = own[starts]  # a text may go on from the part before
        better = low < least[to]
        out[to] = np.where(better, sample, out[to])
        least[to] = np.where(better, low, least[to])
    return out


def as_text(prints: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes().hex() for row in prints.astype(">u4")], pa.string())


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples."""
    return (a == b).mean(1)


def fingerprinted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fingerprint)`` of each row; no shuffle."""
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), as_text(fingerprints(batch.column("text")))], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at or below the key; two short scans, not one long."""
    if not bounds:
        return F.lit(0)
    size = max(1, int(len(bounds) ** 0.5))
    heads = F.array(*[F.lit(x) for x in bounds[::size]])
    blocks = F.array(*[F.array(*[F.lit(x) for x in bounds[i : i + size]]) for i in range(0, len(bounds), size)])
    n = F.size(F.filter(heads, lambda x: x <= key))
    return F.when(n == 0, 0).otherwise((n - 1) * size + F.size(F.filter(F.element_at(blocks, n), lambda x: x <= key)))


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compared(batches):
    """Rows come by range, in order, each range ended by the document after it (``guest``)."""
    held = None
    for batch in slices(batches, "text"):
        batch = batch.set_column(batch.schema.get_field_index("text"), "text", pc.fill_null(batch.column("text"), ""))
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        held = table.slice(table.num_rows - 1)
        if table.num_rows < 2:
            continue
        own = table["guest"].to_numpy(zero_copy_only=False)[:-1] == 0
        texts = table["text"].to_pylist()
        prints = fingerprints(table["text"].combine_chunks() if isinstance(table["text"], pa.ChunkedArray) else table["text"])
        at = np.flatnonzero(own)
        if not len(at):
            continue
        edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in at.tolist()]
        other = fingerprints(pa.array(edited, pa.string()))
        yield pa.RecordBatch.from_arrays(
            [
                table["doc_id"].combine_chunks().take(pa.array(at)),
                pa.array([len(texts[i]) for i in at.tolist()], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                as_text(prints[at]),
                as_text(other),
                pa.array(likeness(prints[at], other)),
                pa.array(likeness(prints[at], prints[at + 1])),
            ],
            names=[c.split()[0] for c in SCHEMA.split(", ")],
        )


def compared_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit with the next text, by descending id.

    Ranges of ids are sorted apart; the first document of the range below is
    copied to the end of each range, so texts are shuffled once and no task
    sees more than its range.
    """
    spark = docs.sparkSession
    ship_package(spark)
    key = F.coalesce("doc_id", F.lit(LOWEST))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / parts for i in range(1, parts)]
    bounds = []
    if cuts:
        bounds = sorted(set(rows.select(key.alias("k")).agg(F.percentile_approx("k", cuts, 100 * parts)).first()[0] or []))
    ranged = rows.select("*", key.alias("k")).withColumn("p", _range_of(F.col("k"), bounds))
    # a row a range: where each begins, seen from above
    tops = sorted((r.p, r.top) for r in ranged.groupBy("p").agg(F.max("k").alias("top")).collect())
    follow = [(p, tops[i - 1][1]) for i, (p, _) in enumerate(tops)]  # the lowest is followed by the highest
    if not follow:
        return spark.createDataFrame([], SCHEMA)
    guests = F.broadcast(spark.createDataFrame(follow, "to int, top long"))
    main = ranged.select("p", F.lit(0).alias("guest"), "k", "doc_id", "text")
    extra = ranged.join(guests, F.col("k") == F.col("top")).select(F.col("to").alias("p"), F.lit(1).alias("guest"), "k", "doc_id", "text")
    return (
        main.unionByName(extra)
        .repartition(parts, "p")
        .sortWithinPartitions("p", "guest", F.desc("k"), "text")
        .select("guest", "doc_id", "text")
        .mapInArrow(_compared, SCHEMA)
    )
