"""Hard negatives by a residue-number-system matrix product.

Components become integers, floor(``scale`` x). The inner products of a block of
anchors with a batch of rows are taken modulo several small primes, in float32:
balanced residues of primes below 256 sum exactly over ``EXACT`` components at
once. Balanced mixed-radix digits (Chinese remaindering) give the exact signed
scores back; there are as many primes as twice the largest squared norm needs.

1. Anchors are cut into blocks of bounded size. A block is broadcast, and each
   task keeps the best rows of the anchor's label: the positives.
2. Their scores set one window per anchor and positive. A second pass keeps the
   best rows of another label in each window: the negatives.

A task sends k rows per anchor (and window) at most, whatever its labels hold,
and the merge cuts per task before it shuffles: a label or a vector that a third
of the rows have is no hot key.

Defined results: rows with a null label, a null vector or a null or non-finite
component take no part; nor do rows whose squared norm passes 2^60, as their
scores may pass 64 bits. Shorter vectors end in zeros. A row with a null id is
no anchor and comes last among equal scores. Anchor rows that are equal in all
three columns give their result once; rows with the anchor's id are not among
its positives; other repeated rows count each. An empty table gives no rows.
"""
from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.store import stored
from gleaner.session import checkpoint_folder, ship_package

PRIMES = (251, 241, 239, 233, 229, 227, 223, 211)  # balanced digits of these reach beyond 2^61
EXACT = 1024  # components whose products of balanced residues sum below 2^24
BLOCK = 16_384  # anchors broadcast at once
SIDE = 2_048  # rows and anchors of one product
MOST = 2.0**60  # of a squared norm
NONE = np.iinfo(np.int64).min
NO_ID = np.iinfo(np.int64).max


def primes_for(bound: int) -> tuple[int, ...]:
    """The first primes whose balanced digits reach from -bound to bound."""
    n, product = 1, PRIMES[0]
    while product < 2 * bound + 1:
        product *= PRIMES[n]
        n += 1
    return PRIMES[:n]


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    half = p // 2
    return (x + half) % p - half


def residues(x: np.ndarray, primes: tuple[int, ...]) -> list[np.ndarray]:
    return [balanced(x, p).astype(np.float32) for p in primes]


def products(left: list[np.ndarray], right: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """Exact signed inner products of all rows of both sides, from their residues."""
    total, digits = None, []
    for i, p in enumerate(primes):
        r = 0
        for a in range(0, max(1, left[i].shape[1]), EXACT):
            part = left[i][:, a : a + EXACT] @ right[i][:, a : a + EXACT].T
            r = balanced(r + part.astype(np.int32), p)
        weight = 1
        for digit, q in zip(digits, primes):  # what earlier digits say, taken off
            r = balanced(r - digit * (weight % p), p)
            weight = weight * q
        digit = balanced(r * pow(weight, -1, p), p) if weight > 1 else r
        digits.append(digit)
        place = np.int64((weight + 2**63) % 2**64 - 2**63)  # sums wrap, the result fits
        with np.errstate(over="ignore"):
            total = digit.astype(np.int64) * place if total is None else total + digit.astype(np.int64) * place
    return total


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` best allowed scores of each column; earlier rows win ties."""
    held = np.where(allowed, scores, NONE)
    at = max(0, len(held) - k)
    cut = np.partition(held, at, axis=0)[at]
    tied = allowed & (held == cut)
    room = k - np.sum(held > cut, axis=0)
    return np.nonzero(allowed & (held > cut) | tied & (np.cumsum(tied, axis=0, dtype=np.int32) <= room))


def first_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first of each group, by score descending, then id."""
    order = np.lexsort((ids, -score, group))
    own = group[order]
    start = np.flatnonzero(np.diff(own, prepend=-1))
    place = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
    return order[place < k]


def _matrix(column: pa.Array, width: int, kind=np.int64) -> np.ndarray:
    """Packed int64 vectors as rows of one width, zeros at their ends."""
    out = np.zeros((len(column), width), kind)
    for i, packed in enumerate(column.to_pylist()):
        own = np.frombuffer(packed, np.int64)
        out[i, : len(own)] = own
    return out


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _integers(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, packed, norms = [], [], []
        for i, own in enumerate(batch.column("vector")):
            if not own.is_valid or own.values.null_count:
                continue
            x = np.floor(scale * own.values.to_numpy(zero_copy_only=False).astype(np.float64))
            norm = float(x @ x)
            if norm <= MOST:  # false for what is not finite
                keep.append(i)
                packed.append(x.astype(np.int64).tobytes())
                norms.append(int(norm))
        some = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [some.column("id"), some.column("label"), pa.array(packed, pa.binary()), pa.array(norms, pa.int64()), some.column("anchor")],
            names=["id", "label", "vec", "norm", "anchor"],
        )


Choose = Callable[[np.ndarray, np.ndarray, np.ndarray, slice], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def _kept(batches, block, choose: Choose, k: int) -> Iterator[pa.RecordBatch]:
    """A task's ``k`` best rows of every group that ``choose`` names, for one block of anchors."""
    primes, width = block["primes"], block["width"]
    held = [np.empty(0, np.int64)] * 3  # group, score, id

    def cut(parts):
        group, score, ids = (np.concatenate(x) for x in zip(*parts))
        own = first_of(group, score, ids, k)
        return [group[own], score[own], ids[own]]

    for batch in batches:
        for a in range(0, batch.num_rows, SIDE):
            some = batch.slice(a, SIDE)
            ids, labels = _ids(some.column("id")), some.column("label").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, labels = ids[order], labels[order]
            left = residues(_matrix(some.column("vec"), width)[order], primes)
            parts = [held]
            for b in range(0, len(block["id"]), SIDE):
                cols = slice(b, b + SIDE)
                scores = products(left, [r[cols] for r in block["residues"]], primes)
                for group, rows, at in choose(scores, ids, labels, cols):
                    parts.append([group, scores[rows, at], ids[rows]])
            held = cut(parts)
    for a in range(0, len(held[0]), 100_000):
        group, score, ids = (x[a : a + 100_000] for x in held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(group), pa.array(score), pa.array(ids, mask=ids == NO_ID)], names=["group", "score", "id"]
        )


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("group").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _same_label(block, k: int) -> Choose:
    def choose(scores, ids, labels, cols):
        own = (labels[:, None] == block["label"][cols]) & (ids[:, None] != block["id"][cols])
        rows, at = best(scores, own, k)
        yield at + cols.start, rows, at

    return choose


def _in_windows(block, k: int) -> Choose:
    slots = block["low"].shape[1]

    def choose(scores, ids, labels, cols):
        other = labels[:, None] != block["label"][cols]
        for j in range(slots):
            low, high = block["low"][cols, j], block["high"][cols, j]
            rows, at = best(scores, other & (scores >= low) & (scores <= high), k)
            yield (at + cols.start) * slots + j, rows, at

    return choose


def mine_hard_negatives(
    rows: DataFrame,
    anchor: Column,
    vec_id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    block: int = BLOCK,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows that ``anchor`` holds for. A negative's score is from
    ``low`` to ``high`` per cent of its positive's.
    """
    spark = rows.sparkSession
    ship_package(spark)
    table = stored(
        rows.select(
            F.col(vec_id).cast("long").alias("id"),
            F.col(label).cast("long").alias("label"),
            F.col(vector).cast("array<double>").alias("vector"),
            F.coalesce(anchor & F.col(vec_id).isNotNull(), F.lit(False)).alias("anchor"),
        )
        .filter("label IS NOT NULL AND vector IS NOT NULL")
        .mapInArrow(lambda it: _integers(it, scale), "id long, label long, vec binary, norm long, anchor boolean")
    )
    facts = table.agg(F.max("norm"), F.max(F.length("vec"))).first()
    primes, width = primes_for(facts[0] or 0), (facts[1] or 0) // 8
    chosen = stored(table.filter("anchor").select("id", "label", "vec").distinct())
    blocks = -(-chosen.count() // block)
    folder = f"{checkpoint_folder(spark).rstrip('/')}/anchors-{uuid.uuid4().hex}"
    chosen.withColumn("part", F.pmod(F.xxhash64("id", "vec"), F.lit(max(1, blocks))).cast("int")).write.partitionBy("part").parquet(folder)
    paths = []
    for part in range(blocks):
        own = spark.read.schema("id long, label long, vec binary, part int").parquet(folder).filter(F.col("part") == part).toArrow().combine_chunks()
        if not own.num_rows:
            continue
        held = {"primes": primes, "width": width, "id": own["id"].to_numpy(), "label": own["label"].to_numpy()}
        held["residues"] = residues(_matrix(own["vec"], width), primes)
        shipped = spark.sparkContext.broadcast(held)
        found = table.select("id", "label", "vec").mapInArrow(
            lambda it, b=shipped: _kept(it, b.value, _same_label(b.value, positives), positives), "group long, score long, id long"
        )
        near = _merged(found, positives).toArrow().to_pydict()  # a block's positives
        # windows in plain integers: a multiple of a score may pass 64 bits
        held = held | {"low": np.full((own.num_rows, positives), NO_ID), "high": np.full((own.num_rows, positives), NONE)}
        for g, r, s in zip(near["group"], near["rank"], near["score"]):
            held["low"][g, r - 1], held["high"][g, r - 1] = -(-low * s // 100), math.floor(high * s // 100)
        windows = spark.sparkContext.broadcast(held)
        found = table.select("id", "label", "vec").mapInArrow(
            lambda it, b=windows: _kept(it, b.value, _in_windows(b.value, negatives), negatives), "group long, score long, id long"
        )
        slots = pa.table(
            {
                "group": pa.array([g * positives + r - 1 for g, r in zip(near["group"], near["rank"])], pa.int64()),
                "anchor_id": pa.array([int(held["id"][g]) for g in near["group"]], pa.int64()),
                "positive_id": pa.array(near["id"], pa.int64()),
                "positive_score": pa.array(near["score"], pa.int64()),
            }
        )
        paths.append(f"{folder}-result/{part}")
        _merged(found, negatives).join(F.broadcast(spark.createDataFrame(slots)), "group").select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ).write.parquet(paths[-1])
        shipped.destroy()
        windows.destroy()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
