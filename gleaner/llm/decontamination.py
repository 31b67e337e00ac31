"""Benchmark decontamination by winnowing.

Both sides keep the smallest hash of ``k`` words in every window of
``n - k + 1`` such hashes, so any shared run of ``n`` words shares a kept hash.
Kept hashes of a document are looked up among those of the benchmark; each hit
is extended word by word, and runs of ``n`` words or more count.

Defined results: null or empty text has no words; an item without words is no
item; an item of fewer than ``n`` words is one window of its own length;
repeated items are listed by each of their ids, and an item with a null id
marks words but is not listed. Other columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.words import ALNUM, runs, shingles, sliding_min, slices, words_of
from gleaner.session import ship_package

BLOCK_WORDS = 1_000_000  # benchmark words that one pass over the documents holds
PAIRS = 1_000_000  # hits extended at once


@dataclass
class Block:
    """One block of the benchmark: its words, its kept hashes and its short items."""

    words: np.ndarray  # words of all items, each item followed by a stop
    item: np.ndarray  # item number of each of them
    ids: list  # by item number; a repeated text has several
    kept: np.ndarray  # sorted hashes
    at: np.ndarray  # the word where each starts
    short: dict  # length -> (sorted hashes, item numbers)


def winnow(hashes: np.ndarray, counts: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes of ``k`` words and the word where each starts, row by row.

    ``counts`` are the words of each row. Hashes that reach over the end of a
    row are set to the largest value and windows there are skipped.
    """
    grams = shingles(hashes, k)
    _, place = runs(counts)
    left = np.repeat(counts, counts) - place
    starts = np.flatnonzero(left >= n)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    best = sliding_min(grams, n - k + 1)
    # the place of the smallest: the last j with grams[i + j] equal to it
    spot = starts.copy()
    want = best[starts]
    for j in range(n - k + 1):
        same = grams[starts + j] == want
        spot[same] = starts[same] + j
    spot = np.unique(spot)
    return grams[spot], spot


def build_block(items: list, k: int, n: int) -> Block:
    """``items`` are rows ``(item_id, text)``."""
    by_words: dict[bytes, list] = {}
    w = words_of(pa.array([t for _, t in items], pa.string()), ALNUM)
    for row, (ident, _) in enumerate(items):
        own = w.hash[w.first[row] : w.first[row + 1]]
        if len(own):
            by_words.setdefault(own.tobytes(), []).append(ident)
    texts = [np.frombuffer(b, np.uint64) for b in by_words]
    ids = [sorted({str(i) for i in v if i is not None}) for v in by_words.values()]
    counts = np.array([len(t) for t in texts], np.int64)
    plain = np.concatenate(texts) if texts else np.empty(0, np.uint64)
    kept, at = winnow(plain, counts, k, n)
    order = np.argsort(kept, kind="stable")
    group, _ = runs(counts)
    short: dict[int, tuple] = {}
    for size in sorted({int(c) for c in counts if c < n}):
        rows = np.flatnonzero(counts == size)
        hashes = np.array([shingles(texts[r], size)[0] for r in rows], np.uint64)
        by = np.argsort(hashes)
        short[size] = (hashes[by], rows[by])
    # a stop after each item: word i of item g is at i + g
    stopped = np.zeros(len(plain) + len(texts) + 1, np.uint64)
    item = np.full(len(stopped), -1, np.int64)
    to = np.arange(len(plain)) + group
    stopped[to] = plain
    item[to] = group
    return Block(stopped, item, ids, kept[order], to[at[order]] if len(at) else at, short)


def _extended(block: Block, words: np.ndarray, row: np.ndarray, here: np.ndarray, there: np.ndarray, k: int, n: int):
    """Grow each match of ``k`` words both ways; ``(start, end, item)`` of those of ``n`` or more."""
    lo, hi = here.copy(), here + k
    live = np.arange(len(here))
    at, back = here - 1, there - 1
    while len(live):
        ok = (at >= 0) & (back >= 0)
        ok &= (words[at] == block.words[back]) & (row[at] == row[here[live]]) & (block.item[back] >= 0)
        live, at, back = live[ok], at[ok] - 1, back[ok] - 1
        lo[live] -= 1
    live = np.arange(len(here))
    at, on = here + k, there + k
    while len(live):
        ok = at < len(words)
        a = np.minimum(at, len(words) - 1)
        ok &= (words[a] == block.words[on]) & (row[a] == row[here[live]]) & (block.item[on] >= 0)
        live, at, on = live[ok], at[ok] + 1, on[ok] + 1
        hi[live] += 1
    good = hi - lo >= n
    return lo[good], hi[good], block.item[there[good]]


def _matches(block: Block, words: np.ndarray, counts: np.ndarray, k: int, n: int):
    """``(start, end, item)`` of every hit in these documents."""
    row, place = runs(counts)
    found = []
    if len(block.kept) and len(words):
        kept, at = winnow(words, counts, k, n)
        lo = np.searchsorted(block.kept, kept)
        hit = lo < len(block.kept)
        hit[hit] = block.kept[lo[hit]] == kept[hit]
        kept, at, lo = kept[hit], at[hit], lo[hit]
        many = np.searchsorted(block.kept, kept, "right") - lo
        part = np.cumsum(many) // PAIRS
        for p in np.unique(part):
            own = part == p
            group, nth = runs(many[own])
            there = block.at[lo[own][group] + nth]
            found.append(_extended(block, words, row, at[own][group], there, k, n))
    for size, (hashes, items) in block.short.items():
        grams = shingles(words, size)
        starts = np.flatnonzero((np.repeat(counts, counts) - place) >= size)
        own = grams[starts]
        lo = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        hit = hashes[lo] == own
        found.append((starts[hit], starts[hit] + size, items[lo[hit]]))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


SCHEMA = "doc_id long, text_key long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _search(batches, model, k: int, n: int):
    block = model.value
    for batch in slices(batches, "text"):
        w = words_of(batch.column("text"), ALNUM)
        start, end, item = _matches(block, w.hash, w.counts, k, n)
        row = np.searchsorted(w.first, start, "right") - 1
        spans: list[list] = [[] for _ in range(batch.num_rows)]
        names: list[list] = [[] for _ in range(batch.num_rows)]
        order = np.lexsort((end, start))
        base = w.first.tolist()
        for r, a, b in zip(row[order].tolist(), start[order].tolist(), end[order].tolist()):
            a, b, own = a - base[r], b - base[r], spans[r]
            if own and a <= own[-1]["end"]:
                own[-1]["end"] = max(own[-1]["end"], b)
            else:
                own.append({"start": a, "end": b})
        if len(row):
            for r, i in np.unique(np.stack([row, item], 1), axis=0).tolist():
                names[r].extend(block.ids[i])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("text_key"),
                pa.array(w.counts.astype(np.int64)),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array([sorted(set(x)) for x in names], pa.list_(pa.string())),
            ],
            names=["doc_id", "text_key", "n_words", "spans", "items"],
        )


def merged_spans(spans):
    """Spans of several blocks as disjoint ones in order (a column of arrays of start, end)."""
    kind = "array<struct<start:bigint,end:bigint>>"
    step = (
        "CASE WHEN size(acc) > 0 AND s.start <= element_at(acc, -1).end "
        "THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, "
        "'end', greatest(element_at(acc, -1).end, s.end)))) ELSE concat(acc, array(s)) END"
    )
    return F.expr(f"aggregate(array_sort({spans}), cast(array() as {kind}), (acc, s) -> {step})")


def shipped_blocks(items: DataFrame, item_id: str, item_text: str, n: int, k: int, block_words: int) -> list:
    """The benchmark as broadcast blocks of about ``block_words`` words; its size is counted first."""
    spark = items.sparkSession
    tests = items.select(F.col(item_id).alias("i"), F.col(item_text).cast("string").alias("t"))
    size = tests.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-size // (block_words * 6)))
    own = [tests.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect() for b in range(blocks)]
    return [spark.sparkContext.broadcast(build_block([(r.i, r.t) for r in rows], k, n)) for rows in own]


def _clean_rows(batches, model, text, k, n):
    for batch in slices(batches, text):
        w = words_of(batch.column(text), ALNUM)
        start, _, _ = _matches(model.value, w.hash, w.counts, k, n)
        clean = np.ones(batch.num_rows, bool)
        clean[np.searchsorted(w.first, start, "right") - 1] = False
        yield batch.filter(pa.array(clean))


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    n: int = 10, k: int = 5, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows, with all their columns, that hold no window of any item; no shuffle."""
    ship_package(docs.sparkSession)
    for m in shipped_blocks(items, item_id, item_text, n, k, block_words):
        docs = docs.mapInArrow(lambda it, m=m: _clean_rows(it, m, text, k, n), docs.schema)
    return docs


def find_overlaps(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = 10,
    k: int = 5,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Per document its words, the hit word spans and the ids of the items found.

    The benchmark's size is counted first and it is shipped in blocks of about
    ``block_words`` words: one pass over the documents each, no shuffle for the
    usual single block.
    """
    ship_package(docs.sparkSession)
    texts = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text)).alias("text_key"),
        F.col(text).cast("string").alias("text"),
    )
    models = shipped_blocks(items, item_id, item_text, n, k, block_words)
    passes = [texts.mapInArrow(lambda it, m=m: _search(it, m, k, n), SCHEMA) for m in models]
    blocks = len(passes)
    if blocks == 1:
        return passes[0].drop("text_key")
    every = passes[0].withColumn("block", F.lit(0))
    for b, one in enumerate(passes[1:], 1):
        every = every.unionByName(one.withColumn("block", F.lit(b)))
    # equal rows of a repeated id meet in one group and are counted in the first pass
    return (
        every.groupBy("doc_id", "n_words", "text_key")
        .agg(
            F.flatten(F.collect_set("spans")).alias("s"),
            F.array_distinct(F.flatten(F.collect_set("items"))).alias("i"),
            F.sum(F.when(F.col("block") == 0, 1)).alias("copies"),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select("doc_id", "n_words", merged_spans("s").alias("spans"), F.array_sort("i").alias("items"))
    )


def overlap_digest(found: DataFrame) -> DataFrame:
    """Counts and a digest of the overlaps, one row per document."""
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
