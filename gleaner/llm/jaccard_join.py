"""N-gram Jaccard join by T-occurrence search over inverted lists.

Two texts link when their sets of ``k``-word shingles have at least
``share / 100`` of their union in common. A set of n shingles can only link
through one of its n - ceil(share n) + 1 first shingles, in one order that all
texts use: rare shingles first, those of frequent passages last. So short
lists are merged, and long ones are only probed:

1. One row per text: set size and a 128-bit signature; equal sets collapse.
2. The first shingles of each text go to buckets by hash; a bucket sorts them
   and finds the inverted lists of two or more texts.
3. Short lists are merged: they give pairs with the number of first shingles in
   common. What is left of a text bounds the rest of the overlap; pairs that
   can still reach T are joined with their texts and counted exactly.
4. Long lists join their texts into families. A family is cut into tiles of
   bounded size, and each tile runs the T-occurrence search (DivideSkip): short
   lists merged, the longest probed by binary search, texts kept that reach the
   overlap T.

Only spanning links leave a tile, so a crowd of copies costs a row per text.

Defined results: null or empty text has no shingles and links with nothing; a
text of fewer than ``k`` words is one shingle; rows that share an id are one
document; a null id links with nothing and has a null component.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.graph import components
from gleaner.llm.names import unused
from gleaner.llm.store import stored
from gleaner.llm.words import SPACED, U64, mix, runs, shingles, slices, words_of
from gleaner.session import ship_package

SAMPLE_DOCS = 20_000  # texts that show which shingles are frequent, and a quarter of them at least:
SAMPLE_PART = 4  # a list over SHORT_LIST then shows several times; this only sets the order
FREQUENT = 4_000_000
SLOT_BITS = 26  # leading bits of a shingle that name the slot of its count
COUNT_BITS = 8  # and the bucket in which it is counted
SHORT_LIST = 32  # texts in a list whose pairs are written
TILE = 500  # texts in one side of a tile
TILE_SHINGLES = 500_000  # and their shingles, as long texts are cut into smaller blocks
BUCKET_ROWS = 100_000
BUCKETS_A_TASK = 16  # so that most lists of a pair meet in few tasks and leave them as few rows
BROADCAST_IDS = 1_000_000  # counted first; beyond it the ids are joined by a shuffle
SLICE = 1 << 20  # bytes of text hashed at once where slices do not shape the result
_SIGN = (U64(0x1B873593CC9E2D51), U64(0xE6546B64A5A5A5A5))


def by_row(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Order of (row, key) pairs; the rows of a slice mostly fit 16 bits (radix sort)."""
    order = np.argsort(keys)
    own = rows[order]
    return order[np.argsort(own.astype(np.uint16) if len(own) and own.max() < 65536 else own, kind="stable")]


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: ``(rows, hashes)`` ordered by both."""
    w = words_of(texts, SPACED)
    counts = w.counts
    row, place = runs(counts)
    starts = np.flatnonzero(counts[row] - place >= k)
    rows, hashes = [row[starts]], [shingles(w.hash, k)[starts]]
    for size in range(1, k):
        own = np.flatnonzero(counts == size)
        if len(own):
            rows.append(own)
            hashes.append(mix(shingles(w.hash, size)[w.first[own]] + U64(size)))
    rows, hashes = np.concatenate(rows), np.concatenate(hashes)
    order = by_row(rows, hashes)
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def signatures(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Size of each set and two sums over its mixed shingles."""
    size = np.bincount(rows, minlength=n)
    full = np.flatnonzero(size)
    at = (np.cumsum(size) - size)[full]
    sums = []
    for salt in _SIGN:
        s = np.zeros(n, U64)
        if len(full):
            s[full] = np.add.reduceat(mix(hashes ^ salt), at)
        sums.append(s)
    return size, sums


def _meta(batches, k):
    for batch in slices(batches, "text", SLICE):
        size, (s1, s2) = signatures(*shingle_sets(batch.column("text"), k), batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(size), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64))],
            names=["id", "n", "s1", "s2"],
        )


def _sampled(batches, k):
    """32 bits of each shingle of the sample, packed by the bucket that the bits before them name."""
    for batch in slices(batches, "text", SLICE):
        _, hashes = shingle_sets(batch.column("text"), k)
        hashes = np.sort(hashes)
        to = (hashes >> U64(64 - COUNT_BITS)).astype(np.int64)
        short = (hashes >> U64(32 - COUNT_BITS)).astype(np.uint32)
        cuts = np.flatnonzero(np.diff(to, prepend=-1))
        packed = [short[a:b].tobytes() for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(to)])]
        yield pa.RecordBatch.from_arrays([pa.array(to[cuts], pa.int64()), pa.array(packed, pa.binary())], names=["bucket", "h"])


def _repeated(batches):
    """``(slot, n)``: how often the most frequent shingle of a slot was seen, if more than once."""
    held: dict[int, list] = {}
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("h").to_pylist()):
            held.setdefault(bucket, []).append(blob)
    for bucket in list(held):
        short = np.sort(np.frombuffer(b"".join(held.pop(bucket)), np.uint32))
        at = np.flatnonzero(np.append(True, short[1:] != short[:-1]))
        n = np.diff(np.append(at, len(short)))
        at, n = at[n > 1], n[n > 1]
        slot = (bucket << (SLOT_BITS - COUNT_BITS)) + (short[at] >> np.uint32(32 + COUNT_BITS - SLOT_BITS)).astype(np.int64)
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        most = np.minimum(np.maximum.reduceat(n, first), 255) if len(first) else n
        yield pa.RecordBatch.from_arrays([pa.array(slot[first], pa.int64()), pa.array(most, pa.int64())], names=["slot", "n"])


def frequencies(sample: DataFrame, k: int) -> np.ndarray:
    """Counts of shingles by their leading bits, 0 for those seen once; the most frequent ``FREQUENT`` at most."""
    shown = stored(
        sample.mapInArrow(lambda it: _sampled(it, k), "bucket long, h binary")
        .repartition(1 << (COUNT_BITS - 2), "bucket")
        .mapInArrow(_repeated, "slot long, n long")
    )
    least, total = 256, 0
    for row in sorted(shown.groupBy("n").agg(F.count("*").alias("slots")).collect(), reverse=True):
        total += row.slots
        if total > FREQUENT:
            break
        least = row.n
    rows = shown.filter(F.col("n") >= least).select(F.col("slot").cast("int"), F.col("n").cast("short")).toArrow()
    bits = min(SLOT_BITS, max(16, (16 * rows.num_rows).bit_length()))
    levels = np.zeros(1 << bits, np.uint8)
    np.maximum.at(levels, rows["slot"].to_numpy() >> (SLOT_BITS - bits), rows["n"].to_numpy().astype(np.uint8))
    return levels


def prefixes(rows, hashes, n_rows, levels: np.ndarray, share: int):
    """First shingles of each set in the common order: ``(rows, hashes)``."""
    size = np.bincount(rows, minlength=n_rows)
    if len(hashes):
        own = levels[(hashes >> U64(65 - len(levels).bit_length())).astype(np.int64)]
        order = np.argsort(rows * 256 + own, kind="stable")
        rows, hashes = rows[order], hashes[order]
    place = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
    first = size + (-size * share // 100) + 1  # n - ceil(share n / 100) + 1
    keep = place < first[rows]
    return rows[keep], hashes[keep]


def _blobs(batches, k, share, frequent, buckets):
    """First shingles, packed by bucket; equal sets seen by this task are sent once."""
    freq, seen = frequent.value, set()
    for batch in slices(batches, "text"):
        rows, hashes = shingle_sets(batch.column("text"), k)
        size, (s1, s2) = signatures(rows, hashes, batch.num_rows)
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        fresh = np.zeros(batch.num_rows, bool)
        if len(seen) > 1_000_000:
            seen = set()
        for r in np.argsort(ids, kind="stable").tolist():
            key = (int(s1[r]), int(s2[r]))
            if size[r] and key not in seen:
                seen.add(key)
                fresh[r] = True
        own = fresh[rows]
        rows, hashes = prefixes(rows[own], hashes[own], batch.num_rows, freq, share)
        to = (hashes % U64(buckets)).astype(np.int64)
        order = np.argsort(to.astype(np.uint16) if buckets <= 65536 else to, kind="stable")
        to, rows, hashes = to[order], rows[order], hashes[order]
        cuts = np.flatnonzero(np.diff(to, prepend=-1))
        ends = np.append(cuts[1:], len(to))
        sig = s1 ^ (s2 << U64(1))
        columns = (hashes, ids[rows].astype(np.int64), sig[rows], size[rows].astype(np.int32))
        packed = [[c[a:b].tobytes() for a, b in zip(cuts.tolist(), ends.tolist())] for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(to[cuts], pa.int64()), *(pa.array(c, pa.binary()) for c in packed)], names=["bucket", "h", "id", "sig", "n"])


def needed(n1, n2, share: int):
    """Smallest overlap o with 100 o >= share (n1 + n2 - o)."""
    return -(-share * (n1 + n2) // (100 + share))


def list_pairs(h, ids, sig, n, share: int, short: int):
    """From one bucket, ``(a, b, n_a, n_b, common)`` of short lists, and hub links of long ones."""
    order = np.argsort(h)
    h = h[order]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[1:] == h[:-1]
    own = same[1:] | same[:-1]  # in a list of two or more
    order, h = order[own], h[own]
    ids, sig, n = ids[order], sig[order], n[order]
    group = np.cumsum(np.diff(h, prepend=h[:1] ^ U64(1)) != 0) if len(h) else np.empty(0, np.int64)
    # equal sets count once in a list: the smallest id stays
    order = np.lexsort((ids, n, sig, group))
    group, ids, sig, n = group[order], ids[order], sig[order], n[order]
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (sig[1:] != sig[:-1]) | (n[1:] != n[:-1])
    group, ids, n = group[new], ids[new], n[new]
    start = np.flatnonzero(np.diff(group, prepend=-1))
    count = np.diff(np.append(start, len(group)))
    hot, pairs = np.empty((0, 2), np.int64), []
    long = np.repeat(count > short, count)
    if long.any():
        hub = np.repeat(ids[start], count)
        hot = np.unique(np.stack([ids[long], hub[long]], 1), axis=0)
    left = np.repeat(start + count, count) - np.arange(len(group)) - 1  # later texts of the list
    left[long] = 0
    for part in np.array_split(np.arange(len(group)), max(1, int(left.sum()) // 1_000_000 + 1)):
        one, nth = runs(left[part])
        x = part[one]
        y = x + 1 + nth
        ok = (100 * np.minimum(n[x], n[y]) >= share * np.maximum(n[x], n[y])) & (ids[x] != ids[y])
        x, y = x[ok], y[ok]
        x, y = np.where(ids[x] < ids[y], x, y), np.where(ids[x] < ids[y], y, x)
        rows, times = np.unique(np.stack([ids[x], ids[y], n[x], n[y]], 1), axis=0, return_counts=True)
        pairs.append(np.column_stack([rows, times]))
    if not pairs:
        return np.empty((0, 5), np.int64), hot
    rows = np.concatenate(pairs)
    rows = rows[np.lexsort(rows.T[3::-1])]
    at = np.flatnonzero(np.append(True, (rows[1:, :4] != rows[:-1, :4]).any(1))) if len(rows) else np.empty(0, np.int64)
    if len(at):
        rows = np.column_stack([rows[at, :4], np.add.reduceat(rows[:, 4], at)])
    return rows, hot


def _bucket_pairs(batches, share, short):
    kinds = {"h": np.uint64, "id": np.int64, "sig": np.uint64, "n": np.int32}
    held: dict[str, list] = {k: [] for k in kinds}
    for batch in batches:
        for name, kind in kinds.items():
            held[name].append(np.frombuffer(b"".join(batch.column(name).to_pylist()), kind))
    if not held["h"]:
        return
    pairs, hot = list_pairs(*(np.concatenate(held[k]) for k in kinds), share, short)
    hot = np.column_stack([hot, np.zeros((len(hot), 3), np.int64)])
    for rows, is_hot in ((pairs, False), (hot, True)):
        for a in range(0, len(rows), 100_000):
            some = rows[a : a + 100_000].astype(np.int64)
            columns = [pa.array(np.ascontiguousarray(some[:, i])) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(some), is_hot))], names=["a", "b", "n_a", "n_b", "common", "hot"])


def _verified(batches, k, share):
    for batch in (own for part in slices(batches, "text_a", SLICE) for own in slices([part], "text_b", SLICE)):
        ra, ha = shingle_sets(batch.column("text_a"), k)
        rb, hb = shingle_sets(batch.column("text_b"), k)
        rows, hashes = np.concatenate([ra, rb]), np.concatenate([ha, hb])
        order = by_row(rows, hashes)
        rows, hashes = rows[order], hashes[order]
        common = np.bincount(rows[1:][(rows[1:] == rows[:-1]) & (hashes[1:] == hashes[:-1])], minlength=batch.num_rows)
        total = np.bincount(rows, minlength=batch.num_rows)
        ok = pa.array((100 * common >= share * (total - common)) & (common > 0))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])


def t_occurrence(query: np.ndarray, keys: np.ndarray, lists: np.ndarray, sizes: np.ndarray, share: int) -> np.ndarray:
    """Texts whose set overlaps ``query`` enough (DivideSkip).

    ``keys`` are the sorted shingles of all texts and ``lists`` the text of
    each, ascending within a shingle. T is the least overlap any partner needs.
    The longest lists, fewer than T of them, are set aside; the others are
    merged by counting, and texts with the rest of T are probed in the long
    lists by binary search.
    """
    lo, hi = np.searchsorted(keys, query), np.searchsorted(keys, query, "right")
    own = hi > lo
    lo, hi = lo[own], hi[own]
    least = -(-share * len(query) // 100)
    if len(lo) < least:
        return np.empty(0, np.int64)
    order = np.argsort(lo - hi, kind="stable")  # longest first
    lo, hi = lo[order], hi[order]
    skip = min(least - 1, int(least / (0.01 * math.log2(max(2, int(hi[0] - lo[0]))) + 1)))
    group, nth = runs((hi - lo)[skip:])
    merged = np.bincount(lists[lo[skip:][group] + nth], minlength=len(sizes))
    found = np.flatnonzero(merged >= least - skip)
    count = merged[found]
    for a, b in zip(lo[:skip], hi[:skip]):
        at = np.minimum(np.searchsorted(lists[a:b], found), b - a - 1)
        count = count + (lists[a:b][at] == found)
    return found[count >= needed(len(query), sizes[found], share)]


def _tile(table: pa.Table, k: int, share: int) -> pa.Table:
    """Spanning links between the two blocks of a tile (or inside one block)."""
    rows, hashes, n = [], [], 0
    for batch in slices(table.select(["text"]).to_batches(), "text", SLICE):
        own, some = shingle_sets(batch.column("text"), k)
        rows.append(own + n)
        hashes.append(some)
        n += batch.num_rows
    rows, hashes = np.concatenate(rows), np.concatenate(hashes)
    ids = table["id"].to_numpy()
    sizes = np.bincount(rows, minlength=len(ids))
    first = table["first"].to_numpy()
    inner = table["inner"][0].as_py()
    index = np.flatnonzero(first)
    queries = index if inner else np.flatnonzero(~first)
    number = np.full(len(ids), -1)
    number[index] = np.arange(len(index))
    own = first[rows]
    order = np.argsort(hashes[own], kind="stable")  # rows ascend within a shingle
    keys, lists = hashes[own][order], number[rows[own]][order]
    at = np.cumsum(sizes) - sizes
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for q in queries.tolist():
        for x in index[t_occurrence(hashes[at[q] : at[q] + sizes[q]], keys, lists, sizes[index], share)].tolist():
            p, r = root(q), root(x)
            if p != r:
                parent[p] = r
                out.append((int(ids[q]), int(ids[x])))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def family_tiles(hot: DataFrame, sizes: DataFrame, share: int, tile: int) -> DataFrame:
    """``(id, component, i, j, first)``: the tiles in which each text of a family meets others.

    A family is cut by size: sets that link are within a factor of 100 / share,
    so a band of that width meets itself and the next one only. A band is cut
    into blocks of about ``tile`` texts and ``TILE_SHINGLES`` shingles at most; a
    tile is two blocks.
    """
    placed = stored(
        components(hot)
        .join(sizes, "id")
        .withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / share)) + 1e-9).cast("int"))
    )
    most = F.greatest(F.count("*") / tile, F.sum("n") / TILE_SHINGLES)
    blocks = placed.groupBy("component", "band").agg(F.ceil(most).cast("int").alias("blocks"))
    own = placed.join(blocks, ["component", "band"]).withColumn("block", F.pmod(F.hash("id"), F.col("blocks")))
    # the bands that a text meets: its own and those beside it
    near = F.explode(F.array(*[F.struct(F.lit(d).alias("step")) for d in (-1, 0, 1)]))
    met = own.select("id", "component", "band", "block", near.alias("d")).select(
        "id", "component", "band", "block", (F.col("band") + F.col("d.step")).alias("other_band")
    )
    met = met.join(blocks.toDF("component", "other_band", "others"), ["component", "other_band"])
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    here, there = F.struct("band", "block"), F.struct(F.col("other_band").alias("band"), F.col("other").alias("block"))
    return met.select(
        "id", "component", F.least(here, there).alias("i"), F.greatest(here, there).alias("j"), (here <= there).alias("first")
    )


def family_links(texts: DataFrame, hot: DataFrame, sizes: DataFrame, k: int, share: int, tile: int) -> DataFrame:
    """Links inside the families that long lists make, found tile by tile."""
    return (
        texts.join(family_tiles(hot, sizes, share, tile), "id")
        .select("id", "text", "first", (F.col("i") == F.col("j")).alias("inner"), "component", F.col("i.band").alias("ib"), F.col("i.block").alias("i"), F.col("j.band").alias("jb"), F.col("j.block").alias("j"))
        .groupBy("component", "ib", "i", "jb", "j")
        .applyInArrow(lambda t: _tile(t, k, share), "a long, b long")
    )


def similar_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    k: int = 5,
    share: int = 75,
    short_list: int = SHORT_LIST,
    tile: int = TILE,
    sample_docs: int = SAMPLE_DOCS,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row: the smallest id that links reach."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    meta = stored(texts.mapInArrow(lambda it: _meta(it, k), "id long, n long, s1 long, s2 long"))
    facts = meta.agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")).first()
    # frequent shingles, from a sample: any order is right, this one keeps lists short
    some = int(1_000_000 * min(1.0, max(1 / SAMPLE_PART, sample_docs / max(1, facts.docs))))
    sample = texts.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < some)
    frequent = spark.sparkContext.broadcast(frequencies(sample, k))
    buckets = max(64, (facts.shingles or 0) * (100 - share) // 100 // BUCKET_ROWS)
    found = stored(
        texts.filter(F.col("id").isNotNull())
        .mapInArrow(
            lambda it: _blobs(it, k, share, frequent, buckets),
            "bucket long, h binary, id binary, sig binary, n binary",
        )
        .repartition(max(8, buckets // BUCKETS_A_TASK), "bucket")
        .mapInArrow(lambda it: _bucket_pairs(it, share, short_list), "a long, b long, n_a long, n_b long, common long, hot boolean")
    )
    hot = stored(found.filter("hot").select("a", "b").distinct())
    # lists that are not short are searched by family, so `common` counts all others of a pair
    # an id with several texts has several sizes: the bounds hold for each of them
    rest = F.floor(F.greatest(F.max("n_a"), F.max("n_b")) * share / 100 + 1)  # at least what is beyond first shingles
    pairs = stored(
        found.filter("not hot")
        .groupBy("a", "b")
        .agg(((100 + share) * (F.sum("common") + rest)).alias("most"), (F.min("n_a") + F.min("n_b")).alias("both"))
        .filter(F.col("most") >= share * F.col("both"))
        .select("a", "b")
    )
    # only texts that a list names are joined: few, so their ids are mostly small enough to broadcast
    ids = stored(pairs.unionByName(hot).select(F.explode(F.array("a", "b")).alias("id")).distinct())
    named = stored(texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi"))
    one, two = named.alias("one"), named.alias("two")
    joined = (
        pairs.join(one, F.col("a") == F.col("one.id"))
        .select("a", "b", F.col("one.text").alias("text_a"))
        .join(two, F.col("b") == F.col("two.id"))
        .select("a", "b", "text_a", F.col("two.text").alias("text_b"))
    )
    links = joined.mapInArrow(lambda it: _verified(it, k, share), "a long, b long")
    sizes = meta.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max("n").alias("n"))
    links = links.unionByName(family_links(named, hot, sizes, k, share, tile))
    # equal sets: everything above may name any of them, the smallest stands for all
    first = meta.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("first"))
    first = stored(meta.filter("n > 0").join(first, ["n", "s1", "s2"]).select("id", "first").distinct())
    ends = links.join(first.toDF("a", "fa"), "a").join(first.toDF("b", "fb"), "b").select("fa", "fb")
    many = first.filter("id <> first").select(F.col("id").alias("fa"), F.col("first").alias("fb"))
    linked = components(ends.unionByName(many), "fa", "fb").withColumnRenamed("id", "linked")
    return meta.join(linked, F.col("id") == F.col("linked"), "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, share: int = 75) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of linked documents the smallest id.

    Of rows that repeat an id one stays; rows without an id stay.
    """
    (gone_id,) = unused(docs.columns, "gone_id")
    gone = (
        similar_documents(docs, doc_id, text, k, share)
        .filter("doc_id <> component_id")
        .select(F.col("doc_id").alias(gone_id))
        .distinct()
    )
    left = docs.join(gone, F.col(doc_id).cast("long") == F.col(gone_id), "left_anti")
    named = left.filter(F.col(doc_id).isNotNull()).dropDuplicates([doc_id])
    return named.unionByName(left.filter(F.col(doc_id).isNull()))
