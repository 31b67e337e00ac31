"""Phrase collocations by best-first branch-and-bound growth.

Phrases of two and three words are scored per language: with a = f(phrase), a cut
into parts of frequencies l and r scores floor(10^6 a a / (l r)); the lowest cut
counts. Neither part is rarer than the phrase, so a prefix of frequency p whose
own first word has frequency q bounds every growth of it: a <= p and r >= a, so
no three-word phrase behind it scores over floor(10^6 p / q).

1. Words are counted over the whole corpus, then pairs of frequent words: a pair
   is no more frequent than its words.
2. The frontier is every pair that is frequent enough. A wave takes, per
   language, the prefixes whose bound reaches a threshold, best first, and those
   that can grow into a phrase that would drop a pair of that score. Only their
   growths are counted, in one pass over the texts.
3. A language is settled once ``top`` phrases that survive score at or above its
   threshold: nothing left can reach it, ties included. The others go on with a
   lower threshold, down to 0.

The threshold of a wave is the score of the ``top`` x 2, x 8, x 32 ... -th pair.
A pass carries the frontier as a bit map of bounded size; what its false hits
add goes when the counts are joined with the frontier. Counts add up inside a
task before they are shuffled, so a frequent word or pair is no hot key.

Defined results: null or empty text holds no words; a null language is ``und``;
rows that repeat count each; equal scores go by a, then by the phrase's bytes; a
language without candidates has no rows, as has an empty table.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.store import stored
from gleaner.llm.words import SPACED, U64, Words, mix, slices, text_bytes, words_of
from gleaner.session import ship_package

MAP_BITS = 28  # of the largest bit map: 32 MB
HELD = 500_000  # distinct rows that a task adds up before it sends them
SLICE = 1 << 20  # bytes of text taken at once
_STEP = U64(0x9FB21C651E98DF25)

# a word ends at a blank, a piece also at . , ; : ! ? and line ends
CUTS = [ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]
WORDS = SPACED.copy()
WORDS[CUTS] = 0
IS_CUT = np.isin(np.arange(256), CUTS)


def _followed(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, the row of each, and whether the next word is in the same piece."""
    w = words_of(texts, WORDS)
    row = np.repeat(np.arange(len(texts)), w.counts)
    if not len(row):
        return w, row, np.zeros(0, bool)
    flat, _ = text_bytes(texts)
    piece = np.cumsum(IS_CUT[flat], dtype=np.int64)[w.start]
    goes_on = np.zeros(len(row), bool)
    goes_on[:-1] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
    return w, row, goes_on


def _languages(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of each row's language in the slice, and the languages."""
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _coded(*parts: np.ndarray) -> np.ndarray:
    """One hash for each row of several columns."""
    out = np.zeros(len(parts[0]), U64)
    for x in parts:
        out = mix((out ^ x.astype(U64)) * _STEP + U64(1))
    return out


def _added(held: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Rows of one code as one, their counts added."""
    _, first, of = np.unique(held["code"], return_index=True, return_inverse=True)
    total = np.bincount(of, weights=held["times"], minlength=len(first)).astype(np.int64)
    return {k: v[first] for k, v in held.items()} | {"times": total}


def _sent(held: dict[str, np.ndarray], languages: list[str | None], names: list[str]) -> Iterator[pa.RecordBatch]:
    known = pa.array(languages, pa.string())
    for a in range(0, len(held["code"]), 50_000):
        some = {k: v[a : a + 50_000] for k, v in held.items()}
        columns = [pc.take(known, pa.array(some["lang"])), *(pa.array(some[x].view(np.int64)) for x in names), pa.array(some["times"])]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", *names, "times"])


def _tally(batches, names: list[str], found) -> Iterator[pa.RecordBatch]:
    """Adds up over a task what ``found`` gives for each slice."""
    held, languages, known = None, [], {}
    for batch in slices(batches, "text", SLICE):
        own, names_of = _languages(batch.column("lang"))
        number = np.array([known.setdefault(x, len(known)) for x in names_of.to_pylist()], np.int64)
        languages = list(known)
        rows = found(batch.column("text"), number[own])
        if not len(rows["code"]):
            continue
        rows = _added(rows)
        held = rows if held is None else _added({k: np.concatenate([held[k], rows[k]]) for k in rows})
        if len(held["code"]) > HELD:
            yield from _sent(held, languages, names)
            held = None
    if held is not None:
        yield from _sent(held, languages, names)


def _unigrams(texts: pa.Array, lang: np.ndarray) -> dict[str, np.ndarray]:
    w, row, _ = _followed(texts)
    own = lang[row]
    return {"code": _coded(own, w.hash), "lang": own, "x": w.hash, "times": np.ones(len(row))}


def _bigrams(texts: pa.Array, lang: np.ndarray, bits: np.ndarray) -> dict[str, np.ndarray]:
    w, row, goes_on = _followed(texts)
    common = in_map(bits, prefix_key(w.hash, U64(0)))
    at = np.flatnonzero(goes_on[:-1] & common[:-1] & common[1:]) if len(goes_on) else np.empty(0, np.int64)
    x, y, own = w.hash[at], w.hash[at + 1], lang[row[at]]
    return {"code": _coded(own, x, y), "lang": own, "x": x, "y": y, "times": np.ones(len(at))}


def _spelled(batches, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Spelling of the words in a bit map, once a task."""
    seen = np.empty(0, U64)
    for batch in slices(batches, "text", SLICE):
        w, _, _ = _followed(batch.column("text"))
        hashes, first = np.unique(w.hash, return_index=True)
        new = in_map(bits, prefix_key(hashes, U64(0))) & ~np.isin(hashes, seen)
        hashes, first = hashes[new], first[new]
        seen = np.union1d(seen, hashes)
        low = w.low.tobytes()
        words = [low[a:b].replace(b"\xff", b"\x00").decode() for a, b in zip(w.start[first].tolist(), w.end[first].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(words, pa.string())], names=["x", "word"])


def in_map(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set in a map of 64-bit words."""
    width = U64(len(bits).bit_length() + 5)
    at = keys >> (U64(64) - width)
    return (bits[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) != 0


def _trigrams(texts: pa.Array, lang: np.ndarray, bits: np.ndarray) -> dict[str, np.ndarray]:
    w, row, goes_on = _followed(texts)
    at = np.flatnonzero(goes_on[:-1] & goes_on[1:]) if len(goes_on) else np.empty(0, np.int64)
    at = at[in_map(bits, prefix_key(w.hash[at], w.hash[at + 1]))]
    x, y, z, own = w.hash[at], w.hash[at + 1], w.hash[at + 2], lang[row[at]]
    return {"code": _coded(own, x, y, z), "lang": own, "x": x, "y": y, "z": z, "times": np.ones(len(at))}


def prefix_key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Place of a pair in the bit map; languages share it."""
    return mix(x * _STEP + y)


def bit_map(prefixes: DataFrame, most_bits: int = MAP_BITS) -> np.ndarray:
    """Pairs ``(x, y)`` as a bit map, 16 bits or more a pair while that fits."""
    bits = min(most_bits, max(10, (16 * prefixes.count()).bit_length()))

    def keys(batches):
        for batch in batches:
            k = prefix_key(batch.column("x").to_numpy().view(U64), batch.column("y").to_numpy().view(U64)) >> U64(64 - bits)
            one = (U64(1) << (k & U64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((k >> U64(6)).astype(np.int64)), pa.array(one)], names=["at", "bit"])

    rows = prefixes.select("x", "y").mapInArrow(keys, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), U64)
    out[rows["at"].to_numpy()] = rows["bit"].to_numpy().view(U64)
    return out


def exact(c: str) -> Column:
    """A count as a decimal wide enough for its square."""
    return F.col(c).cast("decimal(15,0)")


def cut_score(a: str, left: str, right: str) -> Column:
    """floor(10^6 a a / (l r)) in decimals of 38 digits; a is at most l and r, so it fits a long."""
    whole = F.lit(1_000_000).cast("decimal(7,0)") * (exact(a) * exact(a))
    return F.call_function("div", whole, exact(left) * exact(right))


def _first(rows: DataFrame, top: int, *order: Column) -> DataFrame:
    """The first rows of each language; tasks cut before they send."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


def _counted(texts: DataFrame, found, names: list[str], least: int = 1) -> DataFrame:
    kinds = ", ".join(f"{x} long" for x in names)
    rows = texts.mapInArrow(lambda it: _tally(it, names, found), f"lang string, {kinds}, times long")
    return rows.groupBy("lang", *names).agg(F.sum("times").alias("f")).filter(F.col("f") >= least)


def _shipped_map(prefixes: DataFrame):
    return prefixes.sparkSession.sparkContext.broadcast(bit_map(prefixes))


def pairs_of_words(texts: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """Frequent pairs with score and bound: ``(lang, x, y, a, l, r, score, bound)``."""
    common = _shipped_map(words.select("x", F.lit(0).cast("long").alias("y")).distinct())
    pairs = stored(_counted(texts, lambda t, own: _bigrams(t, own, common.value), ["x", "y"], least).withColumnRenamed("f", "a"))
    one = words.select("lang", F.col("x").alias("x"), F.col("f").alias("l"))
    two = words.select("lang", F.col("x").alias("y"), F.col("f").alias("r"))
    return stored(
        pairs.join(one, ["lang", "x"])
        .join(two, ["lang", "y"])
        .withColumn("score", cut_score("a", "l", "r"))
        .withColumn("bound", F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * exact("a"), exact("l")))
    )


def growths(texts: DataFrame, prefixes: DataFrame, pairs: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """Frequent growths of the prefixes: ``(lang, x, y, z, a, l, r, score)``."""
    shipped = _shipped_map(prefixes)
    found = _counted(texts, lambda t, own: _trigrams(t, own, shipped.value), ["x", "y", "z"], least).withColumnRenamed("f", "a")
    found = stored(found.join(prefixes.select("lang", "x", "y", F.col("a").alias("f_xy"), F.col("l").alias("f_x")), ["lang", "x", "y"]))
    back = pairs.select("lang", F.col("x").alias("y"), F.col("y").alias("z"), F.col("a").alias("f_yz"), F.col("r").alias("f_z"))
    one, two = cut_score("a", "f_x", "f_yz"), cut_score("a", "f_xy", "f_z")
    return stored(
        found.join(back, ["lang", "y", "z"])
        .withColumn("one", one)
        .withColumn("two", two)
        .select(
            "lang", "x", "y", "z", "a",
            F.when(F.col("two") < F.col("one"), F.col("f_xy")).otherwise(F.col("f_x")).alias("l"),
            F.when(F.col("two") < F.col("one"), F.col("f_z")).otherwise(F.col("f_yz")).alias("r"),
            F.least("one", "two").alias("score"),
        )
    )


def survivors(pairs: DataFrame, grown: DataFrame, share: int) -> DataFrame:
    """Pairs that no longer phrase drops, and all grown phrases (nothing is longer)."""
    ends = grown.select("lang", "x", "y", "a").unionByName(grown.select("lang", F.col("y").alias("x"), F.col("z").alias("y"), "a"))
    longer = ends.groupBy("lang", "x", "y").agg(F.max("a").alias("longer"))
    left = pairs.join(longer, ["lang", "x", "y"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    columns = ["lang", "x", "y", "z", "a", "l", "r", "score"]
    return left.withColumn("z", F.lit(None).cast("long")).select(columns).unionByName(grown.select(columns))


def mine_collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = 10,
    share: int = 50,
    top: int = 2_000,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` phrases."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    words = stored(_counted(texts, _unigrams, ["x"]))
    totals = stored(words.groupBy("lang").agg(F.sum("f").alias("n")))
    common = stored(words.filter(F.col("f") >= least))
    pairs = pairs_of_words(texts, common, least)
    settled, rank = [], 2 * top
    open_langs = pairs.select("lang").distinct()
    while True:
        # per language the threshold of this wave; languages with fewer pairs go to 0 at once
        ranked = _first(pairs.join(open_langs, "lang", "left_semi"), rank, F.desc("score"), F.desc("a"))
        limits = stored(
            ranked.groupBy("lang").agg(F.min("score").alias("lowest"), F.count("*").alias("have"))
            .select("lang", F.when(F.col("have") < rank, F.lit(0)).otherwise(F.col("lowest")).alias("limit"))
        )
        if limits.isEmpty():
            break
        asked = stored(pairs.join(F.broadcast(limits), "lang"))
        live = asked.filter("score >= limit")
        # growths over a pair's end: the prefix is as frequent as the phrase that would drop it
        behind = live.groupBy("lang", "x").agg(F.min("a").alias("needed")).withColumnRenamed("x", "y")
        before = asked.join(behind, ["lang", "y"]).filter(100 * F.col("a") >= share * F.col("needed"))
        keys = asked.filter("bound >= limit").select("lang", "x", "y").unionByName(before.select("lang", "x", "y")).distinct()
        prefixes = stored(asked.join(keys, ["lang", "x", "y"], "left_semi"))
        grown = growths(texts.join(F.broadcast(limits), "lang", "left_semi"), prefixes, pairs, common, least)
        left = survivors(live.drop("limit"), grown, share).join(F.broadcast(limits), "lang").filter("score >= limit")
        left = stored(left)
        have = left.groupBy("lang").agg(F.count("*").alias("have"))
        done = stored(limits.join(have, "lang", "left").filter((F.col("limit") == 0) | (F.coalesce("have", F.lit(0)) >= top)).select("lang"))
        settled.append(left.join(F.broadcast(done), "lang", "left_semi").drop("limit"))
        open_langs = limits.join(done, "lang", "left_anti").select("lang")
        rank *= 4
    if not settled:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    # ties in score and count go by the phrase, so whole groups of ties are spelled out first
    place = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    near = stored(found.withColumn("place", place).filter(F.col("place") <= top).drop("place"))
    used = near.select(F.explode(F.array("x", "y", "z")).alias("x")).filter("x IS NOT NULL").distinct()
    wanted = _shipped_map(used.withColumn("y", F.lit(0).cast("long")))
    spelled = stored(texts.mapInArrow(lambda it: _spelled(it, wanted.value), "x long, word string").distinct())
    for part in "xyz":
        near = near.join(spelled.toDF(part, f"word_{part}"), part, "left")
    near = near.withColumn("phrase", F.concat_ws(" ", "word_x", "word_y", "word_z"))
    return (
        _first(near, top, F.desc("score"), F.desc("a"), F.asc("phrase"))
        .join(F.broadcast(totals), "lang")
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
