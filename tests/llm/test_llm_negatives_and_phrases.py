"""Hard negatives, collocations and the Hamming join against brute force; all registered SQL."""
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from check_queries import TABLES, rows_of
from gleaner.llm import collocations as co
from gleaner.llm import hard_negatives as hn
from gleaner.llm import minhash_join as mj
from gleaner.llm import queries

SF = "/root/testdata/sf0.001"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


# ---- residue-number-system products


@pytest.mark.parametrize("width, most", [(64, 200), (3, 2**28), (1500, 2**20), (1, 2**30 - 1), (0, 1)])
def test_products_are_exact(width, most):
    r = np.random.default_rng(width)
    a, b = r.integers(-most, most + 1, (7, width)), r.integers(-most, most + 1, (9, width))
    if width:
        a[0], b[0], b[1] = most, most, -most
    primes = hn.primes_for(max([0, *(int(x @ x) for x in [*a.astype(object), *b.astype(object)])]))
    got = hn.products(hn.residues(a, primes), hn.residues(b, primes), primes)
    assert got.tolist() == (a.astype(object) @ b.astype(object).T).tolist() if width else not got.any()


def plain_negatives(rows, positives=5, negatives=10):
    usable = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [math.floor(256 * x) for x in v], label))
    out, last = [], float("inf")
    for i, q, label in {(i, tuple(q), label) for i, q, label in usable}:
        if i is None or i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, p)), last if j is None else j, m) for j, p, m in usable if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            window = [x for x in scored if x[2] != label and -30 * s <= -100 * x[0] <= -90 * s]
            for rank, (t, n, _) in enumerate(window[:negatives], 1):
                out.append((i, None if j == last else j, rank, None if n == last else n, -s, -t))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [3, 16_384])
def test_negatives_of_awkward_rows(spark, block):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)], r.randint(0, 2)) for i in range(400)]
    rows += [(i, [1.0, 0.5, 0.25, 0.0, 0.0, 0.0], i % 2) for i in range(400, 460)]  # one vector many times
    rows += [(500, [0.1] * 6, None), (501, None, 1), (502, [0.1, None], 1), (503, [float("nan")] * 6, 1), (504, [float("inf")] * 6, 1)]
    rows += [(505, [1e30] * 6, 1), (506, [], 1), (507, [2.0, 1.0], 1), (None, [1.0] * 6, 1), (600, [0.3] * 6, 2), (600, [0.3] * 6, 2), (600, [0.4] * 6, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS id", "2 AS vec", "3 AS anchor")
    got = hn.mine_hard_negatives(df.repartition(5), F.col("vec_id") % 100 == 0, block=block).collect()
    assert sorted(map(tuple, got), key=repr) == plain_negatives([x for x in rows if x[0] != 505])
    assert hn.mine_hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# ---- phrases


def plain_collocations(docs, least, share, top):
    counts, out = defaultdict(Counter), []
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                for p in range(len(w) - k + 1):
                    counts["und" if lang is None else lang][tuple(w[p : p + k])] += 1
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        rows = []
        for p, a in f.items():
            if len(p) > 1 and a >= least:
                cuts = [(10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                longer = [c for q, c in f.items() if len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:]) and c >= least]
                if not any(100 * c >= share * a for c in longer):
                    rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


@pytest.mark.parametrize("top", [3, 12, 5_000])
def test_phrases_in_waves(spark, top):
    r = random.Random(8)
    common = [f"w{i}" for i in range(25)] + ["Straße", "ÉTÉ", "naïve", "nul\x00byte", "日本"]
    fixed = ["new york city", "Ice cream", "ad hoc", "de facto rule"]

    def text():
        parts = [r.choice(fixed) if r.random() < 0.2 else r.choice(common) + r.choice(["", "", "", ",", ".", "!"]) for _ in range(r.randint(0, 60))]
        return r.choice([" ", "\t", "  "]).join(parts) + r.choice(["", "\n"])

    docs = [(r.choice(["en", "de", None, ""]), text()) for _ in range(160)] + [("fr", None), ("fr", ""), (None, None), ("es", " \t\n.,"), ("en", "long " * 30_000)]
    docs += [("de", "same text here again and again")] * 40
    df = spark.createDataFrame(docs, "lang string, text string").selectExpr("*", "1 AS x", "2 AS y", "'q' AS word", "3 AS score", "4 AS rank")
    got = co.mine_collocations(df.repartition(6), least=4, top=top).collect()
    assert sorted(map(tuple, got)) == plain_collocations(docs, 4, 50, top)


def test_no_phrases(spark, empty_docs, awkward):
    assert co.mine_collocations(empty_docs).count() == 0
    rows = [(r.lang, r.text) for r in awkward.collect()]
    assert sorted(map(tuple, co.mine_collocations(awkward).collect())) == plain_collocations(rows, 10, 50, 2_000)


def test_a_bound_is_never_under_a_growth_behind_it(spark):
    r = random.Random(2)
    docs = [("en", " ".join(r.choice("abcdef") for _ in range(80))) for _ in range(30)]
    texts = spark.createDataFrame(docs, "lang string, text string")
    words = co._counted(texts, co._unigrams, ["x"])
    pairs = co.pairs_of_words(texts, words, 1)
    grown = co.growths(texts, pairs, pairs, words, 1)
    over = grown.alias("g").join(pairs.select("x", "y", "bound").alias("p"), ["x", "y"]).filter("g.score > p.bound")
    assert grown.count() > 100 and over.count() == 0


def test_a_bit_map_holds_all_its_keys(spark):
    r = np.random.default_rng(1)
    x, y = r.integers(-(2**62), 2**62, (2, 3000))
    bits = co.bit_map(spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x long, y long"))
    assert co.in_map(bits, co.prefix_key(x.view(np.uint64), y.view(np.uint64))).all()
    other = r.integers(0, 2**62, (2, 3000)).view(np.uint64)
    assert co.in_map(bits, co.prefix_key(*other)).mean() < 0.15


# ---- Hamming join


def test_chunks_share_a_key_up_to_the_threshold():
    r = np.random.default_rng(6)
    for errors in (1, 4, 7, 23):
        for _ in range(60):
            a = r.integers(0, 2**16, 64).astype(np.uint16)
            b = a.copy()
            at = r.choice(64, r.integers(0, errors + 1), replace=False)
            b[at] ^= np.uint16(1) + r.integers(0, 9, len(at)).astype(np.uint16)
            x, y = mj.chunk_keys(np.stack([a, b]), errors)
            assert (x == y).any()


def plain_components(rows, k=5, share=85):
    sets = defaultdict(list)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[i].append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    ids = sorted(x for x in sets if x is not None)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, x in enumerate(ids):
        for y in ids[n + 1 :]:
            for s in sets[x]:
                for t in sets[y]:
                    o = len(s & t)
                    if o and 100 * o >= share * (len(s) + len(t) - o):
                        a, b = sorted((root(x), root(y)))
                        parent[b] = a
    return {i: root(i) for i in ids}


def families(seed, size, chain=False):
    r = random.Random(seed)
    words, rows = [f"w{i}" for i in range(900)], []
    passage = [r.choice(words) for _ in range(40)]
    for _ in range(4):
        base = [r.choice(words) for _ in range(r.randint(80, 160))]
        for _ in range(size):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4])):
                own[r.randrange(len(own))] = r.choice(words)
            rows.append(" ".join(own))
            if chain:
                base = own
    rows += [" ".join(passage + [r.choice(words) for _ in range(r.randint(1, 60))]) for _ in range(60)]
    rows += ["", None, "one", "one two", "ONE  two", "a b c d e"]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("few, block, heavy, chain", [(24, 1_000, 10**6, False), (3, 4, 10**6, True), (2, 3, 64, False)])
def test_near_copies_in_pairs_crowds_and_tiles(spark, few, block, heavy, chain):
    rows = families(few, 25, chain)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in mj.near_copies(docs, few=few, block=block, heavy=heavy).collect()}
    want = plain_components(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) for i, r in got.items())


def test_near_copies_of_awkward_rows(spark, awkward, empty_docs):
    got = mj.near_copies(awkward).collect()
    assert len(got) == awkward.count()
    want = plain_components([(r.doc_id, r.text) for r in awkward.collect()])
    assert all(r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert {r.n_shingles for r in got if r.doc_id in (3, 4, 5)} == {0}
    assert mj.near_copies(empty_docs).count() == 0


def test_signatures_differ_as_the_sets_do():
    r = np.random.default_rng(4)
    far = []
    for _ in range(120):
        base = np.unique(r.integers(0, 2**63, 460, dtype=np.uint64))
        one, two = np.sort(base[:430]), np.sort(base[30:])  # 400 of 460 in common
        rows = np.repeat([0, 1], [len(one), len(two)])
        _, sig = mj.signatures(rows, np.concatenate([one, two]), 2, 64, 16)
        far.append(np.count_nonzero(sig[0] != sig[1]))
    assert abs(np.mean(far) / 64 - 60 / 460) < 0.02 and max(far) <= mj.ERRORS
