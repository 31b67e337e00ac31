"""Jaccard join, decontamination, passages and fingerprints against brute force."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import decontamination as dc
from gleaner.llm import fingerprints as fp
from gleaner.llm import graph
from gleaner.llm import jaccard_join as jj
from gleaner.llm import passages as ps

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def edited(r, words, vocabulary, share):
    return [r.choice(vocabulary) if r.random() < share else w for w in words]


@pytest.fixture(scope="module")
def families():
    """Families of near copies around one text each, copies, and unrelated texts."""
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, boiler = [], [r.choice(vocabulary) for _ in range(30)]
    for family in range(6):
        base = [r.choice(vocabulary) for _ in range(r.randint(40, 90))]
        for _ in range(14):
            rows.append(" ".join(edited(r, base, vocabulary, r.choice([0, 0.01, 0.02, 0.05]))))
    for _ in range(60):
        own = [r.choice(vocabulary) for _ in range(r.randint(3, 60))]
        rows.append(" ".join(own + (boiler if r.random() < 0.5 else [])))
    rows += ["", "one", "one two three four", "ONE two  three four", None]
    r.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def plain_components(rows, k=5, share=75):
    sets = {}
    for i, t in rows:
        w = SPACED.findall(low(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                o = len(sets[x] & sets[y])
                if 100 * o >= share * (len(sets[x]) + len(sets[y]) - o):
                    a, b = sorted((root(x), root(y)))
                    parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("short_list, tile", [(32, 500), (2, 4)])
def test_components_by_lists_and_by_tiles(spark, families, short_list, tile):
    docs = spark.createDataFrame(families, "doc_id long, text string").repartition(4)
    got = jj.similar_documents(docs, short_list=short_list, tile=tile).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(families)


def test_tiles_are_bounded_by_shingles(spark, families, monkeypatch):
    """Long texts are cut into smaller blocks: a tile's memory does not follow the length of its texts."""
    hot = spark.createDataFrame([(i, 1) for i in range(2, 61)], "a long, b long")
    sizes = spark.createDataFrame([(i, 100_000) for i in range(1, 61)], "id long, n long")
    tiles = jj.family_tiles(hot, sizes, 75, 500).groupBy("component", "i", "j").count().collect()
    assert len(tiles) == 78 and max(x["count"] for x in tiles) <= 25  # 12 blocks of about 5 texts
    monkeypatch.setattr(jj, "TILE_SHINGLES", 300)
    df = spark.createDataFrame(families, "doc_id long, text string")
    got = {x[0]: (x[1], x[2]) for x in jj.similar_documents(df, short_list=2).collect()}
    assert got == plain_components(families)


def test_common_phrases_make_no_family(spark, monkeypatch):
    """Phrases of many texts that few sampled texts hold: taken for rare, they joined all texts to one family."""
    r, hot = random.Random(3), []
    phrases = [" ".join(f"p{i}x{j}" for j in range(5)) for i in range(20)]
    rows = [(i, " ".join([*(f"u{i}y{j}" for j in range(30)), *r.sample(phrases, 4)])) for i in range(600)]
    links = jj.family_links
    monkeypatch.setattr(jj, "family_links", lambda texts, found, *rest: hot.append(found.count()) or links(texts, found, *rest))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jj.similar_documents(df, sample_docs=4).collect()
    assert all(x.component_id == x.doc_id for x in got) and len(got) == 600
    assert hot == [0]


def test_t_occurrence_equals_counting():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 40))).astype(np.uint64) for _ in range(80)]
    keys = np.concatenate(sets)
    lists = np.repeat(np.arange(80), [len(s) for s in sets])
    order = np.argsort(keys, kind="stable")
    sizes = np.array([len(s) for s in sets])
    for share in (30, 60, 75):
        for q in sets:
            want = [i for i, s in enumerate(sets) if 100 * (o := len(np.intersect1d(q, s))) >= share * (len(q) + len(s) - o)]
            assert jj.t_occurrence(q, keys[order], lists[order], sizes, share).tolist() == want


def test_join_of_awkward_rows(awkward, empty_docs):
    got = jj.similar_documents(awkward).collect()
    assert len(got) == awkward.count()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.n_shingles, r.component_id))
    assert by[3] == {(0, 3)} and by[4] == {(0, 4)} and by[5] == {(0, 5)} and by[7] == {(1, 7)}
    assert {c for _, c in by[11] | by[10]} == {10}
    assert all(c is None for _, c in by[None])
    kept = jj.one_of_each(awkward)
    assert kept.schema == awkward.schema
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == sorted(map(str, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None, None]))
    assert jj.similar_documents(empty_docs).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}


def plain_overlaps(docs, items, n=10):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t))
        size = min(n, len(w))
        for p in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[p : p + size])].add(i)
    out = []
    for i, t in docs:
        w = ALNUM.findall(low(t))
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for p in range(len(w) - size + 1):
                if (g := tuple(w[p : p + size])) in windows:
                    hit.update(range(p, p + size))
                    found |= {str(x) for x in windows[g] if x is not None}
        out.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_overlaps_with_few_words(spark, awkward, empty_docs):
    r = random.Random(3)
    few = ["a", "b", "c"]  # few words: many hashes are equal and runs overlap
    items = [(i, " ".join(r.choice(few) for _ in range(r.randint(0, 25)))) for i in range(12)]
    items += [(90, "x y z"), (91, "X-y, z"), (None, "only null id item words here"), (92, None), (93, items[0][1])]
    docs = []
    for i in range(150):
        w = [r.choice(few + ["q"]) for _ in range(r.randint(0, 60))]
        if r.random() < 0.4:
            w[5:5] = (r.choice(items)[1] or "").split()
        docs.append((i, " ".join(w)))
    docs += [(500, "x Y z only NULL id item words here"), (None, "x y z"), (501, None), (10, "x y z"), (10, "x y z")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    t = spark.createDataFrame(items, "item_id long, text string")
    want = plain_overlaps(docs, items)
    for words in (1_000_000, 20):  # one block, and many
        got = dc.overlap_digest(dc.find_overlaps(d, t, block_words=words)).collect()
        assert sorted((str(x.doc_id), *x[1:]) for x in got) == want
    kept = dc.drop_contaminated(d, t, block_words=20)
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(x[0] for x in want if not x[-1])
    assert dc.drop_contaminated(awkward, t).schema == awkward.schema
    own = awkward.select("doc_id", "text").collect()
    got = dc.overlap_digest(dc.find_overlaps(awkward, t)).collect()
    assert sorted((str(x.doc_id), *x[1:]) for x in got) == plain_overlaps([tuple(x) for x in own], items)
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_overlaps(d, none).filter("size(spans) > 0").count() == 0
    assert dc.find_overlaps(empty_docs, t).count() == 0


def test_windows_are_cartesian_nodes():
    r = np.random.default_rng(3)
    for _ in range(100):
        counts = r.integers(0, 40, 4)
        h = r.integers(1, 2**63, int(counts.sum()), dtype=np.uint64)
        width = int(r.integers(2, 9))
        got = set(zip(*[x.tolist() for x in ps.compact_windows(h, counts, width, 1)]))
        want, base = set(), 0
        for row, n in enumerate(counts):
            g = (ps.mix(h[base : base + n] ^ ps.mix(np.full(1, 1, np.uint64))) >> np.uint64(28)).tolist()
            base += n
            for c in range(n):
                left, right = c, c
                while left > 0 and g[left - 1] > g[c]:
                    left -= 1
                while right < n - 1 and g[right + 1] > g[c]:
                    right += 1
                if right - left + 1 >= width:
                    want.add((row, left, c, right))
        assert got == want


def test_planted_passages_are_found(spark, awkward, empty_docs):
    r = random.Random(9)
    vocabulary = [f"v{i}" for i in range(3_000)]
    draw = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passages = [draw(r.randint(52, 90)) for _ in range(8)]
    texts, want = {}, {}
    for i in range(120):
        w = draw(r.randint(0, 200))
        if i % 4 == 0:
            p = passages[(i // 4) % 8]
            at = r.randint(0, len(w))
            want[i] = (at, at + len(p))
            w[at:at] = p
        texts[i] = " ".join(w)
    near = edited(r, passages[0], vocabulary, 0.0)
    near[30] = "other"  # five of about eighty shingles differ
    texts[200] = " ".join(draw(50) + near + draw(50))
    texts[300] = texts[301] = " ".join(draw(70))  # exact copies
    texts[302] = texts[303] = " ".join(draw(40))  # too short
    docs = spark.createDataFrame([*texts.items(), (400, None), (None, texts[300])], "doc_id long, text string").repartition(5)
    got = defaultdict(list)
    for x in ps.repeated_passages(docs).collect():
        got[x.doc_id].append((x.start_word, x.start_word + x.n_words, x.first_doc_id))
    assert set(got) == set(want) | {200, 300, 301}
    for i, (a, b) in want.items():
        assert [(s, e) for s, e, _ in got[i]] == [(a, b)]
    assert got[300] == got[301] == [(0, 70, 300)]
    own = ps.repeated_passages(awkward).collect()
    assert {x.doc_id for x in own} == {1, 2, 10, 11}
    assert ps.repeated_passages(empty_docs).count() == 0


def test_repeats_behind_a_first_window_that_fails(spark):
    """Passages put together from frequent lines, and longer ones around shorter ones, against brute force."""
    r = random.Random(21)
    vocabulary = [f"v{i}" for i in range(3_000)]
    draw = lambda n: [r.choice(vocabulary) for _ in range(n)]
    texts = {}
    for _ in range(10):
        whole = draw(75)
        for a in range(0, 60, 10):  # smaller ids hold every shingle, but too few in a row
            for _ in range(6):
                texts[len(texts)] = draw(60) + whole[a : a + 20] + draw(60)
        texts[1_000 + len(texts)] = draw(60) + whole[:55] + draw(60)
        for _ in range(3):
            texts[2_000 + len(texts)] = draw(r.randint(0, 80)) + whole + draw(r.randint(0, 80))
        texts[len(texts)] = draw(20) + (twice := draw(60)) + draw(40) + twice  # both places of the smallest id
        texts[len(texts)] = draw(30) + twice + draw(10)
    holders = defaultdict(set)
    for i, w in texts.items():
        for j in range(len(w) - 49):
            holders[tuple(w[j : j + 50])].add(i)
    want = {(i, j) for i, w in texts.items() for j in range(len(w) - 49) if len(holders[tuple(w[j : j + 50])]) > 1}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(3)
    got = {(x.doc_id, j) for x in ps.repeated_passages(docs).collect() for j in range(x.start_word, x.start_word + x.n_words - 49)}
    assert want <= got
    assert {i for i, _ in got} == {i for i, _ in want}
    at, left = ps.linked_runs([{"l": 3, "r": 120}], [{"start": 10, "end": 70}, {"start": 40, "end": 90}], 5, 46, 200)
    assert at.tolist() == [*range(3, 76)] and at[left].tolist() == [*range(3, 10), *range(41, 76)]


def test_only_keys_of_three_documents_are_compared_again():
    """The runs of two documents that were linked with each other are not keyed once more."""
    key = np.array([7, 7, 9, 9, 9, 9], np.uint64)
    doc = np.array([2, 1, 3, 1, 2, 3])
    l, c, r = (np.array(x, np.int32) for x in ([0, 0, 10, 0, 0, 400], [50, 60, 100, 20, 60, 450], [90, 99, 300, 99, 90, 500]))
    links, more = ps.starred(key, doc, l, c, r, np.ones(6, np.uint8), 46)
    assert sorted(zip(links[0].tolist(), links[4].tolist())) == [(2, 1), (2, 1), (3, 1), (3, 1)]
    assert sorted(zip(*(x.tolist() for x in more))) == [(1, 0, 65), (2, 15, 90), (3, 55, 145), (3, 405, 495)]
    x, y = np.array([5, 6, 5], np.uint32), np.array([6, 5], np.uint32)  # the same shingle in another row does not count
    assert ps.shared(x, np.array([0, 0, 1]), y, np.array([0, 1])).tolist() == [False, True, True]


def bag(t):
    w = SPACED.findall(low(t))
    return Counter(zip(w, w[1:])) if len(w) > 1 else Counter(w)


def test_likeness_is_generalised_jaccard():
    r = random.Random(4)
    gaps = []
    for _ in range(120):
        words = [f"t{r.randint(0, 12)}" for _ in range(150)]
        a, b = " ".join(words), " ".join(edited(r, words, ["t1", "x"], r.random()))
        p = fp.fingerprints(pa.array([a, b]))
        x, y = bag(a), bag(b)
        gaps.append(fp.likeness(p[:1], p[1:])[0] - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.09


def test_fingerprints_do_not_depend_on_the_batch(monkeypatch):
    r = random.Random(6)
    texts = pa.array([" ".join(f"t{r.randint(0, 99)}" for _ in range(r.choice([0, 1, 5, 400]))) for _ in range(40)])
    whole = fp.fingerprints(texts)
    monkeypatch.setattr(fp, "TERMS", 37)
    assert (fp.fingerprints(texts) == whole).all()
    assert all((fp.fingerprints(texts.slice(i, 1)) == whole[i]).all() for i in range(40))


def test_next_document_across_ranges(spark, awkward, empty_docs):
    rows = awkward.select("doc_id", "text").collect()
    rows = sorted(((r.doc_id, r.text or "") for r in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []
    for i, (d, t) in enumerate(rows):
        u, k = rows[(i + 1) % len(rows)][1], len(t) // 2
        want.append((str(d), len(t), hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest()))
    got = fp.compared_with_next(awkward).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    one = spark.createDataFrame([(4, "a lone text here")], "doc_id long, text string")
    r = fp.compared_with_next(one).first()
    assert r.near_next == 1 and r.edited_sha256 == hashlib.sha256(b"a lone ta lone t").hexdigest()
    assert fp.compared_with_next(empty_docs).count() == 0
