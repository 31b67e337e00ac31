"""Language models and token shards."""
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm import language_id as li
from gleaner.llm import token_ids as ti

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def plain_kn(train: dict[str, list[str]], lang: str, text: str) -> float:
    """Interpolated Kneser-Ney by the formulas, one character at a time."""
    n = li.ORDER
    edge = "\x02" * (n - 1)

    def norm(t):
        out = ""
        for ch in t:
            ch = ch.lower()[0] if ch.isalpha() else " "
            if ch != " " or not out.endswith(" "):
                out += ch
        return edge + out

    counts = [dict() for _ in range(n + 1)]
    for t in train[lang]:
        s = norm(t)
        for i in range(n - 1, len(s)):
            g = s[i - n + 1 : i + 1]
            counts[n][g] = counts[n].get(g, 0) + 1
    for k in range(n - 1, 0, -1):
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
    chars = set()
    for ts in train.values():
        for t in ts:
            chars |= set(norm(t)[n - 1 :])

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / (len(chars) + 1)
        own = {x: c for x, c in counts[k].items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        once, twice = (sum(c == m for c in counts[k].values()) for m in (1, 2))
        d = once / (once + 2 * twice) if once else 0.5
        total = sum(own.values())
        return max(own.get(g, 0) - d, 0) / total + d * len(own) / total * p(g[1:])

    s = norm(text)
    return -sum(np.log(p(s[i - n + 1 : i + 1])) for i in range(n - 1, len(s))) / (len(s) - n + 1)


def test_entropies_follow_the_formulas(spark):
    train = {"aa": ["abra cadabra abra", "Abrac"], "bb": ["hocus pocus", "hoc hoc 12 po"]}
    rows = [(k, t) for k, v in train.items() for t in v]
    models = li.train_models(spark.createDataFrame(rows, "lang string, text string"))
    texts = ["abra po", "hocus! x", "zzz", "a", "abra  cadabra"]
    got, letters = models.entropies(pa.array(texts))
    want = [[plain_kn(train, lang, t) for lang in ("aa", "bb")] for t in texts]
    assert np.allclose(got, want, atol=1e-4)
    assert letters.tolist() == [6, 6, 3, 1, 11]


def test_long_texts_go_in_segments(monkeypatch, spark):
    rows = [("en", "the cat sat on the mat " * 20), ("de", "der hund und die katze " * 20)]
    models = li.train_models(spark.createDataFrame(rows, "lang string, text string"))
    texts = pa.array(["the cat and der hund " * 30, "a", "die"])
    whole, _ = models.entropies(texts)
    monkeypatch.setattr(li, "SEGMENT", 7)
    parts, _ = models.entropies(texts)
    assert np.allclose(whole, parts, atol=1e-4)


def test_identifies_awkward_rows(awkward):
    got = li.identified(awkward, F.lit(True)).collect()
    assert len(got) == awkward.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [by[i][0].best for i in (1, 2, 6, 8, 9)] == ["en", "en", "de", "es", "es"]
    for i in (3, 4, 5):
        assert (by[i][0].best, by[i][0].score, by[i][0].rejected) == ("und", 0.0, True)
    assert all(0 <= r.score <= 1 for r in got)


def test_without_training_or_rows(awkward, empty_docs):
    assert {r.best for r in li.identified(awkward, F.lit(False)).collect()} == {"und"}
    assert li.identified(empty_docs, F.lit(True)).count() == 0


def test_a_small_model_still_tells_languages(awkward):
    models = li.train_models(awkward, cells=4_000)
    assert len(models.grams[-1].keys) <= 4_000
    got = {r.doc_id: r.best for r in li.identify(awkward, models).collect()}
    assert [got[i] for i in (1, 8)] == ["en", "es"]


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 3_000])
def test_boundaries_in_little_space(n):
    r = np.random.default_rng(n)
    ends = np.cumsum(r.integers(0, 700, n) * (r.random(n) < 0.8))
    ids = np.arange(int(ends[-1]) if n else 0, dtype=np.uint32) % 60_000
    blob = ti.pack_shard(ends, ids)
    bounds, back = ti.unpack_shard(blob)
    assert bounds.all().tolist() == ends.tolist() == [bounds[i] for i in range(n)]
    assert (back == ids).all() and back.dtype == np.uint16
    if n > 200:
        bits = 8 * (len(blob) - 2 * len(ids))
        assert bits / n < 3 + np.log2(len(ids) / n + 2) + 2


def test_large_ids_take_32_bits():
    _, ids = ti.unpack_shard(ti.pack_shard(np.array([2]), np.array([1, 70_000])))
    assert ids.tolist() == [1, 70_000]


def test_pieces_never_cut_a_token():
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    mine = ti.Encoder(PATH, limit=50)
    r = random.Random(1)
    marks = ["a", "é", "×", "ß", "don't", " ", "  ", "\n", "\r\n", "\t", ".", ",", "!?", "...", "1", "23", "\x1c", "\x85", "\xa0", "　", "日本", "𝒳", "<|endoftext|>", "'s", " '", "\x00"]
    texts = ["", " ", *("".join(r.choice(marks) for _ in range(r.randint(1, 25))) for _ in range(800))]
    ids, ends = mine.encode(pa.array(texts))
    start = 0
    for t, e in zip(texts, ends.tolist()):
        assert ids[start:e].tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)
        start = e


def test_kept_pieces_take_little_memory():
    import tracemalloc

    mine = ti.Encoder(PATH)
    texts = pa.array([" ".join(f"w{i:05}x" for i in range(a, a + 500)) for a in range(0, 40_000, 500)])
    tracemalloc.start()
    for a in range(0, len(texts), 4):
        mine.encode(texts.slice(a, 4))
    kept = tracemalloc.get_traced_memory()[0] - 4 * len(mine.ids)
    tracemalloc.stop()
    assert len(mine.known) >= 40_000 and kept < 64 * len(mine.known)
    assert (np.diff(mine.known) > 0).all()


def test_shards_read_back(awkward, empty_docs):
    plain = Tokenizer.from_file(PATH)
    rows = awkward.select("doc_id", "text").collect()
    folder = ti.shared_folder(awkward.sparkSession)
    got = ti.read_tokens(ti.write_tokens(awkward, folder, PATH, 2, shard_ids=100), folder).orderBy("start").collect()
    assert len(got) == len(rows)
    key = lambda i: (i is not None, i or 0)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in rows), key=key)
    at, seen = 0, []
    for r in got:
        assert r.start == at
        at += r.n_tokens
        seen.append((str(r.doc_id), r.n_tokens, r.ids_crc32))
    want = []
    for r in rows:
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((str(r.doc_id), len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(seen) == sorted(want)
    assert ti.tokenized(empty_docs, PATH).count() == 0


def test_every_training_text_calibrates(spark):
    from gleaner.llm import language_id

    rng = np.random.default_rng(8)
    rows = [(lang, " ".join(rng.choice(words.split(), 6))) for lang, words in (
        ("a", "lorem ipsum dolor sit amet"), ("b", "wir gehen heute noch einmal")) for _ in range(300)]
    df = spark.createDataFrame(rows, "lang string, text string")
    models = language_id.train_models(df)
    for i, lang in enumerate(models.langs):
        own = [t for x, t in rows if x == lang]
        entropy, _ = models.entropies(pa.array(own))
        exact = np.quantile(entropy[:, i], 0.999, method="higher")
        assert 0 <= models.limits[i] / 1.1 - exact <= 0.0011
    shared = type("Shared", (), {"value": models})
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows]), pa.array([t for _, t in rows])], names=["lang", "text"])
    (seen,) = language_id._calibration([batch], shared)
    assert sum(r["n"] for r in seen.to_pylist() if r["lang"] >= 0) == len(rows)


def test_rare_long_grams_stay_in_a_small_model(spark, awkward, monkeypatch):
    """Beyond ``cells`` the rarest longest n-grams went, and texts backed off to shorter ones."""
    r = random.Random(8)
    rows = [(lang, "".join(r.choice("abcde ") for _ in range(400))) for lang in ("x", "y") for _ in range(6)]
    train = spark.createDataFrame(rows, "lang string, text string")
    texts = [(i, t[:200] if i % 3 else t[100:] + " b") for i, (_, t) in enumerate(rows)] + [(50, None), (51, ""), (50, rows[0][1])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    whole, small = li.train_models(train), li.train_models(train, cells=4_000)
    assert not whole.rest and len(small.rest) > 1
    grams = [whole.grams[-1].keys[:-1], *(p.grams[-1].keys[:-1] for p in (small, *(b.value for b in small.rest)))]
    assert sorted(np.concatenate(grams[1:]).tolist()) == grams[0].tolist() and all(len(g) <= 1_000 for g in grams[1:])
    rows_of = lambda m: sorted((x.doc_id, x.best, round(x.entropy, 6), round(x.score, 6), x.rejected) for x in li.identify(docs, m).collect())
    assert rows_of(whole) == rows_of(small)
    assert np.allclose(whole.limits, small.limits) and whole.temperature == small.temperature
