"""Main text of pages, and the pipeline as a whole."""
import itertools

import numpy as np
import pytest

import corpus_pipeline
from gleaner.llm import html_blocks as hb
from gleaner.llm import html_text as ht
from gleaner.llm import token_ids, toxicity

SF = "/root/testdata/sf0.001"
LONG = "This is a sentence of the article, with enough words to look like prose."


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        (f"<nav><a href=/>Home</a></nav><article><h1>A title</h1><p>{LONG}</p></article><footer>&copy; us</footer>", f"A title {LONG}"),
        (f"<script>var a='</p>';</script><style>p{{}}</style><article><p>{LONG}<!-- no --></article>", LONG),
        (f"<article><p>one &amp; two&nbsp;&#33; a<br>b <b>c</b>d\n\t e.<p>{LONG}</article>", f"one & two ! a b cd e. {LONG}"),
        (f"<article><p>{LONG}</p><div class='comments'><div class='comment'><p>{LONG} I say.</p></div></div></article>", LONG),
        (f"<div id=main><p>{LONG}</p><p>{LONG}</p></div><aside><p>Read this too</p></aside><form><label>Name</label><button>Go</button></form>", f"{LONG} {LONG}"),
        (f"<article><p title='a > b' class=x>{LONG}</b></i></article></article><footer>x</footer>", LONG),
        (f"<div class='cookie-notice'>We use cookies.</div><article>{LONG}</article>", LONG),
        (f"<ARTICLE><P>{LONG}</P><SCRIPT>no</SCRIPT></ARTICLE><p class='ad'>Buy!</p>", LONG),
    ],
)
def test_article_text(page, want):
    assert ht.main_texts(ht.trained_field(), [page]) == [want]


def test_held_out_pages():
    pages = hb.labelled_pages(150, seed=99)
    got = ht.decode(ht.trained_field(), [f for b, _ in pages for f in hb.block_features(b)], np.array([len(b) for b, _ in pages]))
    truth = np.concatenate([y for _, y in pages])
    assert (got == truth).mean() > 0.99


def test_viterbi_is_the_best_labelling():
    r = np.random.default_rng(1)
    field = ht.CRF({c: i for i, c in enumerate("abc")}, r.normal(size=(3, 2)), r.normal(size=(2, 2)), r.normal(size=(2, 2)))
    lengths = np.array([3, 0, 5, 1])
    lists = [list(r.choice(list("abcz"), r.integers(0, 3))) for _ in range(9)]

    def score(own, y):
        s = sum(field.weights[field.number[f], y[i]] for i, fs in enumerate(own) for f in fs if f in field.number)
        return s + field.ends[0, y[0]] + field.ends[1, y[-1]] + sum(field.moves[a, b] for a, b in zip(y, y[1:]))

    want, at = [], 0
    for n in lengths:
        own = lists[at : at + n]
        at += n
        if n:
            want += max(itertools.product((0, 1), repeat=int(n)), key=lambda y: score(own, y))
    assert ht.decode(field, lists, lengths).tolist() == want


def test_pages_table(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", 1), (1, "u", f"<article><p>{LONG}</p></article>", 1), (2, None, None, 2), (None, "v", "", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted((str(r.page_id), str(r.url), r.text) for r in ht.extract(pages).collect())
    assert got == sorted([("1", "u", LONG), ("1", "u", LONG), ("2", "None", ""), ("None", "v", "")])
    assert ht.extract(pages.limit(0)).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF).persist())
        if name != "token_ids":
            assert seen[-1].columns == docs.columns
    ids = [[r.doc_id for r in d.select("doc_id").collect()] for d in seen]
    assert set(ids[0]) >= set(ids[1]) >= set(ids[2]) >= set(ids[3]) == set(ids[4]) | set(ids[3])
    assert len(ids[3]) == len(set(ids[3])) and sorted(ids[5]) == sorted(ids[4])
    assert max(ids[4].count(i) for i in set(ids[4])) <= 2
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, model).filter("score >= 0.7").collect()}
    assert set(ids[0]) - set(ids[1]) == toxic
    want = token_ids.tokenized(seen[4], corpus_pipeline.tokenizer_path()).collect()
    assert sorted(map(tuple, seen[5].collect())) == sorted(map(tuple, want))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, want))


def test_pipeline_of_awkward_and_empty_rows(spark, awkward, empty_docs):
    own = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (own, empty_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF).persist()
            docs.count()
