import random
import re

import pytest
from pyspark.sql import functions as F

from gleaner.functions import chunking
from gleaner.functions.text import clean_text, strip, words
from gleaner.operators.chunks import chunk_articles, chunk_documents


def one(spark, text, build):
    df = spark.createDataFrame([(text,)], "t string").repartition(2)
    return df.select(build(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["a b\x1cc  d\n", "  ", "", "x", "　lead and tail\x85"])
def test_words_and_strip_split_like_unicode_whitespace(spark, text):
    assert one(spark, text, words) == text.split()
    assert one(spark, text, strip) == text.strip()


def test_clean_text_removes_furniture_and_short_results(spark):
    raw = "  Page 3 of 10 Heart\n\nfailure [1, 2] is (cid:7) common.  "
    assert one(spark, raw, clean_text) == "Heart failure  is  common."
    assert one(spark, "too short", clean_text) == ""
    assert one(spark, None, clean_text) == ""


def test_word_chunks(spark):
    def chunks(text, **kw):
        return one(spark, text, lambda c: chunking.chunk_by_word_count(c, **kw))

    assert chunks("") == []
    assert chunks("hello world") == []
    hundred = " ".join(f"word{i}" for i in range(100))
    got = chunks(hundred, chunk_size=30, overlap=5)
    assert len(got) > 1 and all(len(c.split()) <= 30 for c in got)
    sixty = chunks(" ".join(f"word{i}" for i in range(60)), chunk_size=30, overlap=10)
    assert sixty[0].split()[-10:] == sixty[1].split()[:10]


def paragraphs_by_loop(text, target, least):
    out, open_, n = [], [], 0

    def flush():
        if open_ and n >= least:
            out.append("\n\n".join(open_))

    for p in [x.strip() for x in re.split(r"\n{2,}", text) if x.strip()]:
        size = len(p.split())
        if open_ and n + size > target:
            flush()
            open_, n = [], 0
        open_.append(p)
        n += size
    flush()
    return out


def test_paragraph_chunks_match_a_loop(spark):
    rng = random.Random(2)
    texts = [
        "".join(
            rng.choice(["\n", "\n\n", "\n\n\n ", " "]) + " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 12)))
            for _ in range(20)
        )
        for _ in range(30)
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", chunking.chunk_by_paragraph(F.col("t"), 25, 5).alias("c")).collect()
    for r in rows:
        assert r["c"] == paragraphs_by_loop(r["t"], 25, 5)


def test_paragraph_sizes(spark):
    two = " ".join(["alpha"] * 100) + "\n\n" + " ".join(["beta"] * 100)
    assert len(one(spark, two, lambda c: chunking.chunk_by_paragraph(c, 120))) == 2
    assert len(one(spark, " ".join(["word"] * 50), lambda c: chunking.chunk_by_paragraph(c, 100))) == 1


def test_sections_cut_before_headings(spark):
    text = "INTRODUCTION\none two\n1.2 Methods used\nthree four\nFindings so far:\nfive six"
    got = one(spark, text, chunking.split_sections)
    assert got == ["INTRODUCTION\none two", "1.2 Methods used\nthree four", "Findings so far:\nfive six"]
    long = "HEADING\n\n" + " ".join(["a"] * 30) + "\n\n" + " ".join(["b"] * 30)
    got = one(spark, long, lambda c: chunking.chunk_by_section(c, 40, 5))
    assert len(got) == 2


def test_strategy_dispatch(spark):
    text = " ".join(["word"] * 100)
    assert len(one(spark, text, lambda c: chunking.create_chunks(c, "word_count", 30))) > 1
    assert one(spark, text, lambda c: chunking.create_chunks(c, "no such", 30)) == one(
        spark, text, lambda c: chunking.create_chunks(c, "word_count", 30)
    )


def test_article_chunks_follow_section_priority_and_share_one_index(spark):
    long = " ".join(f"w{i}" for i in range(1000))
    rows = [
        (0, "1", "First", "a " * 60, "full", [("Methods", "m text"), ("Main Results", long), ("Other", "o")]),
        (1, "2", "", "word " * 60, None, None),
    ]
    df = spark.createDataFrame(
        rows,
        "position long, pmid string, title string, abstract string, full_text string, "
        "sections array<struct<name:string,text:string>>",
    )
    got = chunk_articles(df, "p").orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in got] == list(range(len(got)))
    assert [r["section"] for r in got] == ["Main Results"] * 3 + ["Methods", "Other", "abstract"]
    assert [r["word_count"] for r in got[:3]] == [500, 500, 100]
    assert got[-1]["display_name"] == "Untitled - PMID:2"


def test_document_chunk_ids_are_reproducible(spark):
    df = spark.createDataFrame([("s", "p", "f.pdf", "word " * 700)], "source_id string, project_id string, filename string, text string")
    first = [r["chunk_id"] for r in chunk_documents(df).orderBy("chunk_index").collect()]
    assert len(set(first)) == 2
    assert first == [r["chunk_id"] for r in chunk_documents(df.repartition(3)).orderBy("chunk_index").collect()]
