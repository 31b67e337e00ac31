"""Chunking strategies as array-of-string expressions, no shuffle needed."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import WS, let, strip, word_count, words

# Section names served first, in this order.
PRIORITY_SECTIONS = [
    "results", "discussion", "methods", "introduction",
    "conclusion", "background", "findings",
]

# What a heading line looks like (all capitals, numbered, or
# short and ending with a colon). Applied to one trimmed line.
HEADING = (
    rf"(?sU)\A(?:[A-Z][A-Z{WS}]{{4,}}\z"
    rf"|\p{{Nd}}+\.[\p{{Nd}}.]*[{WS}]+.+\z"
    rf"|.{{5,60}}:[{WS}]*\z)"
)


def _windows(tokens: Column, size: int, step: int, min_words: int) -> Column:
    """Overlapping word windows of a token array, short ones dropped."""
    starts = F.when(
        F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(step))
    ).otherwise(F.array().cast("array<int>"))
    slices = F.transform(starts, lambda i: F.slice(tokens, i + 1, F.lit(size)))
    return F.transform(
        F.filter(slices, lambda s: F.size(s) >= min_words), lambda s: F.array_join(s, " ")
    )


def chunk_by_word_count(
    text: Column, chunk_size: int = 500, overlap: int = 50, min_words: int = 20
) -> Column:
    step = max(chunk_size - overlap, 1)
    return let(
        words(F.coalesce(text, F.lit(""))),
        lambda w: _windows(w, chunk_size, step, min_words),
    )


def chunk_by_paragraph(text: Column, target_size: int = 500, min_words: int = 20) -> Column:
    """Merge blank-line separated paragraphs until the word target is reached."""
    paragraphs = F.transform(
        F.filter(
            F.transform(F.split(F.coalesce(text, F.lit("")), r"\n{2,}"), strip), lambda p: p != ""
        ),
        lambda p: F.struct(p.alias("text"), word_count(p).alias("n")),
    )
    start = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit(None).cast("string").alias("open"),
        F.lit(0).alias("n"),
    )

    def flushed(state: Column) -> Column:
        keep = state["open"].isNotNull() & (state["n"] >= min_words)
        return F.when(keep, F.concat(state["done"], F.array(state["open"]))).otherwise(
            state["done"]
        )

    def step(state: Column, para: Column) -> Column:
        full = state["open"].isNotNull() & (state["n"] + para["n"] > target_size)
        return F.when(
            full,
            F.struct(
                flushed(state).alias("done"), para["text"].alias("open"), para["n"].alias("n")
            ),
        ).otherwise(
            F.struct(
                state["done"].alias("done"),
                F.concat_ws("\n\n", state["open"], para["text"]).alias("open"),
                (state["n"] + para["n"]).alias("n"),
            )
        )

    return F.aggregate(paragraphs, start, step, flushed)


def split_sections(text: Column) -> Column:
    """Text cut before every heading line except a leading one."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    start = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit(None).cast("string").alias("open"),
    )

    def step(state: Column, line: Column) -> Column:
        cut = state["open"].isNotNull() & strip(line).rlike(HEADING)
        return F.when(
            cut,
            F.struct(
                F.concat(state["done"], F.array(state["open"])).alias("done"), line.alias("open")
            ),
        ).otherwise(
            F.struct(
                state["done"].alias("done"),
                F.concat_ws("\n", state["open"], line).alias("open"),
            )
        )

    return F.aggregate(
        lines, start, step, lambda s: F.concat(s["done"], F.array(s["open"]))
    )


def chunk_by_section(text: Column, target_size: int = 500, min_words: int = 20) -> Column:
    """Sections kept whole up to the target; larger ones merged by paragraph."""

    def pieces(section: Column) -> Column:
        return let(
            word_count(section),
            lambda n: F.when(
                n <= target_size, F.filter(F.array(strip(section)), lambda _: n >= min_words)
            ).otherwise(chunk_by_paragraph(section, target_size, min_words)),
        )

    return F.flatten(F.transform(split_sections(text), pieces))


STRATEGIES = {
    "word_count": lambda text, size, overlap: chunk_by_word_count(text, size, overlap),
    "paragraph": lambda text, size, overlap: chunk_by_paragraph(text, size),
    "section": lambda text, size, overlap: chunk_by_section(text, size),
}


def create_chunks(
    text: Column, strategy: str = "word_count", chunk_size: int = 500, overlap: int = 50
) -> Column:
    """Chunk with a named strategy; an unknown name means word windows."""
    return STRATEGIES.get(strategy, STRATEGIES["word_count"])(text, chunk_size, overlap)


def section_priority(name: Column) -> Column:
    """Position of the first priority word contained in a section title."""
    rank = F.lit(len(PRIORITY_SECTIONS))
    for i, key in reversed(list(enumerate(PRIORITY_SECTIONS))):
        rank = F.when(F.lower(name).contains(key), F.lit(i)).otherwise(rank)
    return rank


def chunk_article(
    full_text: Column,
    abstract: Column,
    sections: Column,
    max_words: int = 500,
    overlap: int = 50,
    min_tail: int = 50,
) -> Column:
    """Chunks of one article as ``array<struct<content, section>>``.

    Sections come in priority order; short ones stay whole, long ones become
    word windows whose short tails are skipped. Without full text and sections
    the best available content is one ``abstract`` chunk.
    """
    step = max_words - overlap
    if step < 1:
        raise ValueError("overlap must be smaller than the chunk size")
    ranked = F.array_sort(
        F.transform(
            sections,
            lambda s, i: F.struct(
                section_priority(s["name"]).alias("rank"), i.alias("at"), s["name"].alias("name"),
                s["text"].alias("text"),
            ),
        )
    )

    def of_section(s: Column) -> Column:
        texts = let(
            words(s["text"]),
            lambda w: F.when(F.size(w) <= max_words, F.array(s["text"])).otherwise(
                _windows(w, max_words, step, min_tail)
            ),
        )
        return F.transform(
            texts, lambda t: F.struct(t.alias("content"), s["name"].alias("section"))
        )

    has_full = F.coalesce(strip(full_text) != "", F.lit(False))
    best = F.coalesce(F.when(has_full, full_text), abstract, F.lit(""))
    whole = F.filter(
        F.array(F.struct(best.alias("content"), F.lit("abstract").alias("section"))),
        lambda s: s["content"] != "",
    )
    return F.when(
        has_full & (F.size(F.coalesce(sections, F.array())) > 0),
        F.flatten(F.transform(ranked, of_section)),
    ).otherwise(whole)
