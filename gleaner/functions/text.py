"""Whitespace-exact text expressions: trimming, word splitting, cleaning."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as a Unicode-aware split sees it. Java's \s needs (?U) for that and
# lacks the four separator controls.
WS = r"\s\x1c-\x1f"
SPACES = rf"(?U)[{WS}]+"

# The same characters as a set, for trimming.
WS_CHARS = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
         0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``.

    A plain Python variable would paste the expression into every place it is
    used, inside lambdas once per array element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Trim every kind of whitespace (``trim`` alone only knows the space)."""
    return F.btrim(text, F.lit(WS_CHARS))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def words(text: Column) -> Column:
    """Whitespace-separated words, never an empty one."""
    return let(
        strip(text),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACES)),
    )


def word_count(text: Column) -> Column:
    return F.size(words(text))


def normalise_question(question: Column) -> Column:
    """The form in which questions are compared: lower case, single spaces."""
    return collapse_spaces(F.lower(question))


def clean_text(text: Column) -> Column:
    """Remove page marks, numeric citations and extraction artefacts.

    Whitespace is collapsed first, so the result is one line; a result of ten
    characters or fewer counts as page furniture and becomes empty.
    """
    flat = collapse_spaces(F.coalesce(text, F.lit("")))
    for furniture in (
        r"Page \p{Nd}+ of \p{Nd}+",
        r"\[\p{Nd}+(?:, *\p{Nd}+)*\]",
        r"\(cid:\p{Nd}+\)",
    ):
        flat = F.regexp_replace(flat, furniture, "")
    return let(F.trim(flat), lambda t: F.when(F.length(t) > 10, t).otherwise(""))
