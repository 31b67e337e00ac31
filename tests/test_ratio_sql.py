"""The ratio written in SQL against difflib."""
import difflib
import random

import duckdb
import pytest

from gleaner.plans.ratio_sql import ratios


def texts_of(seed: int) -> list[str]:
    """Families of edited texts, on both sides of 200 characters."""
    draw = random.Random(seed)
    found = {"", "a", "aa"}
    for size in (5, 20, 60, 150, 199, 200, 210, 300):
        base = draw.choices("eeetaoinshrdluxyzé  ?", k=size)
        for _ in range(4):
            text = list(base)
            for _ in range(draw.randint(0, max(1, size // 12))):
                at = draw.randrange(len(text))
                text[at : at + draw.randint(0, 1)] = draw.choices("abcq ", k=draw.randint(0, 2))
                text = text or ["e"]
            found.add("".join(text))
    return sorted(found)


@pytest.mark.parametrize("seed, threshold", [(1, 0.92), (2, 0.92), (3, 0.8)])
def test_sql_ratio_equals_difflib(seed, threshold):
    texts = texts_of(seed)
    con = duckdb.connect()
    con.execute("CREATE TABLE nodes (gid BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO nodes VALUES (?, ?)", list(enumerate(texts)))
    sql = f"WITH RECURSIVE {ratios('nodes', threshold)} SELECT * FROM ratios"
    got = {(e, l): r for e, l, r in con.execute(sql).fetchall()}
    want = {
        (e, l): difflib.SequenceMatcher(None, texts[l], texts[e]).ratio()
        for e in range(len(texts))
        for l in range(len(texts))
        if e != l
    }
    assert got == {k: r for k, r in want.items() if r >= threshold}
    assert len(got) > 20
