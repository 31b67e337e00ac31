import random

import numpy as np
import pytest

from gleaner.operators import similar_text, text_tiles
from gleaner.operators.text_tiles import Block, likely_pairs


def block(texts, first=0):
    return Block(np.arange(first, first + len(texts)), [t.encode("utf-32-le") for t in texts])


@pytest.mark.parametrize("alphabet, sizes", [("abcde ", (1, 60)), ("the morning αβγ你好", (200, 300)), ("abcdefgh", (1_100, 1_200))])
def test_tiles_keep_every_similar_pair(alphabet, sizes):
    rng, texts = random.Random(2), {}
    for _ in range(6):
        base = "".join(rng.choice(alphabet) for _ in range(rng.randint(*sizes)))
        cut = len(base) // 13
        moved = base[cut:] + "".join(rng.choice(alphabet) for _ in range(cut))
        longer = "".join(rng.choice(alphabet) for _ in range(cut)) + base
        few = "".join("z" if rng.random() < 0.03 else c for c in base)
        texts |= dict.fromkeys((base, moved, longer, few))
    texts = list(texts)
    want = {
        (j, i) for i in range(len(texts)) for j in range(i)
        if 2 * similar_text._common_subsequence(texts[i], texts[j]) >= 0.92 * (len(texts[i]) + len(texts[j]))
    }
    one, two = likely_pairs(block(texts), block(texts), 0.92, True)
    got = [(min(p), max(p)) for p in zip(one.tolist(), two.tolist())]
    assert want and want <= set(got) and len(got) == len(set(got))
    half = len(texts) // 2
    one, two = likely_pairs(block(texts[:half]), block(texts[half:], half), 0.92, False)
    assert {p for p in want if p[0] < half <= p[1]} <= set(zip(one.tolist(), two.tolist()))


def test_texts_over_one_phrase_stock_do_not_leave_the_tiles(spark):
    """All pieces of such texts are common; a join of pieces let most pairs of similar length meet."""
    rng = random.Random(6)
    stock = ["tion", "er", "the", "on", "an", "re", "he", "in", "ed", "nd"]
    texts = ["".join(rng.choice(stock) for _ in range(70)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "gid long, text string")
    held, spans = similar_text._blocks(df, 50)
    assert held.count() == 400 and max(r["count"] for r in held.groupBy("block").count().collect()) <= 100
    assert similar_text.candidate_pairs(df, 0.92, 50).count() == 0


def test_texts_of_like_letters_do_not_reach_the_slow_tests(monkeypatch):
    """What three characters stand in a row tells them apart; before, most of these pairs went to the tests of halves and subsequences."""
    rng, late = random.Random(7), []
    texts = ["".join(rng.sample("abcdefghijklmnop" * 20, 320)) for _ in range(120)]
    texts += [t[:150] + "z" + t[150:] for t in texts[:5]]
    halves = text_tiles._halves
    monkeypatch.setattr(text_tiles, "_halves", lambda a, b, i, *rest: late.append(len(i)) or halves(a, b, i, *rest))
    one, two = likely_pairs(block(texts), block(texts), 0.92, True)
    assert sorted((min(p), max(p)) for p in zip(one.tolist(), two.tolist())) == [(i, 120 + i) for i in range(5)]
    assert sum(late) < 100
