"""A stand-in encoder for the registered queries, with its SQL."""
from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

from gleaner.functions.vectors import summed_words


@lru_cache(1 << 17)
def _md5_place(word: str, dim: int) -> int:
    h = int(hashlib.md5(word.encode("utf-8")).hexdigest()[:8], 16)
    return h % dim * 2 + ((h >> 16) & 1)


def md5_encoder(texts: list[str], dim: int = 384) -> np.ndarray:
    """A stand-in encoder that SQL can follow: words signed and placed by their MD5."""
    return summed_words([t.split() for t in texts], lambda w: _md5_place(w, dim), dim)


def md5_entries(texts: str, words: str) -> str:
    """SQL for the entries ``(gid, place, x)`` of that encoder that are not zero."""
    return f"""(SELECT gid, h % 384 AS place, sum(CASE WHEN (h >> 16) & 1 = 1 THEN 1 ELSE -1 END)::DOUBLE AS x
  FROM (SELECT gid, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM (SELECT gid, unnest({words}) AS w FROM {texts}))
  GROUP BY ALL HAVING x <> 0)"""
