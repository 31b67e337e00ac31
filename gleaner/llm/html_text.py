"""Main text of web pages by a linear-chain conditional random field.

A page is cut into leaf blocks; each has features of its ancestors' tags and
names and of its text. The field has two labels, article or not, a weight per
feature and label, and weights for neighbouring labels; it is trained in numpy
on labelled pages by the gradient of the log-likelihood (forward-backward), and
the best labelling of each page is decoded by Viterbi over whole batches.

Defined results: null or empty html gives an empty text; unclosed tags, stray
end tags and broken attributes are read as browsers do; character references
are decoded; other columns are ignored; repeated rows are rows.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.html_blocks import block_features, labelled_pages, leaf_blocks
from gleaner.llm.words import slices
from gleaner.session import ship_package

TRAINING_PAGES = 600
CELLS = 2_000_000  # blocks times pages decoded at once


@dataclass
class CRF:
    number: dict[str, int]  # feature -> row of weights
    weights: np.ndarray  # feature x label
    moves: np.ndarray  # label x next label
    ends: np.ndarray  # first or last block x label


def _padded(lengths: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores as page x place x label, and which places are real."""
    mask = np.arange(int(lengths.max(initial=0))) < lengths[:, None]
    out = np.zeros((*mask.shape, 2))
    out[mask] = score
    return out, mask


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def train_field(pages: list[tuple[list, list[int]]], steps: int = 200, rate: float = 0.1, ridge: float = 3e-4) -> CRF:
    lists = [f for blocks, _ in pages for f in block_features(blocks)]
    number = {f: i for i, f in enumerate(sorted({f for own in lists for f in own}))}
    lengths = np.array([len(b) for b, _ in pages])
    truth = np.concatenate([y for _, y in pages]).astype(int)
    rows = np.repeat(np.arange(len(lists)), [len(f) for f in lists])
    cols = np.array([number[f] for own in lists for f in own])
    page, place = np.repeat(np.arange(len(pages)), lengths), np.concatenate([np.arange(n) for n in lengths])
    last = place == lengths[page] - 1
    w, moves, ends = np.zeros((len(number), 2)), np.zeros((2, 2)), np.zeros((2, 2))
    state = [np.zeros_like(x) for x in (w, w, moves, moves, ends, ends)]
    pair = ~last
    for step in range(1, steps + 1):
        score = np.stack([np.bincount(rows, w[cols, y], len(lists)) for y in (0, 1)], 1)
        score[place == 0] += ends[0]
        score[last] += ends[1]
        s, mask = _padded(lengths, score)
        t = s.shape[1]
        a, b = s.copy(), np.zeros_like(s)
        for i in range(1, t):
            a[:, i] = s[:, i] + _log_sum(a[:, i - 1, :, None] + moves, 1)
        for i in range(t - 2, -1, -1):
            nxt = _log_sum(moves + (s[:, i + 1] + b[:, i + 1])[:, None, :], 2)
            b[:, i] = np.where(mask[:, i + 1, None], nxt, 0)
        norm = _log_sum(a[np.arange(len(pages)), lengths - 1], 1)
        one = np.exp(a + b - norm[:, None, None])[mask]  # marginal of each block
        both = np.exp(a[:, :-1, :, None] + moves + (s[:, 1:] + b[:, 1:])[:, :, None, :] - norm[:, None, None, None])
        both = (both * mask[:, 1:, None, None]).sum((0, 1))
        gap = one.copy()
        gap[np.arange(len(truth)), truth] -= 1
        seen = np.zeros((2, 2))
        np.add.at(seen, (truth[:-1][pair[:-1]], truth[1:][pair[:-1]]), 1)
        grads = [
            np.stack([np.bincount(cols, gap[rows, y], len(number)) for y in (0, 1)], 1) / len(pages) + ridge * w,
            (both - seen) / len(pages),
            np.stack([gap[place == 0].sum(0), gap[last].sum(0)]) / len(pages),
        ]
        for k, (x, g) in enumerate(zip((w, moves, ends), grads)):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return CRF(number, w, moves, ends)


def decode(field: CRF, lists: list[list[str]], lengths: np.ndarray) -> np.ndarray:
    """Best label of every block, page after page."""
    known = [[field.number[f] for f in own if f in field.number] for own in lists]
    rows = np.repeat(np.arange(len(known)), [len(x) for x in known])
    cols = np.array([c for own in known for c in own], np.int64)
    score = np.stack([np.bincount(rows, field.weights[cols, y], len(lists)) for y in (0, 1)], 1)
    out = np.zeros(len(lists), np.int8)
    start = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    a = 0
    while a < len(order):  # pages of like length together
        b = a + 1
        while b < len(order) and (b + 1 - a) * lengths[order[b]] <= CELLS:
            b += 1
        own = order[a:b]
        n = lengths[own]
        at = np.concatenate([np.arange(s, s + k) for s, k in zip(start[own], n)])
        s, mask = _padded(n, score[at])
        s[:, 0] += field.ends[0]
        s[np.arange(len(own)), n - 1] += field.ends[1]
        best, back = s[:, 0], np.zeros(s.shape, np.int8)
        for i in range(1, s.shape[1]):
            via = best[:, :, None] + field.moves
            back[:, i] = via.argmax(1)
            best = np.where(mask[:, i, None], via.max(1) + s[:, i], best)
        label = np.zeros(mask.shape, np.int8)
        now = best.argmax(1)
        for i in range(s.shape[1] - 1, -1, -1):
            label[:, i] = now
            if i:
                now = np.where(mask[:, i], back[np.arange(len(own)), i, now], now)
        out[at] = label[mask]
        a = b
    return out


@lru_cache(2)
def trained_field(pages: int = TRAINING_PAGES) -> CRF:
    return train_field(labelled_pages(pages))


def main_texts(field: CRF, pages: list[str]) -> list[str]:
    blocks = [leaf_blocks(p) if p else [] for p in pages]
    lengths = np.array([len(b) for b in blocks], np.int64)
    labels = decode(field, [f for b in blocks for f in block_features(b)], lengths) if lengths.sum() else np.empty(0)
    out, at = [], 0
    for own in blocks:
        out.append(" ".join(b.text for b, y in zip(own, labels[at : at + len(own)]) if y))
        at += len(own)
    return out


def _extracted(batches, shared):
    for batch in slices(batches, "html"):
        texts = main_texts(shared.value, batch.column("html").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", field: CRF | None = None) -> DataFrame:
    """``(page_id, url, text)`` of each page; no shuffle."""
    spark = pages.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(field or trained_field())
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(lambda it: _extracted(it, shared), "page_id long, url string, text string")
