"""Words of Arrow text columns as 64-bit hashes, whole batches at a time.

Every operator here reads texts inside ``mapInArrow``. Bytes are classed by a
256-entry table, so no Python string is made per word. Batches are cut into
slices of a few megabytes; a text longer than that is a slice of its own.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
STEP_BYTES = 1 << 18  # hashed at once; each byte takes some 40 bytes there
U64 = np.uint64
BYTE = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15
_SHINGLE = 0xD6E8FEB86659FD93


def _classes(separators: list[int]) -> np.ndarray:
    """Byte to lower-cased byte, 0 for separators. Only A-Z have another case here."""
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 0x20
    t[separators] = 0
    return t


# words [^\x20\x09-\x0D]+ ; a zero byte is kept as a letter of its own (0xFF is not UTF-8)
SPACED = _classes([0x20, *range(0x09, 0x0E)])
SPACED[0] = 0xFF
# words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
ALNUM = _classes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all bits (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and where each row starts and ends; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8)
    return flat, ends - ends[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces whose ``column`` holds about ``limit`` bytes at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(size, dtype=np.int64) - size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


@dataclass
class Words:
    hash: np.ndarray  # of each word
    first: np.ndarray  # row i has words first[i] up to first[i + 1]
    start: np.ndarray  # byte where each word starts
    end: np.ndarray
    low: np.ndarray  # the classed bytes

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: pa.Array, classes: np.ndarray, step: int = STEP_BYTES) -> Words:
    flat, rows = text_bytes(texts)
    low = classes[flat]
    inside = low != 0
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    edges = rows[1:-1]
    before[edges[edges < len(flat)]] = False  # a word never spans two rows
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:] & before[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    out = np.empty(len(starts), U64)
    length = ends - starts
    power = np.cumprod(np.full(int(length.max(initial=1)), BASE, U64))
    total = np.cumsum(length)
    cut = [0, *(np.flatnonzero(np.diff(total // step)) + 1).tolist(), len(starts)]
    for a, b in zip(cut, cut[1:]):
        if a < b:
            n = length[a:b]
            at = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(at, n)
            part = flat[starts[a] : ends[b - 1]]
            own = BYTE[low[starts[a] : ends[b - 1]][inside[starts[a] : ends[b - 1]]]] if len(part) else BYTE[:0]
            out[a:b] = np.add.reduceat(own * power[place], at)
    return Words(mix(out), np.searchsorted(starts, rows), starts, ends, low)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words; runs over the edge of a row are for the caller to skip."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out, at, part, size = np.zeros(n, U64), 0, hashes, 1  # part: sums over runs of `size` words
    while True:
        if k & size:
            out += part[at : at + n] * U64(pow(_SHINGLE, at, 2**64))
            at += size
        if 2 * size > k:
            return mix(out)
        part = part[:-size] + part[size:] * U64(pow(_SHINGLE, size, 2**64))
        size *= 2


def runs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes: the group of each element, and its place there."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every window of ``width`` elements."""
    have, m = 1, x
    while have < width:
        add = min(have, width - have)
        m = np.minimum(m[: len(m) - add], m[add:]) if len(m) > add else m[:0]
        have += add
    return m
