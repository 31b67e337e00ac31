"""Tests of all pairs of texts of two blocks, by counts first and by subsequences last.

Texts of lengths ``la`` and ``lb`` can only reach the ratio ``t`` if at least
``needed = ceil((la + lb) * t / 2)`` characters match in order. Four bounds on
the matched characters are tested, each far cheaper per pair than the next:

1. the characters the texts share at all (counts of 32 character classes);
2. the runs of three characters they share (counts of 512 classes): matched characters
   lie in runs with an unmatched one between them, and all but two of a run start three;
3. the characters on both sides of the middle of one text, for the best place to cut
   the other one: unmatched characters bound how far that place is off;
4. the longest common subsequence (classes of characters, the first 64 ``WORDS``
   characters of one text), 64 characters at a time in a machine word.

No test loses a pair. They take blocks of rows at once, so memory follows from
the size of a block alone.
"""
from __future__ import annotations

from functools import cached_property

import numpy as np

BINS = 32
THREES = 512  # classes of three characters in a row
CLASSES = 64  # of the subsequence test; one more stands for what is behind a text
WORDS = 16
CUTS = 64  # places of a text before which its characters are counted
AT_ONCE = 256  # rows of one side compared at once, with four times as many of the other
PENDING = 100_000  # pairs of the later tests at once
FEW = 2_048  # pairs whose counts of three characters are compared at once
EPS = 1e-9
_EVEN = np.uint64(0x00FF00FF00FF00FF)
_ONE, _FULL = np.uint64(1), np.uint64(2**64 - 1)


class Block:
    """Code points of texts in order of their length."""

    def __init__(self, gids: np.ndarray, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64) // 4
        order = np.argsort(sizes, kind="stable")
        self._fill(gids[order], sizes[order], np.frombuffer(b"".join(texts[i] for i in order), np.uint32))

    def _fill(self, gids: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> None:
        self.gid, self.size, self.codes = gids, sizes, codes
        self.width = int(self.size.max(initial=0))
        self.start = np.cumsum(self.size) - self.size
        row = np.repeat(np.arange(len(sizes)), self.size)
        at = np.arange(len(self.codes)) - self.start[row]
        kind = self.codes % BINS
        # a count never passes the length, so bytes do for short texts
        self.kind = np.uint8 if self.width < 256 else np.uint16 if self.width < 65_536 else np.uint32
        self.step = max(4, -(-self.width // CUTS))
        self.cuts = self.width // self.step + 2
        self.counts = np.bincount(row * BINS + kind, minlength=len(sizes) * BINS).reshape(-1, BINS).astype(self.kind)
        self.row, self.at, self.bin = row, at, kind
        self.cls = ((self.codes + (self.codes >> np.uint32(5)) * np.uint32(7)) % CLASSES).astype(np.uint8)

    def take(self, rows: np.ndarray) -> Block:
        """A block of some of the rows, in the same order."""
        out, size = Block.__new__(Block), self.size[rows]
        at = np.repeat(self.start[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        out._fill(self.gid[rows], size, self.codes[at])
        return out

    @cached_property
    def threes(self) -> np.ndarray:
        """Counts of three characters in a row, ``(rows, THREES)``; bytes where these do."""
        n = len(self.size)
        out = np.zeros((n, THREES), self.kind)
        for low in range(0, n, AT_ONCE):
            high = min(low + AT_ONCE, n)
            a, b = int(self.start[low]), int(self.start[high - 1] + self.size[high - 1])
            own = a + np.flatnonzero(self.row[a + 2 : b] == self.row[a : max(a, b - 2)])
            kind = self.codes[own].astype(np.uint64)
            for step in (1, 2):
                kind = kind * np.uint64(0x9E3779B97F4A7C15) + self.codes[own + step]
            kind = (kind * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - THREES.bit_length() + 1)
            place = (self.row[own] - low) * THREES + kind.astype(np.int64)
            out[low:high] = np.bincount(place, minlength=(high - low) * THREES).reshape(-1, THREES)
        return out if out.max(initial=0) > 255 else out.astype(np.uint8)

    def before(self) -> np.ndarray:
        """Counts before every ``step``-th place, ``(rows, cuts, BINS)``."""
        n = len(self.size)
        out = np.empty((n, self.cuts, BINS), self.kind)
        for low in range(0, n, AT_ONCE):
            high = min(low + AT_ONCE, n)
            held = slice(int(self.start[low]), int(self.start[high - 1] + self.size[high - 1]))
            place = ((self.row[held] - low) * self.cuts + self.at[held] // self.step + 1) * BINS + self.bin[held]
            parts = np.bincount(place, minlength=(high - low) * self.cuts * BINS)
            np.cumsum(parts.reshape(high - low, self.cuts, BINS), 1, out=out[low:high], dtype=self.kind)
        return out

    def heads(self, lengths: np.ndarray) -> np.ndarray:
        """Counts of the first so many characters of each text."""
        held = self.at < lengths[self.row]
        return np.bincount(self.row[held] * BINS + self.bin[held], minlength=len(self.size) * BINS).reshape(-1, BINS).astype(self.kind)

    def padded(self, width: int) -> np.ndarray:
        out = np.full((len(self.size), width), CLASSES, np.uint8)
        held = self.at < width
        out[self.row[held], self.at[held]] = self.cls[held]
        return out

    def masks(self, low: int, high: int) -> np.ndarray:
        """Where each class occurs in the rows from ``low`` to ``high``, as bits."""
        words = min(WORDS, max(1, -(-int(self.size[low:high].max(initial=0)) // 64)))
        out = np.zeros((high - low, CLASSES + 1, words), np.uint64)
        a, b = int(self.start[low]), int(self.start[high - 1] + self.size[high - 1])
        held = a + np.flatnonzero(self.at[a:b] < words * 64)
        at = self.at[held].astype(np.uint64)
        np.bitwise_or.at(out, (self.row[held] - low, self.cls[held], at >> np.uint64(6)), _ONE << (at & np.uint64(63)))
        return out


def needed(la: np.ndarray, lb: np.ndarray, threshold: float) -> np.ndarray:
    """Least number of matched characters; no more than ``(1 - threshold)`` of all are left out."""
    total = la + lb
    return (total - np.floor(total * (1 - threshold) + EPS).astype(np.int64) + 1) // 2


def _bins(block: Block, kind: type) -> np.ndarray:
    """Counts by class, one row a class. What passes the type of the shorter texts is never the smaller count."""
    return np.ascontiguousarray(np.minimum(block.counts, np.iinfo(kind).max).astype(kind).T)


def _shared(mine: np.ndarray, theirs: np.ndarray, out: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Characters shared by each row of both ranges, in the smaller type: no more than the shorter text has."""
    out, least = out[: mine.shape[1], : theirs.shape[1]], least[: mine.shape[1], : theirs.shape[1]]
    out[:] = 0
    for x, y in zip(mine, theirs):
        np.minimum(x[:, None], y[None, :], out=least)
        out += least
    return out


def _sums(counts: np.ndarray) -> np.ndarray:
    """Sum of each row; bytes are added eight at a time."""
    if counts.dtype != np.uint8:
        return counts.sum(1, dtype=np.int64)
    words = counts.view(np.uint64)
    pairs = (words & _EVEN) + ((words >> np.uint64(8)) & _EVEN)  # four sums of 16 bits: enough for 128 words
    return sum((pairs.sum(1) >> np.uint64(16 * k)) & np.uint64(0xFFFF) for k in range(4)).astype(np.int64)


def _in_a_row(a: Block, b: Block, i: np.ndarray, j: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which pairs share enough threes: ``m`` matched characters lie in one more run than are unmatched at most."""
    ok = np.empty(len(i), bool)
    for p in range(0, len(i), FEW):
        x, y = i[p : p + FEW], j[p : p + FEW]
        both = _sums(np.minimum(a.threes[x], b.threes[y]))
        ok[p : p + FEW] = both >= 5 * least[p : p + FEW] - 2 * (a.size[x] + b.size[y]) - 2
    return ok


def _halves(a: Block, b: Block, i: np.ndarray, j: np.ndarray, least: np.ndarray, heads: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Which pairs share enough characters on both sides of some cut."""
    cut = a.size[i] // 2
    low, high = cut - (a.size[i] - least), cut + (b.size[j] - least)
    first, rest = heads[i], a.counts[i] - heads[i]
    whole, best = b.counts[j], np.zeros(len(i), np.int64)
    for t in range(int((high - low).max(initial=0)) // b.step + 2):
        place = np.clip(np.minimum(low + t * b.step, high + b.step // 2) // b.step, 0, b.cuts - 1)
        left = before[j, place]
        both = np.minimum(first, left).sum(1, dtype=np.int64) + np.minimum(rest, whole - left).sum(1, dtype=np.int64)
        best = np.maximum(best, both)
    # the nearest counted place is less than a step off; a moved character changes the sum by one at most
    return best >= least - b.step


def _subsequence(a: Block, b: Block, i: np.ndarray, j: np.ndarray, least: np.ndarray, masks: np.ndarray, low: int, codes: np.ndarray) -> np.ndarray:
    """Which pairs have a common subsequence that leaves out few enough characters of the first text."""
    words = masks.shape[2]
    flat = masks.reshape(-1, words)
    base = (i - low) * (CLASSES + 1)
    open_ = [np.full(len(i), _FULL) for _ in range(words)]
    head = np.minimum(a.size[i], 64 * words)
    # matches of the head lie before this place of the other text
    steps = int(np.minimum(b.size[j], head + b.size[j] - least).max(initial=0))
    theirs = np.ascontiguousarray(codes[j, :steps].T)
    for c in theirs:
        at = base + c
        carry = None
        for w in range(words):
            now = open_[w]
            hit = now & flat[at, w]
            total = now + hit
            over = total < now
            if carry is not None:
                total += carry
                over |= total < carry
            open_[w] = total | (now ^ hit)
            carry = over.astype(np.uint64)
    matched = np.zeros(len(i), np.int64)
    for w in range(words):
        matched += 64 - np.bitwise_count(open_[w]).astype(np.int64)
    return head - matched <= a.size[i] - least


def likely_pairs(a: Block, b: Block, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pairs of a row of ``a`` and one of ``b`` (each pair once if ``same``) that pass all tests."""
    none = np.empty(0, np.int64)
    if not len(a.size) or not len(b.size):
        return none, none
    kind = min(a.kind, b.kind, key=lambda k: np.dtype(k).itemsize)
    mine, theirs = _bins(a, kind), _bins(b, kind)
    live = mine.any(1) & theirs.any(1)
    mine, theirs = mine[live], theirs[live]
    held = [np.empty((AT_ONCE, 4 * AT_ONCE), kind) for _ in range(2)]
    apart = threshold / (2 - threshold)  # length of the shorter text to the longer one, at least
    sums = np.arange(a.width + b.width + 1)
    least_of = needed(sums, 0, threshold)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    parts = [(none, none, none)]

    def settle():
        x, y, z = (np.concatenate(c) for c in zip(*parts))
        parts[:] = [(none, none, none)]
        for p in range(0, len(x), PENDING):
            rows = np.unique(x[p : p + PENDING])
            for q in range(0, len(rows), 4 * AT_ONCE):
                own = p + np.flatnonzero(np.isin(x[p : p + PENDING], rows[q : q + 4 * AT_ONCE]))
                some, i = np.unique(x[own], return_inverse=True)
                others, j = np.unique(y[own], return_inverse=True)
                one, two, least = a.take(some), b.take(others), z[own]
                ok = _halves(one, two, i, j, least, one.heads(one.size // 2), two.before())
                i, j, least = i[ok], j[ok], least[ok]
                if len(i):
                    # a head's matches lie no further behind its end than characters of the other stay unmatched
                    codes = two.padded(min(two.width, 64 * WORDS + int(two.width * (1 - apart)) + 2))
                    ok = _subsequence(one, two, i, j, least, one.masks(0, len(some)), 0, codes)
                    found.append((one.gid[i[ok]], two.gid[j[ok]]))

    for low in range(0, len(a.size), AT_ONCE):
        high = min(low + AT_ONCE, len(a.size))
        first = int(np.searchsorted(b.size, np.floor(a.size[low] * apart - EPS)))
        last = int(np.searchsorted(b.size, np.ceil(a.size[high - 1] / apart + EPS), "right"))
        if same:
            last = min(last, high)
        for left in range(first, last, 4 * AT_ONCE):
            right = min(left + 4 * AT_ONCE, last)
            shared = _shared(mine[:, low:high], theirs[:, left:right], *held)
            # the least of the shortest texts first, then each pair's own
            at = np.flatnonzero(shared >= int(least_of[a.size[low] + b.size[left]]))
            i, j = np.divmod(at, right - left)
            have, i, j = shared[i, j], i + low, j + left
            least = least_of[a.size[i] + b.size[j]]
            own = (have >= least) & (i > j) if same else have >= least
            i, j, least = i[own], j[own], least[own]
            own = _in_a_row(a, b, i, j, least)
            i, j, least = i[own], j[own], least[own]
            parts.append((i, j, least))
            if sum(len(x[0]) for x in parts) >= PENDING:
                settle()
    settle()
    if not found:
        return none, none
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
