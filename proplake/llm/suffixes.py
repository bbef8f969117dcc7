"""Suffix sort with hash comparisons, over many short suffixes at once.

Prefix sums of a polynomial hash give the hash of any substring. The longest common extension of two suffixes is found by
binary search for the longest prefixes with equal hashes, so a comparison takes a logarithmic number of steps. A bottom-up
mergesort places every element of a run by binary search in its sister run. Afterwards all neighbours are compared byte by
byte: a hash collision shows there, and its group is sorted by bytes instead.
"""

from __future__ import annotations

import numpy as np

from proplake.llm.hashing import mix

BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Powers:
    """Powers of the base and of its inverse modulo 2 ** 64, as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            while len(self.up) < n:
                width = len(self.up)
                self.up = np.concatenate((self.up, self.up * np.uint64(pow(BASE, width, 1 << 64))))
                self.down = np.concatenate((self.down, self.down * np.uint64(pow(INVERSE, width, 1 << 64))))
        return self.up[:n], self.down[:n]


POWERS = Powers()


class PrefixHash:
    """Hashes of substrings of ``data``; equal substrings have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray):
        up, self.down = POWERS.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(SYMBOLS[data] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[start]) * self.down[start]


def common_extension(hashes: PrefixHash, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Longest common prefix of the suffixes at ``a`` and at ``b``, ``most`` at the most."""
    low, high = np.zeros(len(a), dtype=np.int64), most.astype(np.int64)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high + 1) >> 1
        same = hashes.of(a, a + middle) == hashes.of(b, b + middle)
        low = np.where(open_ & same, middle, low)
        high = np.where(open_ & ~same, middle - 1, high)


def _precedes(data: np.ndarray, hashes: PrefixHash, start: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray, ties: bool) -> np.ndarray:
    """Whether suffix ``a`` comes before ``b``; ``ties``: what counts for equal ones. A prefix comes before what it begins."""
    most = np.minimum(length[a], length[b])
    extension = common_extension(hashes, start[a], start[b], most)
    whole = extension == most
    at_a, at_b = data[(start[a] + extension).clip(0, len(data) - 1)], data[(start[b] + extension).clip(0, len(data) - 1)]
    by_length = (length[a] <= length[b]) if ties else (length[a] < length[b])
    return np.where(whole, by_length, at_a < at_b)


def _byte_rows(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """One padded row of bytes + 1 per suffix; 0 beyond its end."""
    width = int(length.max()) if len(length) else 0
    place = np.arange(width)
    inside = place < length[:, None]
    return np.where(inside, data[(start[:, None] + place).clip(0, max(0, len(data) - 1))].astype(np.int16) + 1, 0)


def sort_suffixes(data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): suffixes data[start:start + length] sorted inside each run of equal ``group`` (ascending), and how many
    bytes each shares with the one before it in the order; -1 where a group begins."""
    n = len(start)
    order = np.arange(n)
    if not n:
        return order, np.zeros(0, np.int64)
    hashes = PrefixHash(data)
    edges = np.append(np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))), n)
    size = np.repeat(np.diff(edges), np.diff(edges))
    first = np.repeat(edges[:-1], np.diff(edges))
    width = 1
    while width < size.max():
        live = np.flatnonzero(size > width)
        inside = live - first[live]
        run = inside // width
        left = run % 2 == 0
        sister = first[live] + (run + np.where(left, 1, -1)) * width
        until = np.minimum(sister + width, first[live] + size[live])
        low, high = np.minimum(sister, until), until.copy()
        base = low.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            own, probe = order[live[open_]], order[middle]
            # a left element goes before equal right ones
            for side in (True, False):
                part = np.flatnonzero(left[open_] == side)
                if len(part):
                    before = _precedes(data, hashes, start, length, probe[part], own[part], ties=not side)
                    k = open_[part]
                    low[k] = np.where(before, middle[part] + 1, low[k])
                    high[k] = np.where(before, high[k], middle[part])
        own_run = first[live] + (run - np.where(left, 0, 1)) * width
        target = own_run + inside % width + (low - base)
        merged = order.copy()
        merged[target] = order[live]
        order = merged
        width *= 2
    common = np.full(n, -1, dtype=np.int64)
    broken = np.zeros(n, dtype=bool)
    for a in range(0, n, 1 << 15):  # byte rows of bounded size
        rows = _byte_rows(data, start[order[max(0, a - 1):a + (1 << 15)]], length[order[max(0, a - 1):a + (1 << 15)]])
        differ = rows[1:] != rows[:-1]
        at = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        pick = np.minimum(at, rows.shape[1] - 1)
        place = np.arange(len(at))
        wrong = (at < rows.shape[1]) & (rows[1:][place, pick] < rows[:-1][place, pick])
        where = np.arange(max(0, a - 1) + 1, max(0, a - 1) + 1 + len(at))
        common[where] = np.minimum(at, np.minimum(length[order[where]], length[order[where - 1]]))
        broken[where] = wrong
    begins = edges[:-1]
    common[begins] = -1
    broken[begins] = False
    for g in np.unique(np.searchsorted(edges, np.flatnonzero(broken), side="right") - 1):  # a collision misled the order
        a, b = int(edges[g]), int(edges[g + 1])
        texts = {int(i): data[start[i]:start[i] + length[i]].tobytes() for i in order[a:b]}
        order[a:b] = sorted(texts, key=texts.__getitem__)
        for k in range(a + 1, b):
            x, y = texts[int(order[k - 1])], texts[int(order[k])]
            common[k] = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    return order, common
