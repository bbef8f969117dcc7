"""Hashes of the words of many texts at once, as arrays."""

from __future__ import annotations

import numpy as np

ODD = np.uint64(0xBF58476D1CE4E5B9)
ODD2 = np.uint64(0x94D049BB133111EB)
PLACES = np.random.default_rng(11).integers(1, 2**63, 1 << 12, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * ODD
    x = (x ^ (x >> np.uint64(27))) * ODD2
    return x ^ (x >> np.uint64(31))


# Per byte: A-Z as a-z, and whether it parts words (space and \t to \r). NUL is of a word like any other byte.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32
PARTS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(edges, hashes): the 64-bit hashes of all words in order; those of text i are hashes[edges[i]:edges[i + 1]].

    A-Z count as a-z, and words are runs of bytes other than space and \\t to \\r. Words are told apart by a random linear
    function of their bytes modulo 2**64 and their length, so unequal words collide by chance only.
    """
    data = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    solid, data = ~PARTS[data], FOLDED[data]
    before = np.concatenate(([False], solid[:-1]))
    starts = np.flatnonzero(solid & ~before)
    ends_of_text = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    edges = np.concatenate(([0], np.searchsorted(starts, ends_of_text)))
    if not len(starts):
        return edges, np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        word = np.cumsum(solid & ~before) - 1
        place = np.arange(len(data)) - starts[np.maximum(word, 0)]
        value = (data.astype(np.uint64) + np.uint64(1)) * PLACES[place & 4095] + (place >> 12).astype(np.uint64) * ODD2
        value[~solid] = 0
        size = np.add.reduceat(solid, starts, dtype=np.uint64)
        return edges, mix(mix(np.add.reduceat(value, starts)) + size * ODD)


def follow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, by its first word; the last ``width`` - 1 places hold shorter runs' rubbish."""
    with np.errstate(over="ignore"):
        total = hashes.copy()
        for k in range(1, width):
            total[:-k] = total[:-k] + mix(hashes[k:] + np.uint64(k) * ODD2)
        return mix(total)
