"""Document fingerprints from locally consistent parsing.

Deterministic coin tossing turns neighbouring symbols into small labels that differ from each other; local maxima of the
labels start the phrases, whose hashes are the symbols of the next level. A phrase depends on a few symbols around it only,
so equal substrings are parsed alike inside, whatever stands before them. A fingerprint holds the smallest phrase names of
the upper levels, as a bottom-k sketch.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from proplake.llm.batches import pieces
from proplake.llm.ordered import in_runs

SKETCH = 48
FIRST_LEVEL = 3  # phrases of about 20 bytes and more
ODD = np.uint64(0xBF58476D1CE4E5B9)
ODD2 = np.uint64(0x94D049BB133111EB)
PLACES = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def _toss_table(bits: int) -> np.ndarray:
    """table[left << bits | own]: twice the lowest bit in which both differ, plus that bit of ``own``; 2 * bits if equal."""
    left, own = np.meshgrid(np.arange(1 << bits), np.arange(1 << bits), indexing="ij")
    differ = left ^ own
    lowest = np.where(differ == 0, bits, np.log2(np.maximum(differ & -differ, 1)).astype(int))
    return (2 * lowest + np.where(differ == 0, 0, own >> lowest & 1)).astype(np.uint16).ravel()


FROM_8, FROM_5, FROM_4 = _toss_table(8), _toss_table(5), _toss_table(4)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * ODD
    x = (x ^ (x >> np.uint64(27))) * ODD2
    return x ^ (x >> np.uint64(31))


def _shifted(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The left neighbour of each symbol; 0 at the start of a document."""
    left = np.empty_like(x)
    left[0] = 0
    left[1:] = x[:-1]
    left[first] = 0
    return left


def _phrase_starts(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mask of phrase starts: document starts and local maxima of the tossed labels."""
    label = (symbols >> np.uint64(56)).astype(np.uint16)
    for table, bits in ((FROM_8, 8), (FROM_5, 5), (FROM_4, 4)):
        label = table[_shifted(label, first) << bits | label]
    label = label.astype(np.int16) + 1
    following = np.zeros_like(label)
    following[:-1] = np.where(first[1:], 0, label[1:])
    return first | ((label > _shifted(label, first)) & (label >= following))


def _one_level(symbols: np.ndarray, first: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    heads = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])) | first)
    if len(heads) < len(symbols):  # a run of one symbol is one symbol, named by what it repeats and how often
        length = np.diff(np.append(heads, len(symbols))).astype(np.uint64)
        symbols = np.where(length > 1, mix(symbols[heads] + length * ODD2), symbols[heads])
        first, owner = first[heads], owner[heads]
    starts = np.flatnonzero(_phrase_starts(symbols, first))
    length = np.diff(np.append(starts, len(symbols)))
    place = np.arange(len(symbols)) - np.repeat(starts, length)
    names = mix(np.add.reduceat(symbols * PLACES[place & 63], starts) + length.astype(np.uint64))
    return names, first[starts], owner[starts]


def levelled_names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, level, name) of all phrases from FIRST_LEVEL up, and of the last phrase of each text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    if not len(owner):
        return owner, owner, np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        symbols = mix(np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint64) + ODD)
        first = np.concatenate(([True], owner[1:] != owner[:-1]))
        owners, levels, names, level = [], [], [], 0
        while len(symbols):
            symbols, first, owner = _one_level(symbols, first, owner)
            level += 1
            alone = first & np.append(first[1:], True)
            kept = np.full(len(symbols), True) if level >= FIRST_LEVEL else alone
            owners.append(owner[kept])
            names.append(symbols[kept])
            levels.append(np.full(len(names[-1]), level, dtype=np.int32))
            if alone.any():  # parsed to the end
                symbols, first, owner = symbols[~alone], first[~alone], owner[~alone]
    return np.concatenate(owners), np.concatenate(levels), np.concatenate(names)


def phrase_names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, name) of the phrases of ``levelled_names``."""
    owner, _, name = levelled_names(texts)
    return owner, name


def sketches(texts: list[str], size: int = SKETCH) -> list[np.ndarray]:
    """Per text the ``size`` smallest 32-bit phrase names, ascending; nothing for an empty text."""
    owner, name = phrase_names([t.encode("utf-8", "surrogatepass") for t in texts])
    both = np.unique(owner.astype(np.uint64) << np.uint64(32) | name >> np.uint64(32))
    owner, name = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(">u4")
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [name[a:min(b, a + size)] for a, b in zip(edges[:-1], edges[1:])]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Estimated share of common phrases: 1 for equal sketches, both empty included, 0 where one alone is empty."""
    if len(a) == len(b) and bool((a == b).all()):
        return 1.0
    union = np.union1d(a, b)[:size]
    return float(np.isin(union, a[np.isin(a, b)]).mean())


def edited_text(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as many first characters of ``following``, or all of it if it is shorter."""
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut]


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every row: hex of a sketch, '' for NULL and empty texts; equal texts have equal ones. No shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            found = [s.tobytes().hex() for s in sketches([t or "" for t in batch.column(text).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found)], names=[key, "fingerprint"])

    rows = df.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, fingerprint string")


def phrases(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, level, name) of every phrase of every row, repeated phrases each: what fingerprints are the smallest of.

    Documents that share a passage share the names of its inner phrases, however small a part of them it is. NULL and empty
    texts have none. No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            owner, level, name = levelled_names([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(owner)), pa.array(level), pa.array(name.view(np.int64))], names=[key, "level", "name"])

    rows = df.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, level int, name bigint")


def fingerprint_digest(documents: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The next document is that of the next doc_id (NULL ids first, equal ids by text), after the last the first; a lone
    document follows itself. NULL texts are empty. An empty table gives an empty result.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row, whose successor has not come yet
        for batch in pieces(batches, "text"):
            rows = held + list(zip(batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()], batch.column("_borrowed").to_pylist()))
            held = rows[-1:]
            own = sketches([text for _, text, _ in rows])
            edited = [edited_text(a[1], b[1]) for a, b in zip(rows, rows[1:])]
            new = sketches(edited)
            out = [(doc, len(text), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), s.tobytes().hex(), n.tobytes().hex(), likeness(s, n), likeness(s, f))
                   for (doc, text, borrowed), e, s, n, f in zip(rows, edited, own, new, own[1:]) if not borrowed]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=names)

    placed = in_runs(documents.select("doc_id", "text"), "doc_id", "text", borrow=True)
    return placed.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
