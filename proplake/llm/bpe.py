"""Byte-pair encoding with reuse of content-defined chunks, and decoding.

A rolling hash of the last characters cuts every text, so the same passage is cut alike wherever it stands. The middle of a
chunk, between its first and its last place where no pre-token can straddle, is encoded once and kept. What remains at a
join of two chunks is encoded anew over a window that grows, over further chunks if need be, until both its ends lie at such
a place: there the repaired ids and the kept ids agree exactly, and the whole equals the ids of the whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from proplake.llm.batches import pieces
from proplake.llm.words import ENCODED_BYTES, Recent, byte_table, encoder

WINDOW = 16  # a power of two
MEAN_CHUNK = 256  # a power of two
MOST_CHUNKS = 60_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def chunk_ends(text: str) -> list[int]:
    """Cut places in code points, the text's end last: wherever the hash of the last WINDOW characters is a multiple."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(codes) <= WINDOW:
        return [len(codes)]
    rolled, width = codes, 1
    factor = BASE
    with np.errstate(over="ignore"):
        while width < WINDOW:  # doubling: the hash of 2w characters from two hashes of w
            rolled = rolled[width:] + factor * rolled[:-width]
            factor, width = factor * factor, width * 2
        mixed = (rolled ^ (rolled >> np.uint64(29))) * BASE
    cuts = np.flatnonzero(mixed >> np.uint64(40) & np.uint64(MEAN_CHUNK - 1) == 0) + WINDOW
    ends = cuts.tolist()
    if not ends or ends[-1] != len(codes):
        ends.append(len(codes))
    return ends


def _first_place(chunk: str) -> int:
    """The first space that follows a character other than white space; -1 without one."""
    at = chunk.find(" ", 1)
    while at > 0 and chunk[at - 1].isspace():
        at = chunk.find(" ", at + 1)
    return at


def _last_place(chunk: str) -> int:
    at = chunk.rfind(" ", 1)
    while at > 0 and chunk[at - 1].isspace():
        at = chunk.rfind(" ", 1, at)
    return at


class ChunkEncoder:
    """Ids of texts by reuse of chunks; the middle of a chunk is encoded when first met and remembered up to a bound."""

    def __init__(self, path: str | None = None, most_chunks: int = MOST_CHUNKS):
        self.words = encoder(path)
        self.middles = Recent(most_chunks)

    def encode(self, texts: list[str]) -> list[bytes]:
        cut, new = [], {}
        for text in texts:
            start, parts = 0, []
            for end in chunk_ends(text) if text else []:
                chunk, start = text[start:end], end
                known = self.middles.find(chunk)
                if known is None and chunk not in new:
                    first, last = _first_place(chunk), _last_place(chunk)
                    new[chunk] = (first, last, chunk[first:last] if 0 < first < last else "")
                parts.append((chunk, known))
            cut.append(parts)
        middles = self.words.encode([middle for _, _, middle in new.values()])
        learnt = {chunk: (first, last, ids) for (chunk, (first, last, _)), ids in zip(new.items(), middles)}
        windows, plans = [], []
        for parts in cut:
            plan, open_window = [], ""
            for chunk, known in parts:
                first, last, ids = known or learnt[chunk]
                if first <= 0:  # no place to agree at: the window goes on
                    open_window += chunk
                    continue
                windows.append(open_window + chunk[:first])
                plan.append(ids)
                open_window = chunk[last:]
            windows.append(open_window)
            plans.append(plan)
        repaired = iter(self.words.encode(windows))
        self.middles.add(learnt)
        out = []
        for plan in plans:
            ids = []
            for middle in plan:
                ids += (next(repaired), middle)
            out.append(b"".join([*ids, next(repaired)]))
        return out


class Decoder:
    def __init__(self, path: str | None = None):
        self.bytes_of = byte_table(encoder(path).tokenizer)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_held: dict[str, tuple[ChunkEncoder, Decoder]] = {}


def codec(path: str | None = None) -> tuple[ChunkEncoder, Decoder]:
    key = path or ""
    if key not in _held:
        _held[key] = (ChunkEncoder(path), Decoder(path))
    return _held[key]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids array<int>) of every row. NULL and empty texts give no ids; repeated rows give equal rows; no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(vocabulary)[0]
        for batch in pieces(batches, text, ENCODED_BYTES):
            found = [np.frombuffer(b, dtype="<i4") for b in code.encode([t or "" for t in batch.column(text).to_pylist()])]
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(key), ids], names=[key, "ids"])

    rows = df.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(key, text) of every row; NULL ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = codec(vocabulary)[1]
        for batch in pieces(batches, ids):
            texts = [back.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], names=[key, "text"])

    rows = df.select(key, ids)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, text string")


def round_trip(df: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ids and decoded text of each row in one pass, as digests."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, back = codec(vocabulary)
        decimal = [str(i) for i in range(len(back.bytes_of))]
        for batch in pieces(batches, "text", ENCODED_BYTES):
            counts, of_ids, of_text = [], [], []
            for data in code.encode([t or "" for t in batch.column("text").to_pylist()]):
                ids = np.frombuffer(data, dtype="<u4").tolist()
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(back.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
