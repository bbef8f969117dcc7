"""Token files: ids of documents in ascending order, kept as compressed planes of fixed-size blocks with an index.

A file is a folder of Parquet parts in ascending order of documents. A row is a chunk of whole documents: the ids, cut into
blocks of BLOCK ids; of every block one plane per byte (or bit) of an id, each compressed with zstandard; and the index: end
offset of each plane, ids before the chunk in its part, document ids and lengths. A chunk can be read alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proplake.llm.batches import pieces
from proplake.llm.ordered import in_runs
from proplake.llm.words import ENCODED_BYTES, encoder

BLOCK = 1 << 16
CHUNK = 1 << 19  # a chunk is closed when it holds this many ids
LEVEL = 3
END = 2
FILE_SCHEMA = ("part int, chunk int, start_in_part bigint, n_ids bigint, planes string, plane_ends array<bigint>, "
               "doc_ids array<bigint>, doc_lengths array<bigint>, payload binary")


def to_planes(ids: np.ndarray, planes: str) -> np.ndarray:
    """Rows are planes: byte or bit number p of every id."""
    as_bytes = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return np.ascontiguousarray(as_bytes.T)
    return np.packbits(np.unpackbits(as_bytes, axis=1, bitorder="little").T, axis=1, bitorder="little")


def from_planes(rows: np.ndarray, n: int, planes: str) -> np.ndarray:
    if planes == "byte":
        as_bytes = rows.T
    else:
        as_bytes = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little")
    return np.ascontiguousarray(as_bytes).view("<u4").ravel()


def pack(ids: np.ndarray, planes: str = "byte", level: int = LEVEL) -> tuple[bytes, list[int]]:
    """(payload, end offset of each plane): all planes of the first block, of the second, and so on."""
    press, out = zstandard.ZstdCompressor(level=level), []
    for at in range(0, len(ids), BLOCK):
        out += [press.compress(plane.tobytes()) for plane in to_planes(ids[at:at + BLOCK], planes)]
    return b"".join(out), np.cumsum([len(p) for p in out], dtype=np.int64).tolist()


def unpack(payload: bytes, plane_ends: list[int], n_ids: int, planes: str) -> np.ndarray:
    press, width, at, out = zstandard.ZstdDecompressor(), 4 if planes == "byte" else 32, 0, [np.zeros(0, "<u4")]
    for block in range(0, len(plane_ends), width):
        n = min(BLOCK, n_ids - BLOCK * (block // width))
        rows = []
        for end in plane_ends[block:block + width]:
            rows.append(np.frombuffer(press.decompress(payload[at:end]), dtype=np.uint8))
            at = end
        out.append(from_planes(np.stack(rows), n, planes))
    return np.concatenate(out)


def write_tokens(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", planes: str = "byte", vocabulary: str | None = None, end: int = END) -> None:
    """Encode every row, close each document with ``end`` and write the file at ``path``.

    Documents are in ascending order of ``key`` (NULL keys first, equal keys by text). NULL and empty texts hold the end id
    alone. An empty table gives a file without chunks. A task streams its run of keys and holds one chunk at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, last = encoder(vocabulary), np.array([end], dtype="<u4").tobytes()
        docs, lengths, data, held, before, chunk, part = [], [], [], 0, 0, 0, 0

        def closed() -> pa.RecordBatch:
            payload, ends = pack(np.frombuffer(b"".join(data), dtype="<u4"), planes)
            row = {"part": part, "chunk": chunk, "start_in_part": before, "n_ids": held, "planes": planes, "plane_ends": ends, "doc_ids": docs, "doc_lengths": lengths, "payload": payload}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([
                ("part", pa.int32()), ("chunk", pa.int32()), ("start_in_part", pa.int64()), ("n_ids", pa.int64()), ("planes", pa.string()),
                ("plane_ends", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("payload", pa.binary())]))

        for batch in pieces(batches, text, ENCODED_BYTES):
            part = batch.column("_run")[0].as_py()  # a partition is one run
            for doc, ids in zip(batch.column(key).to_pylist(), code.encode([t or "" for t in batch.column(text).to_pylist()])):
                docs.append(doc)
                lengths.append(len(ids) // 4 + 1)
                data += (ids, last)
                held += lengths[-1]
                if held >= CHUNK:
                    yield closed()
                    before, chunk = before + held, chunk + 1
                    docs, lengths, data, held = [], [], [], 0
        if docs:
            yield closed()

    in_runs(df.select(key, text), key, text).mapInArrow(run, FILE_SCHEMA).write.parquet(path)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, part_start): ids before each part, from the index alone; a row per part."""
    totals = spark.read.parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the file, from its decoded ids."""
    names = ["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["plane_ends"], row["n_ids"], row["planes"])
                starts = np.concatenate(([0], np.cumsum(row["doc_lengths"])))
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:])]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]] * len(crc), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts[:-1] + row["start_in_part"], pa.int64()),
                    pa.array(row["doc_lengths"], pa.int64()), pa.array(crc, pa.int64())], names=names)

    chunks = spark.read.parquet(path).select("part", "start_in_part", "n_ids", "planes", "plane_ends", "doc_ids", "doc_lengths", "payload")
    rows = chunks.mapInArrow(run, "part int, doc_id bigint, start_in_part bigint, n_tokens bigint, ids_crc32 bigint")
    placed = rows.join(F.broadcast(part_starts(spark, path)), "part")  # one row per part, of which there are as many as tasks wrote
    return placed.select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every document in the file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["plane_ends"], row["n_ids"], row["planes"])
                offsets = np.concatenate(([0], np.cumsum(row["doc_lengths"]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return spark.read.parquet(path).mapInArrow(run, "doc_id bigint, ids array<int>")


def token_file_digest(documents: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): write all documents into a token file in the shared folder and read it back."""
    from proplake.plans.scratch import scratch_folder

    spark = documents.sparkSession
    path = scratch_folder(spark, "tokens")
    write_tokens(documents, path)
    return read_digests(spark, path)
