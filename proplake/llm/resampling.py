"""Quality classifier by importance resampling.

Two generative models of hashed word unigrams and bigrams are counted: the target model over labelled good documents, the raw
model over all documents. They tell how likely a document is to hold an n-gram; how often it holds it does not count, since
the occurrences in one long or repetitive document say too little about others. The log ratio of both, summed over a
document's n-grams, is its log importance weight. Documents are sampled without replacement by Gumbel top-k: the k largest of
log weight / temperature + Gumbel noise.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proplake.llm.batches import PIECE_BYTES, pieces
from proplake.llm.hashing import follow, mix, word_hashes
from proplake.llm.names import safe_names
from proplake.session import cut_lineage

BITS = 20  # of a bucket number, for unigrams and bigrams each
SLICE = 1 << 13
AGAIN = 0x5BD1E995  # stands for "the same word again"
MOST_LABELLED = 65_536  # labelled documents used at most: one half to count the target model, one half to set the threshold
PSEUDO = 2.0
#: N-grams whose target count is within so many standard deviations of what raw text predicts weigh nothing. Few documents
#: show little and many show chance effects too, so the value is chosen on the held-out documents.
SIGNIFICANT = (1.5, 2.0, 3.0, 4.0, 6.0)
LOST = 0.005  # share of held-out good documents that may fall below the threshold
TEMPERATURE = 0.25
SEED = 4_711


@dataclass(frozen=True)
class Model:
    """``ratio``: log ratio by bucket, unigrams and then bigrams; ``threshold``: log weight from which documents are accepted."""

    ratio: np.ndarray
    threshold: float


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of the distinct unigrams and bigrams of each text, ascending.

    Of a word that follows itself the bigram says only how often it has done so by now, as a power of two: which word is
    repeated tells nothing, that one is repeated much.
    """
    edges, words = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(edges))
    if not len(words):
        return owner, np.zeros(0, np.int64)
    shift = np.uint64(64 - BITS)
    unigrams = (words >> shift).astype(np.int64)
    first = np.flatnonzero(owner[1:] == owner[:-1])
    again = words[first] == words[first + 1]
    place = np.arange(len(first))
    begins = np.concatenate(([True], np.diff(owner[first]) != 0)) if len(first) else again  # of a text
    before = np.where(again, np.where(begins, place - 1, -1), place)
    times = place - np.maximum.accumulate(before)  # 1, 2, ... inside a run of one word
    pairs = follow(words, 2)[first] if len(words) > 1 else words[:0]
    pairs = np.where(again, mix(np.uint64(AGAIN) + np.log2(np.maximum(times, 1)).astype(np.uint64)), pairs)
    both = np.concatenate((owner << BITS + 1 | unigrams, owner[first] << BITS + 1 | 1 << BITS | (pairs >> shift).astype(np.int64)))
    both = np.unique(both)
    return both >> BITS + 1, both & (2 << BITS) - 1


def log_weights(texts: Iterable[bytes], *ratios: np.ndarray) -> np.ndarray:
    """By ratio, the log weight of each text; texts are hashed once, about PIECE_BYTES of them at a time."""
    out, held, size = [np.zeros((len(ratios), 0))], [], 0

    def weigh() -> np.ndarray:
        owner, bucket = buckets(held)
        return np.stack([np.bincount(owner, weights=ratio[bucket], minlength=len(held)) for ratio in ratios])

    for text in texts:
        held.append(text)
        size += len(text)
        if size >= PIECE_BYTES:
            out.append(weigh())
            held, size = [], 0
    if held:
        out.append(weigh())
    return np.concatenate(out, axis=1).round(9)


def _encoded(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]


def labelled(labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, good, held): at most ``most`` labelled documents by a hash of their id; ``held`` marks the half for the threshold.

    Good documents are of quality 1 and not toxic in all their label rows; rows with NULL ids or labels are left out.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    rows = known.groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return rows.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(most).withColumn("held", F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(2)) == 1)


def _count(documents: DataFrame, marked: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents that hold each bucket, of all and of good ones: one small table, whatever the size of the corpus."""
    size = 2 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in pieces(batches, "text"):
            owner, bucket = buckets(_encoded(batch))
            wanted = np.array(batch.column("target").to_pylist(), dtype=bool)
            for counts, found in ((raw, bucket), (target, bucket[wanted[owner]])):
                at, n = np.unique(found, return_counts=True)  # a piece holds few of the buckets
                counts[at] += n
        if raw.any():
            press = zstandard.ZstdCompressor(level=1)
            both = [(at // SLICE, press.compress(np.stack((raw[at:at + SLICE], target[at:at + SLICE])).tobytes())) for at in range(0, size, SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in both], pa.int32()), pa.array([c for _, c in both], pa.binary())], names=["slice", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, press = {}, zstandard.ZstdDecompressor()
        for batch in batches:
            for k, packed in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(press.decompress(packed), dtype=np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["slice", "counts"])

    wanted = documents.select("doc_id", "text").join(F.broadcast(marked), "doc_id", "left")  # at most MOST_LABELLED rows
    rows = wanted.select("text", F.coalesce(F.col("good") & ~F.col("held"), F.lit(False)).alias("target"))
    slices = rows.mapInArrow(count, "slice int, counts binary").repartition(size // SLICE, "slice").mapInArrow(total, "slice int, counts binary")
    counts = np.zeros((2, size), np.int64)
    for row in slices.collect():
        counts[:, row["slice"] * SLICE:(row["slice"] + 1) * SLICE] = np.frombuffer(row["counts"], dtype=np.int64).reshape(2, -1)
    return counts[0], counts[1]


def log_ratio(raw: np.ndarray, target: np.ndarray, significant: float) -> np.ndarray:
    """Log of target over expected counts, for unigrams and bigrams apart; 0 where they do not differ significantly."""
    ratio = np.zeros(len(raw), dtype=np.float32)
    for part in (slice(0, len(raw) // 2), slice(len(raw) // 2, None)):
        expected = raw[part] * (target[part].sum() / max(1, raw[part].sum()))
        differs = np.abs(target[part] - expected) > significant * np.sqrt(expected)
        ratio[part] = np.where(differs, np.log((target[part] + PSEUDO) / (expected + PSEUDO)), 0)
    return ratio


def weighed(documents: DataFrame, model: Model, into: str = "log_weight") -> DataFrame:
    """``documents`` plus the log weight of each; NULL and empty texts weigh 0."""
    spare = documents.drop(into)
    ratio = model.ratio

    def weigh(texts: pa.Array) -> pa.Array:
        """Texts leave Arrow one at a time: a batch never becomes a column of Python strings."""
        return pa.array(log_weights(((t.as_py() or "").encode("utf-8", "surrogatepass") for t in texts), ratio)[0])

    return spare.withColumn(into, F.arrow_udf(weigh, "double")("text"))


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """Count both models, and choose on the held-out documents what counts as significant and where the threshold lies.

    The threshold keeps all but LOST of the held-out good documents; the choice is that which then rejects most bad ones.
    Without labelled good documents every weight is 0 and everything is accepted.
    """
    marked = labelled(labels)
    raw, target = _count(documents, marked)
    if not target.any():
        return Model(np.zeros(len(raw), np.float32), float("-inf"))
    ratios = [log_ratio(raw, target, s) for s in SIGNIFICANT]
    sparse = [(at := np.flatnonzero(r).astype(np.int32), r[at]) for r in ratios]  # what tasks are sent

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = []
        for at, values in sparse:
            dense.append(np.zeros(2 << BITS, np.float32))
            dense[-1][at] = values
        for batch in pieces(batches, "text"):
            found = log_weights(_encoded(batch), *dense)
            yield pa.RecordBatch.from_arrays([batch.column("good"), *map(pa.array, found)], names=["good", *[f"w{i}" for i in range(len(found))]])

    held = documents.select("doc_id", "text").join(F.broadcast(marked.filter("held")), "doc_id").select("text", "good")
    rows = held.mapInArrow(weigh, "good boolean, " + ", ".join(f"w{i} double" for i in range(len(ratios)))).collect()  # half of MOST_LABELLED at most
    best = None
    for i, ratio in enumerate(ratios):
        good = np.sort([r[f"w{i}"] for r in rows if r["good"]])
        threshold = float(good[int(LOST * len(good))]) if len(good) else float("-inf")
        rejected = sum(r[f"w{i}"] < threshold for r in rows if not r["good"])
        if best is None or rejected > best[0]:
            best = (rejected, Model(ratio, threshold))
    return best[1]


def gumbel(*identity: str, seed: int = SEED) -> Column:
    """Gumbel noise from a hash of the row: a task that runs again draws the same."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *identity), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The ``k``-th largest value, by refining a histogram: the driver sees bins, never the rows."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if k >= n or low == high:
        return low if n and k >= n else high if n else float("inf")
    above = 0
    for _ in range(12):
        width = (high - low) / 2_048
        if width <= 0 or low + width == low:
            break
        inside = df.filter(F.col(column).between(low, high))
        bins = sorted(inside.groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(2_047)).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect(), key=lambda r: -r["bin"])
        for r in bins:
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
        if low == high or r["n"] == 1:
            break
    return low


def scored(documents: DataFrame, model: Model, temperature: float = TEMPERATURE) -> DataFrame:
    """``documents`` plus ``log_weight`` and ``key``, the noisy weight that top-k goes by."""
    return weighed(documents, model).withColumn("key", F.col("log_weight") / temperature + gumbel("doc_id", "text"))


def _cut(rows: DataFrame, model: Model) -> float:
    """The least key of the sample."""
    k = rows.filter(F.col("log_weight") >= model.threshold).count()
    return kth_largest(rows, "key", k) if k else float("inf")


def sample(documents: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame, float]:
    """(model, (doc_id, log_weight, key) of all documents, cut): the sample is every document whose key reaches ``cut``.

    Its size k is the number of documents whose weight reaches the model's threshold; documents that tie at the cut all stay.
    Repeated rows have equal keys and stand or fall together; an empty table gives an empty sample. Other columns are ignored.
    """
    model = fit(documents, labels)
    rows = cut_lineage(scored(documents.select("doc_id", "text"), model).select("doc_id", "log_weight", "key"))
    return model, rows, _cut(rows, model)


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The sampled rows of ``documents``, with its columns, whatever their names.

    NULL and empty texts weigh 0; repeated rows stand or fall together; an empty table gives an empty result. Rows are written
    once beside their keys, so no text is weighed again.
    """
    given = documents.toDF(*safe_names(documents.columns, ("doc_id", "text")))
    model = fit(given, labels)
    rows = cut_lineage(scored(given, model))
    return rows.filter(F.col("key") >= _cut(rows, model)).select(*given.columns).toDF(*documents.columns)


def resampling_digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, log_weight, key, kept) of every document."""
    _, rows, cut = sample(documents, labels)
    return rows.withColumn("kept", F.col("key") >= cut)
