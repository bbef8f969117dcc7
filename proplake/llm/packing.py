"""Best-fit packing of documents into bins of fixed capacity under conflicts of source and duplicate cluster.

Open bins are kept in the order of what is left in them. The search begins at the tightest bin that can hold a piece and goes
to the next larger one until the bitmaps of the bin show neither the piece's source nor its cluster.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proplake.llm import neardup

CAPACITY = 16_384
GROUP = 4_096  # pieces that are packed together
BIN_BITS = 32


def best_fit(sizes: Sequence[int], sources: Sequence[int], clusters: Sequence[int], capacity: int) -> list[int]:
    """Bin number of each piece, taken in the given order; a source or cluster of -1 is in conflict with nothing.

    A bin never holds two pieces of one source or of one cluster, nor more than ``capacity``.
    """
    open_bins: list[tuple[int, int]] = []  # (left, bin), ascending
    held_sources: list[int] = []
    held_clusters: list[int] = []
    placed = []
    for size, source, cluster in zip(sizes, sources, clusters):
        source_bit, cluster_bit = 1 << source if source >= 0 else 0, 1 << cluster if cluster >= 0 else 0
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins) and (held_sources[open_bins[at][1]] & source_bit or held_clusters[open_bins[at][1]] & cluster_bit):
            at += 1
        if at < len(open_bins):
            left, chosen = open_bins.pop(at)
        else:
            left, chosen = capacity, len(held_sources)
            held_sources.append(0)
            held_clusters.append(0)
        held_sources[chosen] |= source_bit
        held_clusters[chosen] |= cluster_bit
        insort(open_bins, (left - size, chosen))
        placed.append(chosen)
    return placed


def _codes(values: pd.Series) -> list[int]:
    """Bit numbers of the values; -1 for NULL."""
    return pd.factorize(values)[0].tolist()


def _pack_group(capacity: int):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["size", "doc_id", "digest", "piece", "copy"], ascending=[False, True, True, True, True], kind="stable", na_position="first")
        bins = np.array(best_fit(pieces["size"].tolist(), _codes(pieces["source"]), _codes(pieces["cluster"]), capacity), dtype=np.int64)
        pieces["bin"] = pieces["pack"].astype("int64") * 2**BIN_BITS + bins
        return pieces[["doc_id", "piece", "start", "size", "bin"]]

    return run


def pack(df: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, size, bin) of every piece of every row of (doc_id, size, source, cluster).

    A row longer than ``capacity`` is cut into pieces of ``capacity`` and a rest; pieces of one row never share a bin, being of
    one cluster. NULL sizes count as 0, NULL sources and clusters conflict with nothing. Rows of size 0 take a place like
    others, equal rows are packed each for itself, an empty table gives an empty result, other columns are ignored.

    Rows are dealt by a hash, equal rows by their number too, into groups of about ``group`` pieces, whatever their source or
    cluster, and each group is packed largest first, so a task holds one bounded group. Clusters are kept apart inside a group; across groups bins differ.
    """
    rows = df.select("doc_id", F.coalesce(F.col("size"), F.lit(0)).cast("bigint").alias("total"), F.col("source").cast("string").alias("source"),
                     F.coalesce(F.col("cluster").cast("string"), F.when(F.col("size") > capacity, F.concat(F.lit("own "), F.xxhash64("doc_id", "size", "source").cast("string")))).alias("cluster"))
    rows = rows.withColumn("digest", F.xxhash64("total", "source", "cluster"))
    counted = rows.groupBy("doc_id", "total", "source", "cluster", "digest").agg(F.count(F.lit(1)).alias("copies"))
    cuts = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("total") / capacity).cast("int") - 1))))
    cuts = cuts.withColumn("start", F.col("piece").cast("bigint") * capacity).withColumn("size", F.least(F.col("total") - F.col("start"), F.lit(capacity)))
    n = rows.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("total") / capacity)))).first()[0] or 0
    groups = max(1, -(-int(n) // group))
    dealt = cuts.withColumn("pack", F.pmod(F.xxhash64("doc_id", "digest", "piece", "copy"), F.lit(groups)))
    dealt = dealt.select("doc_id", "digest", "piece", "copy", "start", "size", "source", "cluster", "pack")
    kind = dealt.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("pack").applyInPandas(_pack_group(capacity), f"doc_id {kind}, piece int, start bigint, size bigint, bin bigint")


def items(documents: DataFrame, percent: int = neardup.PERCENT) -> DataFrame:
    """(doc_id, size, source, cluster): UTF-8 bytes of the text (NULL: none), and near-duplicates of ``percent`` as clusters.

    Near-duplicates are found among the distinct (doc_id, text), so rows without an id or with a shared one have clusters of
    their own texts. Texts without words are of one cluster if they are equal; NULL and empty texts are of none.
    """
    rows = documents.select("doc_id", "text", "source", F.xxhash64("doc_id", "text").alias("node"))
    _, found = neardup.components(rows.select(F.col("node").alias("doc_id"), "text"), percent)
    sized = rows.select("node", "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size"), "source", F.when(F.length("text") > 0, F.xxhash64("text")).alias("own"))
    near = F.concat(F.lit("near "), F.col("component_id").cast("string"))
    joined = sized.join(found.withColumnRenamed("doc_id", "node"), "node", "left")
    return joined.select("doc_id", "size", "source", F.coalesce(near, F.col("own").cast("string")).alias("cluster"))


def packing_digest(documents: DataFrame) -> DataFrame:
    return pack(items(documents))
