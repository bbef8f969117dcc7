"""Uniform sharding with exact shard sizes, drawn from a hypergeometric communication matrix.

A uniform shuffle into shards of fixed sizes sends, from each source partition to each shard, a number of rows that follows
the multivariate hypergeometric law. Those numbers are drawn first, from the partitions' row counts alone. Every partition
then permutes its rows and deals them out by its row of the matrix; every shard permutes what it received.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proplake.llm.names import safe_names

SHARDS = 8
SEED = 20_240


def hypergeometric(good: int, bad: int, draws: int, u: float) -> int:
    """Inverse-CDF draw of how many of ``draws`` rows are good; exact at any population size.

    Only values within 14 standard deviations of the mean are tabulated: the rest is below the resolution of ``u``.
    """
    low, high = max(0, draws - bad), min(draws, good)
    total = good + bad
    if low == high or total == 0:
        return low
    mean = draws * (good / total)
    sd = (mean * (bad / total) * ((total - draws) / max(1, total - 1))) ** 0.5
    a, b = max(low, int(mean - 14 * sd) - 14), min(high, int(mean + 14 * sd) + 14)
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    weight = np.concatenate(([0.0], np.cumsum(steps)))
    chance = np.cumsum(np.exp(weight - weight.max()))
    return a + int(np.searchsorted(chance, u * chance[-1], side="right").clip(0, b - a))


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """rows[i][s]: rows that source partition i sends to shard s. Row sums are ``counts``; column sums differ by one at most."""
    total = sum(counts)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    chance = np.random.default_rng(seed).random((len(counts), shards))
    matrix = []
    for i, n in enumerate(counts):
        row, rest = [], sum(left)
        for s in range(shards):
            drawn = hypergeometric(left[s], rest - left[s], n - sum(row), float(chance[i][s]))
            rest -= left[s]
            row.append(drawn)
        left = [have - sent for have, sent in zip(left, row)]
        matrix.append(row)
    return matrix


def _ends(matrix: list[list[int]]) -> Column:
    """One array per source partition: the last local rank that still goes to shard 0, 1, ..."""
    text = ";".join(",".join(str(v) for v in np.cumsum(row)) for row in matrix)
    return F.transform(F.split(F.lit(text), ";"), lambda row: F.split(row, ",").cast("array<bigint>"))


def shuffle_into_shards(df: DataFrame, identity: list[str], shards: int = SHARDS, seed: int = SEED, partitions: int | None = None) -> DataFrame:
    """All columns of ``df`` plus ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard).

    ``identity`` names the columns whose values tell rows apart; NULLs count as a value. Rows equal in all of them are
    interchangeable: each gets a place of its own, which of them gets which is open. Shard sizes differ by one row at most.
    An empty table gives an empty result; columns of ``df`` named ``shard`` or ``slot`` are replaced, others
    stay whatever their names; fewer rows than shards
    leave shards empty. Every draw comes from hashes of ``identity`` and ``seed``, so a task that runs again deals alike.

    ``partitions`` source partitions (spark.sql.shuffle.partitions by default) bound what the driver sees: one count each.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = df.drop("shard", "slot")
    names, given = df.columns, safe_names(df.columns)
    df, identity = df.toDF(*given), [f"`{given[names.index(c)]}`" for c in identity]
    draw = lambda k: F.xxhash64(F.lit(seed + k), *identity)  # noqa: E731  independent of each other: the seed goes in first
    source = F.pmod(draw(0), F.lit(parts)).cast("int")
    counted = {r["_source"]: r["n"] for r in df.groupBy(source.alias("_source")).agg(F.count(F.lit(1)).alias("n")).collect()}
    matrix = communication_matrix([counted.get(i, 0) for i in range(parts)], shards, seed)

    # permute inside the source partition and deal out
    local = Window.partitionBy("_source").orderBy("_first", "_tie")
    dealt = df.withColumns({"_source": source, "_first": draw(1), "_second": draw(2), "_tie": draw(3)}).withColumn("_rank", F.row_number().over(local))
    ends = spark.range(parts).select(F.col("id").cast("int").alias("_source"), F.element_at(_ends(matrix), F.col("id").cast("int") + 1).alias("_ends"))
    dealt = dealt.join(F.broadcast(ends), "_source").withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))))

    # exchange by slices of the shard's second permutation, which is the order of another hash
    slices = max(1, parts // shards)
    dealt = dealt.withColumn("_slice", F.pmod(F.shiftright("_second", 32), F.lit(slices)).cast("int"))
    filled = dealt.groupBy("shard", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = filled.select("shard", "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_slice").orderBy("_second", "_tie")
    placed = dealt.withColumn("_inside", F.row_number().over(inside)).join(F.broadcast(offsets), ["shard", "_slice"])
    return placed.select(*[f"`{c}`" for c in given], "shard", (F.col("_before") + F.col("_inside") - 1).alias("slot")).toDF(*names, "shard", "slot")


def shard_digest(documents: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document; a NULL text is empty."""
    rows = shuffle_into_shards(documents.select("doc_id", "text"), ["doc_id", "text"])
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
