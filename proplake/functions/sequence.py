"""Per-key sequence helpers that stay balanced when one key holds a large share of all rows.

A key's history is cut into time buckets. Work inside a bucket is independent; only a small summary per bucket is
threaded through in order, so no task ever has to walk a whole hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (read as UTC)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def time_bucket(ts: Column | str, seconds: float) -> Column:
    return F.floor(micros(ts) / F.lit(int(seconds * 1_000_000))).cast("long")


def with_previous(df: DataFrame, columns: list[str], key: str = "uid", order: tuple[str, ...] = ("ts", "event_id"),
                  bucket_seconds: float = 86_400.0, name: str = "previous") -> DataFrame:
    """Add struct ``name`` holding ``columns`` of the preceding row of the same key (NULL on the first row).

    Equals ``lag`` over (key, order). The last row of every (key, bucket) is pre-aggregated, carried to the next
    occupied bucket, and joined back; the row-level window then runs per (key, bucket).
    """
    payload = F.struct(*order, *[c for c in columns if c not in order])
    cut = df.withColumn("_bucket", time_bucket(order[0], bucket_seconds))
    last = cut.groupBy(key, "_bucket").agg(F.max(payload).alias("_last"))
    carry = last.withColumn(
        "_carry", F.lag("_last").over(Window.partitionBy(key).orderBy("_bucket"))
    ).select(key, "_bucket", "_carry")
    inner = Window.partitionBy(key, "_bucket").orderBy(*order)
    return (
        cut.join(carry, [key, "_bucket"])
        .withColumn(name, F.coalesce(F.lag(payload).over(inner), F.col("_carry")))
        .drop("_bucket", "_carry")
    )


def numbered(df: DataFrame, order: str, key: str = "uid", width: int = 1_000, name: str = "number") -> DataFrame:
    """Add 1, 2, ... per key in order of a whole-number column, counting per (key, slice of ``width``) plus offsets."""
    cut = df.withColumn("_slice", F.floor(F.col(order) / width))
    sizes = cut.groupBy(key, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy(key, "_slice").orderBy(order)
    return cut.join(offsets, [key, "_slice"]).withColumn(name, F.row_number().over(inner) + F.col("_offset")).drop("_slice", "_offset")


def sorted_stream(df: DataFrame, keys: list[str], order: tuple[str, ...]) -> DataFrame:
    """Rows of one key combination contiguous and in order inside one partition, ready for a streaming fold."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def bucketed_fold(
    df: DataFrame,
    *,
    order: tuple[str, ...],
    bucket_seconds: float,
    summarise: Callable[[Iterator[Any]], Iterator[Any]],
    summary_schema: str,
    thread: Callable[[Iterator[Any]], Iterator[Any]],
    entry_schema: str,
    replay: Callable[[Iterator[Any]], Iterator[Any]],
    out_schema: str,
    key: str = "uid",
    thread_order: tuple[str, ...] = ("bucket",),
) -> DataFrame:
    """Three-step ordered fold: summarise each (key, bucket); thread the summaries per key; replay each bucket.

    ``summarise`` emits rows of ``summary_schema`` (key, bucket, ...), ``thread`` turns them into the state on entry to
    every bucket (``entry_schema``: key, bucket, ...), and ``replay`` sees the bucket's rows with that state joined on.
    """
    cut = df.withColumn("bucket", time_bucket(order[0], bucket_seconds))
    keys = [key, "bucket"]
    summaries = sorted_stream(cut, keys, order).mapInPandas(summarise, summary_schema)
    entries = sorted_stream(summaries, [key], thread_order).mapInPandas(thread, entry_schema)
    return sorted_stream(cut.join(entries, keys), keys, order).mapInPandas(replay, out_schema)
