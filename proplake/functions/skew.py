"""Joins that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from proplake.session import cut_lineage

def join_by_weight(rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str, heavy_keys: int | None = None,
                   materialise: bool = False) -> DataFrame:
    """Inner join of ``rows`` to one-row-per-key ``lookup``, whose ``weight`` column counts the rows of each key.

    The most frequent keys are looked up by broadcast: as many as there are shuffle partitions, by default, a table of that
    many rows by construction. Any other key holds less than an average partition, so the shuffle join of the rest has
    no hot one. ``materialise`` writes the lookup to shared storage first, for lookups that are costly to derive.
    """
    heavy_keys = heavy_keys or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if materialise:
        lookup = cut_lineage(lookup)
    values = [c for c in lookup.columns if c not in keys]
    heavy = lookup.orderBy(F.desc(weight), *keys).limit(heavy_keys)  # keys break ties: both branches agree
    found = rows.join(F.broadcast(heavy.withColumn("_heavy", F.lit(True))), keys, "left")
    hot = found.filter("_heavy").select(*rows.columns, *values)
    cold = found.filter("_heavy IS NULL").select(*rows.columns).join(lookup, keys)
    return hot.unionByName(cold.select(*rows.columns, *values))


def left_join_spread(rows: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """Left join to a one-row-per-key lookup in which rows with a NULL key, which find nothing, are dealt by a hash of the
    row instead of all going to one task. Rows that share a key are left to the engine's splitting of skewed joins."""
    plain = [f.name for f in rows.schema if not isinstance(f.dataType, (ArrayType, MapType, StructType))]
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    spread = F.when(known, F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*plain), F.lit(1 << 20)))
    filled = {key: F.coalesce(F.col(key), F.lit(0).cast(rows.schema[key].dataType)) for key in keys}
    left = rows.withColumns({f"_key_{key}": column for key, column in filled.items()} | {"_spread": spread})
    values = [c for c in lookup.columns if c not in keys]
    right = lookup.select(*[F.col(key).alias(f"_key_{key}") for key in keys], *values, F.lit(0).cast("bigint").alias("_spread"))
    joined = left.withColumn("_spread", F.col("_spread").cast("bigint")).join(right, [*[f"_key_{key}" for key in keys], "_spread"], "left")
    return joined.select(*keys, *[c for c in rows.columns if c not in keys], *values)
