"""Exact ranks and order statistics from counts of distinct values, without a global sort window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proplake.session import cut_lineage

SLICE_ROWS = 100_000  # distinct values that a task orders
MOST_SLICES = 4_096  # bounds the cut points that the plan holds
PLACE_BITS = 33  # of monotonically_increasing_id, below the number of the partition


def slice_cuts(counts: DataFrame, value: str, slice_rows: int = SLICE_ROWS) -> list:
    """Ascending cut points that leave about ``slice_rows`` rows of ``counts`` in each slice."""
    slices = min(MOST_SLICES, -(-counts.count() // slice_rows))
    if slices < 2:
        return []
    fractions = [i / slices for i in range(1, slices)]
    return sorted(set(counts.agg(F.percentile_approx(value, fractions, max(10_000, 20 * slices)).alias("cuts")).first()["cuts"] or []))


def value_positions(df: DataFrame, value: str, groups: tuple[str, ...] = (), slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(groups, value, n, before): occurrences of each value and how many rows of the group are smaller.

    Equal values combine first. Distinct values are cut into slices by their number; positions run inside a group's part of a
    slice, so no task orders more than a slice, and the slices' totals are added. Any cut points give the same exact result.
    """
    counts = cut_lineage(df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n")))
    cuts = slice_cuts(counts, value, slice_rows)
    if not cuts:
        order = Window.partitionBy(*groups, F.lit(0)).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return cut_lineage(counts.select(*groups, value, "n", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before")))
    edges = F.array(*[F.lit(c) for c in cuts])
    sliced = counts.withColumn("slice", F.size(F.filter(edges, lambda c: c < F.col(value))))
    totals = sliced.groupBy(*groups, "slice").agg(F.sum("n").alias("total"))
    earlier = Window.partitionBy(*groups, F.lit(0)).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, "slice", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*groups, "slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return cut_lineage(sliced.join(offsets, [*groups, "slice"]).select(
        *groups, value, "n", (F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("before")))


def value_at(position: Column, value: str) -> Column:
    """Aggregate over ``value_positions``: the value at a 1-based position."""
    return F.max(F.when((F.col("before") < position) & (F.col("before") + F.col("n") >= position), F.col(value)))


def with_position(df: DataFrame, keys: list[Column], into: str, first: int = 1) -> DataFrame:
    """``df`` plus the place of each row in the order of ``keys``, from partition offsets of a sorted, written-out table.

    The increasing id taken behind the sort holds a row's partition and its place in it, so nothing is sorted again.
    """
    ordered = cut_lineage(df.orderBy(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", PLACE_BITS).alias("_part")
    sizes = ordered.groupBy(part).agg(F.count("*").alias("_n"))  # one small row per partition
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + first).alias("_offset"))
    place = F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(into, place).drop("_at", "_part", "_offset")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, rho, t): rank correlation with average ranks for ties, from counts of distinct pairs."""
    from proplake.functions.skew import join_by_weight

    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    n_rows = known.count()
    rank = F.col("before") - F.lit(n_rows / 2) + F.col("n") / 2  # centred: sums of products of raw ranks would cancel

    def ranks(column: str, name: str) -> DataFrame:
        return value_positions(known, column).select(column, rank.alias(name), F.col("n").alias(f"{name}_n"))

    pairs = known.groupBy(x, y).agg(F.count("*").alias("w"))
    ranked = join_by_weight(join_by_weight(pairs, ranks(x, "rx"), [x], "rx_n"), ranks(y, "ry"), [y], "ry_n")
    sums = ranked.agg(
        F.sum("w").alias("n"), F.sum(F.col("w") * F.col("rx")).alias("sx"), F.sum(F.col("w") * F.col("ry")).alias("sy"),
        F.sum(F.col("w") * F.col("rx") * F.col("rx")).alias("sxx"), F.sum(F.col("w") * F.col("ry") * F.col("ry")).alias("syy"),
        F.sum(F.col("w") * F.col("rx") * F.col("ry")).alias("sxy"))
    n = F.col("n")
    top = F.col("sxy") - F.col("sx") * F.col("sy") / n
    scale = F.sqrt((F.col("sxx") - F.col("sx") * F.col("sx") / n) * (F.col("syy") - F.col("sy") * F.col("sy") / n))
    out = sums.select("n", F.try_divide(top, scale).alias("rho"))
    return out.withColumn("t", F.try_divide(F.col("rho") * F.sqrt(n - 2), F.sqrt(1 - F.col("rho") * F.col("rho"))))
