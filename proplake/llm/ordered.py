"""Rows in the order of an integer key over many tasks, each task holding one run of keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cuts(df: DataFrame, key: str, runs: int) -> list[int]:
    """At most ``runs`` - 1 increasing keys that cut the rows into runs of about equal size."""
    shares = [i / runs for i in range(1, runs)] or [0.5]
    row = df.agg(F.percentile_approx(key, shares, max(10_000, 20 * runs)).alias("cuts")).first()
    return sorted(set(row["cuts"] or [])) if runs > 1 else []


def in_runs(df: DataFrame, key: str, tie: str, borrow: bool = False, runs: int | None = None) -> DataFrame:
    """``df`` plus ``_run`` and ``_borrowed``, one run per partition, sorted by (_run, _borrowed, key, tie).

    Ascending runs hold ascending keys; rows with NULL keys come first, rows with equal keys stay in one run and are ordered
    by ``tie``. With ``borrow`` every run also ends in a copy of the first rows of the next one (``_borrowed`` = 1), the last
    run in a copy of the very first rows, so that each row meets its successor. Cut keys and first keys, one per run, are
    all the driver sees. ``runs`` defaults to spark.sql.shuffle.partitions.
    """
    runs = runs or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = np.array(_cuts(df, key, runs), dtype=np.int64)

    known, number = F.col(key).isNotNull(), F.coalesce(F.col(key).cast("bigint"), F.lit(0))  # apart: pandas would make floats of integers with NULLs

    def run_of(numbers: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series(np.where(known, np.searchsorted(cuts, numbers.to_numpy(), side="right"), 0).astype(np.int32))

    placed = df.withColumn("_run", F.pandas_udf(run_of, "int")(number, known))
    if borrow:
        firsts = placed.groupBy("_run").agg(F.min(key).alias("first"), F.max(~known).alias("holed")).collect()
        firsts = sorted((r["_run"], None if r["holed"] else r["first"]) for r in firsts)
        lender = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}  # i = 0 lends to the last run

        def to_runs(own: pd.Series, numbers: pd.Series, known: pd.Series) -> pd.Series:
            others = (lender.get(n if k else None) for n, k in zip(numbers.tolist(), known.tolist()))
            return pd.Series([[2 * r] if other is None else [2 * r, 2 * other + 1] for r, other in zip(own.tolist(), others)], dtype=object)

        placed = placed.withColumn("_place", F.explode(F.pandas_udf(to_runs, "array<int>")("_run", number, known)))
        placed = placed.withColumns({"_run": F.shiftright("_place", 1), "_borrowed": F.col("_place").bitwiseAND(1)}).drop("_place")
    else:
        placed = placed.withColumn("_borrowed", F.lit(0))
    return placed.repartitionById(len(cuts) + 1, F.col("_run")).sortWithinPartitions("_run", "_borrowed", F.asc_nulls_first(key), F.asc_nulls_first(tie))
