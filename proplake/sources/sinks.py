"""Writers: versioned snapshots, append-only logs, and report exports."""

from __future__ import annotations

import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proplake.operators import views


def write_snapshot(df: DataFrame, root: str, version: int | str | None = None, sort_by: str = "score") -> str:
    """Write a complete new version beside the old ones, then add a pointer to it. Pointers are only ever added, so a reader
    finds the last complete version at any time, also when a writer is lost in between.

    Partitioned by activity and sorted by score inside files, so the common scans skip most row groups.
    """
    name = f"version={version if version is not None else uuid.uuid4().hex}"
    path = f"{root.rstrip('/')}/{name}"
    out = df.sortWithinPartitions(F.desc_nulls_last(sort_by)) if sort_by in df.columns else df
    writer = out.write.mode("overwrite")
    (writer.partitionBy("is_active") if "is_active" in df.columns else writer).parquet(path)
    pointer = df.sparkSession.range(1).select(F.lit(name).alias("version"), F.lit(time.time_ns()).alias("written"))
    pointer.write.mode("append").parquet(f"{root.rstrip('/')}/_current")
    return path


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    name = spark.read.parquet(f"{root.rstrip('/')}/_current").agg(F.max_by("version", "written").alias("version")).first()["version"]
    df = spark.read.parquet(f"{root.rstrip('/')}/{name}")
    # a partition folder's name carries no boolean type
    return df.withColumn("is_active", F.col("is_active").cast("boolean")) if "is_active" in df.columns else df


def append_events(df: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Append log rows. With a batch id the batch owns one folder, so a replayed batch replaces itself."""
    if batch_id is None:
        df.write.mode("append").parquet(path)
    else:
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def write_report(calls: DataFrame, summary: DataFrame, path: str) -> None:
    """Per-call CSV with a header and the summary as JSON lines."""
    calls.write.mode("overwrite").option("header", True).csv(f"{path.rstrip('/')}/per_call")
    summary.write.mode("overwrite").json(f"{path.rstrip('/')}/summary")


def top_listings(df: DataFrame, filters: dict[str, Any], as_of: str, n: int = 1000) -> DataFrame:
    """The export's rows: main-tab listings by score, first ``n``."""
    return views.view_filters(df, {"tab": "main", **filters}, as_of).orderBy(*views.sort_keys("score_desc")).limit(n)


def export_top_json(df: DataFrame, filters: dict[str, Any], as_of: str, path: str, n: int = 1000) -> None:
    top_listings(df, filters, as_of, n).write.mode("overwrite").json(path)
