"""A fresh folder for queries that exercise a writer."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from proplake.session import shared_folder


def scratch_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
