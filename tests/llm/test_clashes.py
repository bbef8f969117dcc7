"""Columns whose names operators use inside keep their names and values; many equal rows are dealt apart."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from proplake.llm import packing, repeats, resampling, secrets, sharding
from tests.llm.conftest import SCHEMA, long_text

CLASHING = ["key", "log_weight", "_doc", "_row", "_text", "_part", "_clean", "clean", "_first", "_second", "_source", "_tie", "_rank", "_slice", "_inside", "_before", "_ends", "row", "a.b", "given 0", "label"]


@pytest.fixture(scope="module")
def clashing(spark):
    passage = long_text(9, 60)
    rows = [(i, f"{long_text(i, 30)} {passage if i % 3 == 0 else ''} {'token = abcdef123' if i % 4 == 0 else ''}", "en", f"s{i % 3}", None) for i in range(40)]
    df = spark.createDataFrame([*rows, (None, None, None, None, None), (5, "", None, None, 0)], SCHEMA)
    return df.select("*", *[F.concat(F.lit(f"{k} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(name) for k, name in enumerate(CLASHING)])


def carried(df):
    return Counter(tuple(r[df.columns.index(c)] for c in ["doc_id", "lang", *CLASHING]) for r in df.collect())


@pytest.mark.parametrize("name", ["accepted", "deduplicated", "redacted", "shards"])
def test_values_stay(spark, clashing, name):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id bigint, quality int, toxic int")
    out = {"accepted": lambda: resampling.accepted(clashing, labels), "deduplicated": lambda: repeats.deduplicated(clashing), "redacted": lambda: secrets.redacted(clashing),
           "shards": lambda: sharding.shuffle_into_shards(clashing, ["doc_id", "text", "_first"], partitions=3).drop("shard", "slot")}[name]()
    assert out.columns == clashing.columns
    before, after = carried(clashing), carried(out)
    assert after == before if name != "accepted" else after <= before and sum(after.values()) > 0


def test_equal_rows_are_dealt_apart(spark):
    df = spark.range(900).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(7).alias("size"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("cluster"))
    bins = [r["bin"] for r in packing.pack(df, capacity=100, group=100).collect()]
    assert len(set(bins)) == 900  # one source: no two share a bin
    groups = Counter(b >> packing.BIN_BITS for b in bins)
    assert len(groups) == 9 and max(groups.values()) < 200
