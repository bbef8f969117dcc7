"""Connected components by alternating star contractions: the number of rounds grows with log of the chain length.

A graph, or what contraction leaves of one, that is as small as one task's share is finished in that task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proplake.functions.skew import join_by_weight
from proplake.session import cut_lineage


EDGES_A_TASK = 250_000


def smallest_reached(node: np.ndarray, other: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that each of 0 .. n - 1 reaches, by hooking the larger root on the smaller and halving paths."""
    root = np.arange(n)
    while True:
        a, b = root[node], root[other]
        apart = a != b
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
        while (root != root[root]).any():
            root = root[root]


def _finished(edges: DataFrame) -> DataFrame:
    """(node, component) of at most EDGES_A_TASK edges, in one task."""
    kind = edges.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        both = pa.chunked_array([*table["node"].chunks, *table["other"].chunks]).combine_chunks().dictionary_encode()
        names = sorted(both.dictionary.to_pylist())  # Unicode order is the order of UTF-8 bytes
        place = {name: i for i, name in enumerate(names)}
        number = np.array([place[name] for name in both.dictionary.to_pylist()], dtype=np.int64)[both.indices.to_numpy()]
        root = smallest_reached(number[:len(number) // 2], number[len(number) // 2:], len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names, both.dictionary.type), pa.array([names[r] for r in root.tolist()], both.dictionary.type)], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def _hook(directed: DataFrame) -> DataFrame:
    """(node, other) -> (node, other, low): the smallest label among a node and its neighbours, hot nodes included.

    The labels are written once; ``directed`` should be cheap to read again.
    """
    low = directed.groupBy("node").agg(F.min("other").alias("low"), F.count("*").alias("degree"))
    low = low.withColumn("low", F.least("low", "node"))
    return join_by_weight(directed, low, ["node"], "degree", materialise=True).drop("degree")


def _pair(node: str, other: str) -> Column:
    return F.struct(F.col(node).alias("node"), F.col(other).alias("other"))


def _spread(df: DataFrame, *pairs: Column) -> DataFrame:
    """One output edge per given pair and input row, in a single pass."""
    return df.select(F.explode(F.array(*pairs)).alias("edge")).select("edge.node", "edge.other")


def _large_star(edges: DataFrame) -> DataFrame:
    both = _spread(edges, _pair("node", "other"), _pair("other", "node"))
    return _hook(both).filter(F.col("other") > F.col("node")).select(F.col("other").alias("node"), F.col("low").alias("other"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other"))
    return _spread(_hook(down), _pair("other", "low"), _pair("node", "low"))


def _proper(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("node") != F.col("other")).distinct()


def _is_stars(edges: DataFrame) -> bool:
    """True when every node has one parent and no parent is itself a node."""
    parents = edges.groupBy("node").agg((F.min("other") != F.max("other")).alias("torn"))
    roots = edges.select(F.col("other").alias("node")).distinct().withColumn("root", F.lit(True))
    return parents.join(roots, "node", "left").filter("torn OR root").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60, edges_a_task: int = EDGES_A_TASK) -> DataFrame:
    """(node, component) for every node on an edge; the component is named by its smallest node.

    ``edges`` has columns (node, other). Every round is written to shared storage. Done when only stars are left or when no
    more than ``edges_a_task`` edges are, which one task finishes; raises when neither happens within ``max_rounds``.
    """
    current = cut_lineage(_proper(edges.select("node", "other")))
    for _ in range(max_rounds):
        if current.count() <= edges_a_task:
            return _finished(current)
        current = cut_lineage(_proper(_small_star(cut_lineage(_large_star(current)))))
        if _is_stars(current):
            named = _spread(current, _pair("node", "other"), _pair("other", "other")).distinct()
            return named.withColumnRenamed("other", "component")
    raise RuntimeError(f"components did not converge in {max_rounds} rounds")
