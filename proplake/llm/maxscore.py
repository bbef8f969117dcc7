"""Exact top-k by inner product with MaxScore.

A term is a component with its sign; its postings are the vectors whose component has that sign, by falling impact. Of a
query, only terms of the query's own signs add to a score, each by at most its bound in the shard. The terms with the largest
bounds are essential: without any of them a vector cannot reach the k-th best score. Their postings are traversed; the other
terms are probed only for vectors that can still compete. Shards are merged at the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 5
SHARD = 8_192
QUERY_BLOCK = 4_096
PROBED = 8  # terms probed between two looks at which vectors still compete


class Shard:
    """Vectors of one shard, ascending by id, with their posting lists and bounds."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.by_impact = np.argsort(vectors, axis=0, kind="stable")  # each column: the lists of both signs, end to end
        self.impacts = np.take_along_axis(vectors, self.by_impact, axis=0)
        self.most = np.maximum(vectors.max(axis=0), 0)
        self.least = np.minimum(vectors.min(axis=0), 0)

    def postings(self, term: int, weight: int, least: int) -> np.ndarray:
        """The part of a term's list, of the sign of ``weight``, that adds at least ``least`` and more than nothing."""
        impacts = self.impacts[:, term]
        if weight > 0:
            return self.by_impact[np.searchsorted(impacts, max(1, -(-least // weight))):, term]
        return self.by_impact[:np.searchsorted(impacts, min(-1, least // weight), side="right"), term]

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows other than number ``own``, ties to the smaller id."""
        bounds = np.where(query > 0, query * self.most, query * self.least)
        terms = np.argsort(-bounds, kind="stable")
        rest = np.append(np.cumsum(bounds[terms][::-1])[::-1], 0)  # rest[j]: what terms j, j + 1, ... can add at most
        strongest = terms[0]
        lead = self.by_impact[:, strongest]
        lead = (lead[::-1] if query[strongest] > 0 else lead)[:4 * k]
        lead = lead[lead != own]
        floor = np.sort(self.vectors[lead] @ query)[-k] if len(lead) >= k else None
        reachable = floor is not None and floor > 0  # else a vector may compete without any term
        essential = int(np.searchsorted(-rest, -floor, side="right")) if reachable else len(terms)  # rest[essential] < floor
        first = terms[:essential]
        hit = np.full(len(self.ids), not reachable)
        for t in first if reachable else ():  # where the impact and all other terms fall short of the floor, the list ends
            hit[self.postings(t, int(query[t]), int(floor - (rest[0] - bounds[t])))] = True
        hit[own:own + 1] = False
        alive = np.flatnonzero(hit)
        score = self.vectors[np.ix_(alive, first)] @ query[first]
        at = essential
        while True:
            if floor is not None:
                kept = score + rest[at] >= floor
                alive, score = alive[kept], score[kept]
            if at >= len(terms):
                break
            more = terms[at:at + PROBED]
            score = score + self.vectors[np.ix_(alive, more)] @ query[more]
            at += len(more)
        best = np.lexsort((self.ids[alive], -score))[:k]
        return self.ids[alive][best], score[best]


def _search_block(k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asked = rows["asks"].to_numpy(dtype=bool)
        held, queries = rows[~asked].sort_values(["vec_id", "mark"]), rows[asked]
        held = held.loc[held.index.repeat(np.minimum(held["n"], k + 1))]  # a query takes no more of equal rows
        out = []
        if len(held) and len(queries):
            width = int(rows["vector"].map(len).max())
            matrix = lambda part: np.array([np.pad(v, (0, width - len(v))) for v in part["vector"]], dtype=np.int64).reshape(len(part), width)
            shard = Shard(held["vec_id"].to_numpy(), matrix(held))
            place = {key: i for i, key in reversed(list(enumerate(zip(held["vec_id"].tolist(), held["mark"].tolist()))))}
            for vec_id, mark, query in zip(queries["vec_id"].tolist(), queries["mark"].tolist(), matrix(queries)):
                own = place.get((vec_id, mark), len(held))
                if not width or not query.any():
                    ids = np.delete(shard.ids, [own] if own < len(held) else [])[:k]
                    scores = np.zeros(len(ids), dtype=np.int64)
                else:
                    ids, scores = shard.top(own, query, k)
                out.append(pd.DataFrame({"query_id": vec_id, "mark": mark, "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "mark": [], "vec_id": [], "score": []}).astype("int64")

    return run


def search(vectors: DataFrame, queries: Column, k: int = TOP, shard: int = SHARD, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows for every row where ``queries`` holds.

    ``vectors`` has vec_id (bigint) and vector (array<bigint>). NULL vectors or ids and vectors with NULL components take no
    part. Rows that repeat an id are rows of their own, as queries and as candidates; equal ones travel as one with a count.
    Missing components count as 0. Ties go to the smaller vec_id; fewer than ``k`` other rows give them all; an empty table
    gives an empty result; other columns of ``vectors`` are not read.

    Every block of queries meets every shard of rows in a task that holds ``shard`` rows and ``query_block`` queries.
    """
    usable = F.col("vector").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    named = vectors.filter(usable).select("vec_id", "vector", F.coalesce(queries, F.lit(False)).alias("asks"))
    marked = named.groupBy("vec_id", "vector", "asks").agg(F.count(F.lit(1)).alias("n")).withColumn("mark", F.xxhash64("vector", "asks"))
    n, asked = marked.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-asked // query_block))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    place = lambda m, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "mark"), F.lit(m)).cast("int")
    row = ["vec_id", "mark", "n", "vector"]
    held = marked.select(*row, F.lit(False).alias("asks"), place(shards, 1).alias("shard"), every(blocks).alias("block"))
    asking = marked.filter("asks").select(*row, F.lit(True).alias("asks"), every(shards).alias("shard"), place(blocks, 2).alias("block"))
    found = held.unionByName(asking).groupBy("shard", "block").applyInPandas(_search_block(k), "query_id bigint, mark bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    repeated = marked.filter("asks AND n > 1").select(F.col("vec_id").alias("query_id"), "mark", "n")
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.coalesce("n", F.lit(1).cast("bigint"))))
    return ranked.join(repeated, ["query_id", "mark"], "left").withColumn("copy", copies).select("query_id", "rank", "vec_id", "score")


def scaled(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, vector): components as floor(scale * x); a vector that holds NULL or a non-finite component becomes NULL."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.select("vec_id", F.when(sound, F.transform(wide, lambda x: F.floor(F.lit(scale) * x))).alias("vector"))


def search_digest(embeddings: DataFrame) -> DataFrame:
    return search(scaled(embeddings), F.col("vec_id") % 50 == 0)


SEARCH_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.vec, c.vec) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""
