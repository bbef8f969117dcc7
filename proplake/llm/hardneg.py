"""Hard negatives by shared candidate lists, one for each cluster of anchors.

Anchors are clustered by direction. Of a candidate at angle t from a cluster's centre, and anchors within b of it, no anchor's
score exceeds the product of both norms times cos(t - b). A cluster's list holds the candidates by this bound, sorted once for all
of its anchors; each anchor walks it until what follows can no longer enter its results. Which clusters a candidate is sent to
is decided by the same bound against what the anchors are known to reach, so nothing that could matter stays away.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proplake.session import cut_lineage

POSITIVES, NEGATIVES = 5, 5
LEAST_PERCENT = 80  # of the positive's score that a negative must reach
ANCHORS_A_CLUSTER, MOST_CLUSTERS = 64, 256
LIST_NUMBERS, BLOCK_NUMBERS = 1 << 21, 1 << 18  # components of the candidates and of the anchors that meet in a task
FLOOR_GROUP = 2_048  # anchors compared with each other for a first bound
STEP = 256  # places of a list walked at once
SLACK = 1e-6  # of a candidate's norm: above what rounding can take from an angle
COPIES = 6  # of equal rows, more than any anchor can list beside itself


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, missing components 0."""
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(held) else np.zeros(0, np.int64)
    out = np.zeros((len(held), width))
    values = held.flatten().to_numpy(zero_copy_only=False)
    if len(values):
        row = np.repeat(np.arange(len(sizes)), sizes)
        out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.linalg.norm(vectors, axis=1)
    return vectors / np.where(norms > 0, norms, 1)[:, None], norms


def centres(vectors: np.ndarray, clusters: int, rounds: int = 8) -> np.ndarray:
    """Directions of ``clusters`` groups of ``vectors``, by spherical k-means from the first ones."""
    units, _ = _units(vectors)
    held = units[:clusters].copy()
    for _ in range(rounds):
        nearest = np.argmax(units @ held.T, axis=1)
        sums = np.zeros_like(held)
        np.add.at(sums, nearest, units)
        moved, norms = _units(sums)
        held[norms > 0] = moved[norms > 0]
    return held


def angles(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    units, _ = _units(vectors)
    return np.arccos(np.clip(units @ centres.T, -1, 1))


def upper_bounds(vectors: np.ndarray, centres: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """(vector, centre): the most that an anchor of norm 1 within ``spread`` of the centre can score."""
    norms = np.linalg.norm(vectors, axis=1)[:, None]
    return norms * np.cos(np.clip(angles(vectors, centres) - spread, 0, np.pi)) + SLACK * norms


class Best:
    """The ``k`` best (score, id) of each member, ties to the smaller id."""

    def __init__(self, members: int, k: int):
        self.k = k
        self.scores = np.full((members, k), -np.inf)
        self.ids = np.full((members, k), np.iinfo(np.int64).max)

    def floor(self, members) -> np.ndarray:
        return self.scores[members, -1]

    def add(self, members: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of candidates ``ids`` for some members; -inf takes no part."""
        enters = (scores >= self.scores[members, -1:]) & (scores > -np.inf)
        changed = np.flatnonzero(enters.any(axis=1))
        if not len(changed):
            return
        members, useful = members[changed], enters[changed].any(axis=0)
        scores, ids = scores[np.ix_(changed, useful)], ids[useful]
        scores = np.concatenate((self.scores[members], scores), axis=1)
        ids = np.concatenate((self.ids[members], np.broadcast_to(ids, (len(members), len(ids)))), axis=1)
        order = np.lexsort((ids, -scores), axis=1)[:, :self.k]
        self.scores[members] = np.take_along_axis(scores, order, axis=1)
        self.ids[members] = np.take_along_axis(ids, order, axis=1)


def walk(bounds: np.ndarray, reach, visit, members: int) -> int:
    """Walk a list by falling ``bounds`` until no member can gain; returns the places visited by any.

    ``reach(active)`` gives the lowest bound at which each active member may still gain, ``visit(active, places)`` takes in a
    step of the list.
    """
    active, at = np.arange(members), 0
    while at < len(bounds):
        active = active[bounds[at] >= reach(active)]
        if not len(active):
            break
        visit(active, slice(at, at + STEP))
        at += STEP
    return min(at, len(bounds))


def _read(table: pa.Table, width: int) -> dict:
    out = {name: table[name].to_numpy() for name in table.column_names if name not in ("vector", "positives", "block", "shard")}
    return out | {"vector": _matrix(table["vector"], width)}


def _lists(anchors: pa.Table, candidates: pa.Table, plan: dict):
    """(members, ids, marks, labels, first copies, vectors, bounds) of the list of each cluster in a block."""
    a, c = _read(anchors, plan["width"]), _read(candidates, plan["width"])
    copies = np.minimum(c["n"], COPIES)
    row = np.repeat(np.arange(len(copies)), copies)
    first = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
    for cluster in np.unique(a["cluster"]):
        bounds = upper_bounds(c["vector"], plan["centres"][[cluster]], plan["spread"][[cluster]])[row, 0]
        order = np.argsort(-bounds, kind="stable")
        yield a, np.flatnonzero(a["cluster"] == cluster), c, row[order], first[order], bounds[order]


def _positives(plan: dict, k: int):
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out = [np.zeros((4, 0), np.int64)]
        for a, members, c, row, first, bounds in _lists(anchors, candidates, plan) if len(anchors) and len(candidates) else []:
            for label in np.unique(a["label"][members]):
                own = members[a["label"][members] == label]
                same = c["label"][row] == label
                at, once, cap = row[same], first[same], bounds[same]
                best, vectors = Best(len(own), k), a["vector"][own]
                norms = np.linalg.norm(vectors, axis=1)
                low = a["low"][own].astype(float)

                def reach(active):
                    least = np.maximum(low[active], best.floor(active))
                    return np.where(norms[active] > 0, least / np.where(norms[active] > 0, norms[active], 1), -np.inf)

                def visit(active, places):
                    rows = at[places]
                    scores = vectors[active] @ c["vector"][rows].T
                    itself = (a["id"][own[active], None] == c["id"][rows]) & (a["mark"][own[active], None] == c["mark"][rows]) & once[places]
                    scores[itself] = -np.inf
                    best.add(active, scores, c["id"][rows])

                walk(cap, reach, visit, len(own))
                who, place = np.nonzero(best.scores > -np.inf)
                out.append(np.stack((a["id"][own][who], a["mark"][own][who], best.ids[who, place], best.scores[who, place].astype(np.int64))))
        return pa.table(list(np.concatenate(out, axis=1)), names=["anchor_id", "mark", "positive_id", "positive_score"])

    return run


def _negatives(plan: dict, k: int, percent: int):
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out = [np.zeros((5, 0), np.int64)]
        wanted = [np.array(p, dtype=float) for p in anchors["positives"].to_pylist()]
        for a, members, c, row, first, bounds in _lists(anchors, candidates, plan) if len(anchors) and len(candidates) else []:
            vectors = a["vector"][members]
            norms = np.linalg.norm(vectors, axis=1)
            most = max(len(wanted[m]) for m in members)
            tops = np.array([np.pad(wanted[m], (0, most - len(wanted[m])), constant_values=-1) for m in members])  # -1: none
            found = [Best(len(members), k) for _ in range(most)]

            def reach(active):
                least = np.min([np.where(tops[active, j] >= 0, np.maximum(tops[active, j] * percent / 100, best.floor(active)), np.inf) for j, best in enumerate(found)], axis=0)
                return np.where(norms[active] > 0, (least - SLACK) / np.where(norms[active] > 0, norms[active], 1), -np.inf)

            def visit(active, places):
                rows = row[places]
                scores = vectors[active] @ c["vector"][rows].T
                scores[a["label"][members[active], None] == c["label"][rows]] = -np.inf
                for j, best in enumerate(found):
                    top = tops[active, j, None]
                    fits = (scores <= top) & (100 * scores >= percent * top) & (top >= 0)
                    best.add(active, np.where(fits, scores, -np.inf), c["id"][rows])

            walk(bounds, reach, visit, len(members))
            for j, best in enumerate(found):
                who, place = np.nonzero(best.scores > -np.inf)
                out.append(np.stack((a["id"][members][who], a["mark"][members][who], tops[who, j].astype(np.int64), best.ids[who, place], best.scores[who, place].astype(np.int64))))
        return pa.table(list(np.concatenate(out, axis=1)), names=["anchor_id", "mark", "positive_score", "negative_id", "negative_score"])

    return run


def _first_bounds(width: int, k: int):
    """The ``k``-th best score of each anchor among anchors of its label: what its ``k``-th positive reaches at least."""
    def run(rows: pa.Table) -> pa.Table:
        held = _read(rows, width)
        copies = np.minimum(held["n"], COPIES)
        owner = np.repeat(np.arange(len(copies)), copies)
        low = np.full(len(copies), -np.inf)
        if len(owner) > k:
            for at in range(0, len(copies), STEP):
                scores = (held["vector"][at:at + STEP] @ held["vector"].T)[:, owner]
                starts = np.cumsum(copies) - copies
                size = len(scores)
                scores[np.arange(size), starts[at:at + size]] = -np.inf  # one copy of each is itself
                low[at:at + size] = np.partition(scores, -k, axis=1)[:, -k]
        return pa.table([rows["id"], rows["mark"], pa.array(low)], names=["id", "mark", "low"])

    return run


def _sent(plan: dict, need: np.ndarray):
    """Blocks of anchors in which a candidate can matter."""
    def run(vectors: pd.Series) -> pd.Series:
        held = _matrix(pa.array(vectors, pa.list_(pa.int64())), plan["width"])
        passes = upper_bounds(held, plan["centres"], plan["spread"]) >= need
        blocks = np.zeros((len(held), int(plan["last"].max()) + 2), dtype=np.int32)
        for cluster in np.flatnonzero(need < np.inf):
            blocks[passes[:, cluster], plan["first"][cluster]] += 1
            blocks[passes[:, cluster], plan["last"][cluster] + 1] -= 1
        reached = np.cumsum(blocks, axis=1)[:, :-1] > 0
        return pd.Series([np.flatnonzero(r).astype(np.int32) for r in reached], dtype=object)

    return F.pandas_udf(run, "array<int>")("vector")


def _meet(anchors: DataFrame, rows: DataFrame, plan: dict, need: np.ndarray, run, schema: str) -> DataFrame:
    """Each block of anchors beside the candidates of each shard that can matter to it."""
    shards = plan["shards"]
    asked = anchors.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    shard = F.pmod(F.xxhash64(F.lit(1), "id", "mark"), F.lit(shards)).cast("int")
    held = rows.select("id", "mark", "label", "n", "vector", shard.alias("shard"), F.explode(_sent(plan, need)).alias("block"))
    return asked.groupBy("block", "shard").cogroup(held.groupBy("block", "shard")).applyInArrow(run, schema)


def _needs(anchors: DataFrame, low: Column, clusters: int) -> np.ndarray:
    """By cluster, the lowest bound that matters to any anchor; at most MOST_CLUSTERS numbers. No anchor: infinity."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    least = F.when(norm > 0, low / norm).otherwise(float("-inf"))
    need = np.full(clusters, np.inf)
    for r in anchors.groupBy("cluster").agg(F.min(least).alias("least")).collect():
        need[r["cluster"]] = r["least"] - SLACK * (1 + abs(r["least"])) if np.isfinite(r["least"]) else r["least"]
    return need


def mine(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = LEAST_PERCENT,
         list_numbers: int = LIST_NUMBERS, block_numbers: int = BLOCK_NUMBERS, anchors_a_cluster: int = ANCHORS_A_CLUSTER) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row where ``anchors`` holds.

    ``vectors`` has vec_id (bigint), label (bigint) and vector (array<bigint>); other columns are not read. Rows with a NULL id,
    label, vector or component take no part; missing components count as 0; scores are exact below 2**53. An anchor's positives
    are its ``positives`` best other rows of its label; for each, the ``negatives`` best rows of other labels with a score from
    ``percent`` % of the positive's up to all of it. Ties go to the smaller vec_id. Repeated rows are rows: equal ones are
    one row with a count until the end, so copies of one row never meet in a task. Pairs without a negative give no row; an
    empty table or no anchor gives an empty result.

    A task holds ``list_numbers`` components of candidates and ``block_numbers`` of anchors; centres are fitted on at most
    ``list_numbers`` components of anchors, which changes the cost and never the result.
    """
    spark = vectors.sparkSession
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    named = vectors.filter(usable).select(F.col("vec_id").alias("id"), "label", "vector", F.coalesce(anchors, F.lit(False)).alias("asks"))
    rows = named.groupBy("id", "label", "vector", "asks").agg(F.count(F.lit(1)).alias("n"))
    rows = cut_lineage(rows.withColumn("mark", F.xxhash64("label", "vector", "asks")))
    n, n_anchors, width = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(F.size("vector"))).first()
    if not n_anchors:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    width = max(1, width)
    clusters = max(1, min(n_anchors // anchors_a_cluster, MOST_CLUSTERS))
    asking = rows.filter("asks")
    sample = asking.orderBy(F.xxhash64(F.lit(2), "id", "mark"), "id", "mark").limit(max(clusters, list_numbers // width)).select("vector").toPandas()
    middle = centres(_matrix(pa.array(sample["vector"], pa.list_(pa.int64())), width), clusters)

    def nearest(held: pd.Series) -> pd.DataFrame:
        apart = angles(_matrix(pa.array(held, pa.list_(pa.int64())), width), middle)
        empty = np.array([not np.any(v) for v in held], dtype=bool)  # no direction: every bound holds for it
        return pd.DataFrame({"cluster": np.argmin(apart, axis=1).astype(np.int32), "apart": np.where(empty, 0.0, apart.min(axis=1))})

    placed = cut_lineage(asking.withColumn("near", F.pandas_udf(nearest, "cluster int, apart double")("vector")).select("id", "mark", "label", "n", "vector", "near.*"))
    sizes, spread = np.zeros(clusters, np.int64), np.zeros(clusters)
    for r in placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("apart")).collect():
        sizes[r["cluster"]], spread[r["cluster"]] = r["n"], r["apart"]
    block = max(1, block_numbers // width)
    starts = np.cumsum(sizes) - sizes
    plan = {"width": width, "centres": middle, "spread": spread, "first": starts // block, "last": np.maximum(starts + sizes - 1, starts) // block,
            "shards": max(1, -(-n // max(1, list_numbers // width)))}
    edge = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("cluster") + 1)
    number = edge(starts) + F.pmod(F.xxhash64(F.lit(3), "id", "mark"), edge(np.maximum(sizes, 1)))
    blocks = placed.withColumn("block", F.floor(number / block).cast("int"))

    deal = F.pmod(F.xxhash64(F.lit(4), "id", "mark"), F.lit(-(-n_anchors // FLOOR_GROUP)))
    low = placed.withColumn("deal", deal).groupBy("label", "deal").applyInArrow(_first_bounds(width, positives), "id bigint, mark bigint, low double")
    first = cut_lineage(blocks.join(low, ["id", "mark"]).select("block", "id", "mark", "label", "cluster", "vector", "low"))
    best = lambda *by: Window.partitionBy(*by)
    found = _meet(first, rows, plan, _needs(first, F.col("low"), clusters), _positives(plan, positives),
                  "anchor_id bigint, mark bigint, positive_id bigint, positive_score bigint")
    ranked = found.withColumn("place", F.row_number().over(best("anchor_id", "mark").orderBy(F.desc("positive_score"), "positive_id")))
    pairs = cut_lineage(ranked.filter((F.col("place") <= positives) & (F.col("positive_score") >= 0)))

    scores = pairs.groupBy(F.col("anchor_id").alias("id"), "mark").agg(F.sort_array(F.collect_set("positive_score")).alias("positives"))
    second = cut_lineage(blocks.join(scores, ["id", "mark"]).select("block", "id", "mark", "label", "cluster", "vector", "positives"))
    found = _meet(second, rows, plan, _needs(second, F.col("positives")[0] * percent / 100, clusters), _negatives(plan, negatives, percent),
                  "anchor_id bigint, mark bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    by_score = best("anchor_id", "mark", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    kept = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= negatives)
    out = pairs.join(kept, ["anchor_id", "mark", "positive_score"])
    copies = placed.select(F.col("id").alias("anchor_id"), "mark", F.col("n").alias("copies"))
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    return out.join(copies, ["anchor_id", "mark"]).withColumn("copy", each).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def labelled_vectors(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, label, vector): components as floor(scale * x), NULL for vectors with NULL or non-finite ones; where 7 divides
    vec_id the label is the next of ten."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("bigint")
    return embeddings.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
                             F.when(sound, F.transform(wide, lambda x: F.floor(F.lit(scale) * x))).alias("vector"))


def negatives_digest(embeddings: DataFrame) -> DataFrame:
    return mine(labelled_vectors(embeddings), F.col("vec_id") % 100 == 0)


NEGATIVES_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.r AS a, a.vec_id AS anchor_id, c.r AS c, c.vec_id AS id, c.label = a.label AS same, CAST(list_dot_product(a.vec, c.vec) AS BIGINT) AS score
  FROM v a JOIN v c ON a.r <> c.r WHERE a.vec_id % 100 = 0),
pos AS (SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.c ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM pos p JOIN scores n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score QUALIFY rank <= 5"""
