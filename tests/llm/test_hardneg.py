"""Hard negatives against plain Python over all pairs of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from proplake.llm import hardneg

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def expected(rows, asks, k=5, m=5, percent=80):
    held = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            held.append((i, [int(np.floor(256 * x)) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for at, (i, v, label) in enumerate(held):
        if not asks(i):
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for k, (j, w, other) in enumerate(held) if k != at)
        for s, p, _ in [x for x in scores if x[2] == label][:k]:
            fits = [x for x in scores if x[2] != label and percent * -s <= 100 * -x[0] <= 100 * -s]
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j, _) in enumerate(fits[:m])]
    return sorted(out, key=repr)


def drawn(seed, n, width, labels, spread=1.0, centres=0):
    draw = np.random.default_rng(seed)
    middle = draw.normal(0, spread, (max(1, centres), width)) * (centres > 0)
    return [(i, [float(x) for x in np.round(middle[i % max(1, centres)] + draw.normal(0, spread / 3, width), 2)], int(draw.integers(0, labels))) for i in range(n)]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


ROWS = {
    "plain": drawn(1, 500, 16, 10),
    "clusters and one label": drawn(2, 420, 8, 2, centres=5),
    "ties": [(i, [0.5, 0.5], i % 3) for i in range(330)],
    "zeros": [(i, [0.0, 0.0], i % 2) for i in range(210)],
    "few": [(0, [1.0], 0), (100, [1.0], 0), (1, [0.9], 3)],
    "none": [],
    "no anchor": [(1, [1.0], 0), (2, [1.0], 1)],
    "awkward": [*drawn(3, 260, 4, 3), (None, [1.0] * 4, 1), (300, None, 1), (400, [1.0, None, 1.0, 1.0], 1), (500, [float("nan")] * 4, 1), (600, [float("inf")] * 4, 2), (700, [1.0] * 4, None),
                (800, [], 1), (900, [0.3], 1), *[(100, [0.4] * 4, 2)] * 4, *[(31, [0.4] * 4, 2)] * 9, *[(32, [0.39] * 4, 1)] * 8, *drawn(4, 130, 4, 3), *drawn(3, 260, 4, 3)],
}


@pytest.mark.parametrize("name", ROWS)
def test_negatives(spark, name):
    df = spark.createDataFrame(ROWS[name], SCHEMA).withColumn("mark", F.lit("clash")).withColumn("block", F.lit(1))
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    assert rows_of(hardneg.negatives_digest(df)) == expected(rows, lambda i: i % 100 == 0)


@pytest.mark.parametrize("name", ["plain", "clusters and one label", "awkward"])
def test_many_blocks_lists_and_clusters(spark, name):
    df = spark.createDataFrame(ROWS[name], SCHEMA)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    out = hardneg.mine(hardneg.labelled_vectors(df), F.col("vec_id") % 9 == 0, positives=3, negatives=4, percent=60, list_numbers=600, block_numbers=90, anchors_a_cluster=8)
    assert rows_of(out) == expected(rows, lambda i: i % 9 == 0, 3, 4, 60)


def test_bounds_hold_and_lists_end_early():
    draw = np.random.default_rng(7)
    middle = draw.normal(size=(6, 12))
    anchors, items = middle[draw.integers(0, 6, 90)] + draw.normal(0, 0.2, (90, 12)), middle[draw.integers(0, 6, 3000)] + draw.normal(0, 0.2, (3000, 12))
    held = hardneg.centres(anchors, 6)
    apart = hardneg.angles(anchors, held)
    own = np.argmin(apart, axis=1)
    spread = np.array([apart[own == c, c].max(initial=0) for c in range(6)])
    bounds = hardneg.upper_bounds(items, held, spread)
    scores = anchors @ items.T / np.linalg.norm(anchors, axis=1)[:, None]
    assert (scores <= bounds[:, own].T + 1e-9).all()
    seen = []
    for c in np.unique(own):
        order = np.argsort(-bounds[:, c], kind="stable")
        best = hardneg.Best(int((own == c).sum()), 5)
        seen.append(hardneg.walk(bounds[order, c], best.floor, lambda active, at: best.add(active, scores[own == c][active][:, order[at]], order[at]), len(best.scores)))
        assert np.allclose(best.scores, -np.sort(-scores[own == c], axis=1)[:, :5])
    assert min(seen) < 3000
