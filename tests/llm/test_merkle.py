"""The manifest's coordinates, proofs and roots against plain Python."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from proplake.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, n_chars):
    framed = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], n_chars, row[1])]
    return sha("".join(framed))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, at):
    for level in tree[:-1]:
        yield (level[at ^ 1] if at ^ 1 < len(level) else None), at & 1
        at >>= 1


def expected(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, leaf(row, row[4]), row))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = levels([trees[g][-1][0] for g in order]) if order else []
    out = []
    for k, g in enumerate(order):
        for at, (_, _, own, row) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = [*siblings(trees[g], at), *siblings(top, k)]
            node = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[4] is not None:
                node = leaf(row, row[4] + 1)
            for other, before in path:
                node = sha(node if other is None else other + node if before else node + other)
            root = top[-1][0]
            out.append((row[0], own, trees[g][-1][0], root, sha("".join(h for h, _ in path if h)), node, node == root))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def digest(df, most):
    proved = merkle.manifest(merkle.document_leaves(df), ("tampered",), most=most)
    path = F.col("path")
    return proved.select("key", "leaf", "subroot", "root", merkle.proof_hash(path), merkle.folded(F.coalesce("tampered", "leaf"), path).alias("f")).withColumn("v", F.col("f") == F.col("root"))


def awkward():
    draw = np.random.default_rng(5)
    ids = [*range(40), *(2**15 * k - 1 for k in range(5)), -1, -2**15, -2**40, 2**62, *draw.integers(-2**62, 2**62, 30).tolist()]
    rows = [(i, f"t{i}", ["a", "b", None, "", "ä"][k % 5], "s", k if k % 3 else None) for k, i in enumerate(ids)]
    return [*rows, *[(7, "same", "a", None, 1)] * 60, *[(7, f"other {k}", "a", None, 1) for k in range(40)], *[(None, f"n{k % 9}", "a", "s", k % 9) for k in range(30)], (1, None, "alone", None, None)]


def test_manifest_digest(documents, edge, nothing):
    for df in (documents, edge):
        assert rows_of(merkle.manifest_digest(df)) == expected([tuple(r) for r in df.select(*[f.split()[0] for f in SCHEMA.split(", ")]).collect()])
    assert merkle.manifest_digest(nothing).count() == 0


@pytest.mark.parametrize("most", [1, 3, 12])
def test_many_arrays_repeated_and_distant_ids(spark, most):
    rows = awkward()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("total", F.lit("clash")).withColumn("map", F.lit(0)).repartition(4)
    assert rows_of(digest(df, most)) == expected(rows)
    assert rows_of(digest(spark.createDataFrame(rows[:1], SCHEMA), most)) == expected(rows[:1])


def test_many_groups(spark):
    rows = [(i, "x", f"g{i % 37:02d}", "s", 1) for i in range(90)]
    assert rows_of(digest(spark.createDataFrame(rows, SCHEMA), 2)) == expected(rows)


def test_stored_bitmaps_give_ranks():
    draw = np.random.default_rng(0)
    for n in (1, 100, 2047, 2048, 20_000, 32_768):
        places = np.sort(draw.choice(1 << 15, n, replace=False))
        bits = np.zeros(1 << 15, np.uint8)
        bits[places] = 1
        stored = merkle.packed(np.packbits(bits, bitorder="little").tobytes())
        assert merkle.ranks(stored, places).tolist() == list(range(n))


def test_slots_and_paths(spark):
    leaves = spark.createDataFrame([("g", i, sha(str(i)), "c") for i in range(10)], "grp string, key bigint, leaf string, first string")
    out = merkle.manifest(leaves, most=2)
    assert [(r["key"], r["slot"]) for r in out.orderBy("key").collect()] == [(i, i) for i in range(10)]
    assert out.filter(merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).count() == 10
