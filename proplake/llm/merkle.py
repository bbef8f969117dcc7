"""Merkle manifest of a table: a leaf for each row, a tree for each group, a tree over the groups, and every row's proof.

Leaves are placed without sorting them. Ids of a group are bits of bitmaps of 32,768, built by tasks and merged; each knows how
many leaves stand before it. The rank of an id is that number plus the set bits before its own, which a directory of popcounts
gives. Slots then go by number into arrays of 4,096, each reduced by twelve levels in a task, and so do the nodes that remain;
proofs come from the same arrays read from the top down.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proplake.functions.ranks import with_position
from proplake.functions.skew import join_by_weight
from proplake.session import cut_lineage

MAP_BITS = 15  # ids of one bitmap: those equal but for so many bits
ARRAY_LEVELS = 12  # levels that a slot array is reduced by
IDS_A_TASK = 1 << 17
SPARSE = 1 << 11  # fewer ids than this are kept as two bytes each, not as bits
NULL_MAP = -(1 << 49)  # below the number of any bitmap, so that NULL ids come first
STEP = "struct<hash:string,before:boolean>"


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """A value behind its length in bytes, so that no two rows give one text; NULL is '-'."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def packed(bits: bytes) -> bytes:
    """A bitmap as it is stored: the set places where they are few, else the bits, compressed where that is shorter."""
    places = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")).astype("<u2")
    if len(places) < SPARSE:
        return b"p" + places.tobytes()
    small = zlib.compress(bits, 1)
    return b"z" + small if len(small) < len(bits) else b"b" + bits


def ranks(stored: bytes, places: np.ndarray) -> np.ndarray:
    """Set places before each of ``places``."""
    if stored[:1] == b"p":
        return np.searchsorted(np.frombuffer(stored, "<u2", offset=1), places)
    words = np.frombuffer(zlib.decompress(stored[1:]) if stored[:1] == b"z" else stored[1:], "<u8")
    directory = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
    below = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
    return directory[places >> 6] + np.bitwise_count(words[places >> 6] & below)


def _running(df: DataFrame, group: str, order: str, value: str, into: str) -> DataFrame:
    """``df``, one row per (group, order), plus the sum of ``value`` over the group's earlier rows, from totals of sorted parts."""
    parts = cut_lineage(df.orderBy(group, order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(group, "_part").agg(F.sum(value).alias("_total")).withColumn("_earlier", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    inside = Window.partitionBy(group, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    near = parts.withColumn(into, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return near.join(totals.select(group, "_part", "_earlier"), [group, "_part"]).withColumn(into, F.col(into) + F.col("_earlier")).drop("_part", "_earlier")


def _place(carried: list[str]):
    """Ranks of the ids of some bitmaps: (bitmap's base + rank + repeats of smaller ids in the bitmap)."""
    def run(ids: pa.Table, maps: pa.Table) -> pa.Table:
        number = {key: i for i, key in enumerate(zip(maps["grp"].to_pylist(), maps["map"].to_pylist()))}
        owner = np.array([number[key] for key in zip(ids["grp"].to_pylist(), ids["map"].to_pylist())], dtype=np.int64)
        order = np.argsort(owner, kind="stable")
        edges = np.searchsorted(owner[order], np.arange(len(number) + 1))
        place, first = ids["place"].to_numpy(), np.zeros(len(owner), np.int64)
        base, total = maps["base"].to_numpy(), maps["total"].to_numpy()
        for i, (stored, more) in enumerate(zip(maps["ids"].to_pylist(), maps["more"].to_pylist())):
            rows = order[edges[i]:edges[i + 1]]
            first[rows] = base[i] + ranks(stored, place[rows])
            if more:
                repeated = sorted((m["place"], m["n"]) for m in more)
                extra = np.concatenate(([0], np.cumsum([n for _, n in repeated])))
                first[rows] += extra[np.searchsorted([p for p, _ in repeated], place[rows])]
        kept = [ids[c] for c in ("grp", "map", "place", "key", "n", "leaf", "mixed", *carried)]
        return pa.table([*kept, pa.array(first), pa.array(total[owner])], names=["grp", "map", "place", "key", "n", "leaf", "mixed", *carried, "first", "total"])

    return run


def coordinates(leaves: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(grp, key, leaf, carried..., first, n, total): the slots first to first + n - 1 of the n rows of one group, key and leaf.

    ``leaves`` has grp (string, not NULL), key (bigint), leaf (string) and the columns ``carried``, which must follow from the
    leaf. Keys ascend, NULL first; rows of one key ascend by leaf. Rows equal in all three are one row here, so a key that holds
    a third of the table is counted before any exchange; different leaves of one key are numbered in 65,536 parts by their
    first four digits. An empty table gives an empty result.
    """
    carried = list(carried)
    number = F.coalesce(F.shiftright("key", MAP_BITS), F.lit(NULL_MAP))
    place = F.coalesce(F.col("key").bitwiseAND((1 << MAP_BITS) - 1), F.lit(0))
    rows = leaves.select("grp", "key", "leaf", *carried, number.alias("map"), place.alias("place"))
    ids = cut_lineage(rows.groupBy("grp", "map", "place").agg(
        F.min("key").alias("key"), F.count(F.lit(1)).alias("n"), F.min("leaf").alias("leaf"),
        (F.min("leaf") != F.max("leaf")).alias("mixed"), *[F.min(c).alias(c) for c in carried]))
    tasks = 1 + ids.count() // IDS_A_TASK
    task = F.pmod(F.xxhash64("grp", "map"), F.lit(tasks)).alias("task")

    more = F.collect_list(F.when(F.col("n") > 1, F.struct("place", (F.col("n") - 1).alias("n"))))
    maps = ids.groupBy("grp", "map").agg(F.bitmap_construct_agg(F.col("place")).alias("bits"), F.sum("n").alias("n"), more.alias("more"))
    stored = F.pandas_udf(lambda bits: pd.Series([packed(b) for b in bits], dtype=object), "binary")
    placed = _running(maps.select("grp", "map", "n", "more", stored("bits").alias("ids")), "grp", "map", "n", "base")
    totals = placed.groupBy("grp").agg(F.sum("n").alias("total"))
    right = placed.join(totals, "grp").select(task, "grp", "map", "ids", "more", "base", "total")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {kinds.get(c) or t}" for c, t in [
        ("grp", ""), ("map", ""), ("place", ""), ("key", ""), ("n", "bigint"), ("leaf", ""), ("mixed", "boolean"), *[(c, "") for c in carried], ("first", "bigint"), ("total", "bigint")])
    found = cut_lineage(ids.select(task, *ids.columns).groupBy("task").cogroup(right.groupBy("task")).applyInArrow(_place(carried), schema))
    out = ["grp", "key", "leaf", *carried, "first", "n", "total"]
    mixed = found.filter("mixed").select("grp", "map", "place", "first", "n", "total")
    if mixed.isEmpty():
        return found.select(*out)
    key = ["grp", "map", "place"]
    several = join_by_weight(rows, mixed.withColumnRenamed("n", "rows"), key, "rows")
    several = cut_lineage(several.groupBy(*key, "leaf").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ["key", *carried, "first", "total"]]))
    several = several.withColumn("part", F.substring("leaf", 1, 4))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    parts = several.groupBy(*key, "part").agg(F.sum("n").alias("size"))
    parts = parts.select(*key, "part", F.coalesce(F.sum("size").over(earlier(*key).orderBy("part")), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n").over(earlier(*key, "part").orderBy("leaf")), F.lit(0))
    numbered = several.withColumn("inside", inside).join(parts, [*key, "part"]).withColumn("first", F.col("first") + F.col("before") + F.col("inside"))
    return found.filter("NOT mixed").select(*out).unionByName(numbered.select(*out))


def _levels(nodes: list[str], last: bool, most: int) -> list[list[str]]:
    """The nodes of a slot array by level, up to the one that remains. All but the ``last`` array of a tree go up by ``most``
    levels, in which a single node also becomes its hash."""
    out = [nodes]
    while len(out[-1]) > 1 if last else len(out) <= most:
        below = out[-1]
        out.append([hashlib.sha256("".join(below[i:i + 2]).encode()).hexdigest() for i in range(0, len(below), 2)])
    return out


def _array(rows: pa.Table, most: int) -> tuple[list[str], np.ndarray, np.ndarray, bool]:
    """(nodes by slot, row of each slot, slots in order of the rows, whether the tree ends here) of one array."""
    first, n = rows["first"].to_numpy(), rows["n"].to_numpy()
    row = np.repeat(np.arange(len(n)), n)
    slot = np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(row)) & (1 << most) - 1
    nodes, leaf = [""] * len(row), rows["leaf"].to_pylist()
    for s, r in zip(slot.tolist(), row.tolist()):
        nodes[s] = leaf[r]
    return nodes, row, slot, rows["total"][0].as_py() <= 1 << most


def _in_arrays(slots: DataFrame, most: int) -> DataFrame:
    """Runs of slots cut at the ends of arrays, with the number of their array."""
    array, end = F.explode(F.sequence(F.shiftright("first", most), F.shiftright(F.col("first") + F.col("n") - 1, most))), F.col("first") + F.col("n")
    cut = slots.withColumn("array", array)
    start = F.greatest(F.col("first"), F.shiftleft("array", most))
    stop = F.least(end, F.shiftleft(F.col("array") + 1, most))
    return cut.withColumns({"first": start, "n": stop - start})


def _reduced(slots: DataFrame, most: int) -> DataFrame:
    """The same columns, one row for each array: the node it reduces to, in the slot of its number."""
    def run(rows: pa.Table) -> pa.Table:
        nodes, _, _, last = _array(rows, most)
        top = _levels(nodes, last, most)[-1][0]
        return pa.table([rows["grp"][:1], rows["array"][:1], pa.array([1]), pa.array([-(-rows["total"][0].as_py() >> most)]), pa.array([top])], names=["grp", "first", "n", "total", "leaf"])

    arrays = _in_arrays(slots.select("grp", "first", "n", "total", "leaf"), most)
    return arrays.groupBy("grp", "array").applyInArrow(run, "grp string, first bigint, n bigint, total bigint, leaf string")


def _siblings(slots: DataFrame, paths: DataFrame, carried: list[str], most: int) -> DataFrame:
    """A row for each slot: (grp, first, total, leaf, carried..., path, subroot); ``paths`` has those of the arrays' own nodes."""
    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        nodes, row, slot, last = _array(rows, most)
        levels = _levels(nodes, last, most)[:-1]
        outer = above["path"][0].as_py()
        width = len(levels) + len(outer)
        hashes, before = np.full((len(slot), width), None, dtype=object), np.zeros((len(slot), width), dtype=bool)
        for level, held in enumerate(levels):
            own = slot >> level
            other = own ^ 1
            held = np.array([*held, None], dtype=object)
            hashes[:, level] = held[np.minimum(other, len(held) - 1)]
            before[:, level] = other < own
        for level, step in enumerate(outer, len(levels)):
            hashes[:, level], before[:, level] = step["hash"], step["before"]
        steps = pa.StructArray.from_arrays([pa.array(hashes.ravel(), pa.string()), pa.array(before.ravel())], names=["hash", "before"])
        path = pa.ListArray.from_arrays(pa.array(np.arange(len(slot) + 1, dtype=np.int32) * width), steps)
        first = (rows["array"][0].as_py() << most) + slot
        kept = [rows[c].take(pa.array(row)) for c in ("grp", "total", "leaf", *carried)]
        return pa.table([*kept, pa.array(first), path, pa.array([above["subroot"][0].as_py()] * len(slot), pa.string())], names=["grp", "total", "leaf", *carried, "first", "path", "subroot"])

    kinds = {f.name: f.dataType.simpleString() for f in slots.schema}
    schema = "grp string, total bigint, leaf string, " + "".join(f"`{c}` {kinds[c]}, " for c in carried) + f"first bigint, path array<{STEP}>, subroot string"
    arrays = _in_arrays(slots.select("grp", "first", "n", "total", "leaf", *carried), most)
    above = paths.select("grp", F.col("first").alias("array"), "path", "subroot")
    return arrays.groupBy("grp", "array").cogroup(above.groupBy("grp", "array")).applyInArrow(run, schema)


def _tree(slots: DataFrame, most: int) -> list[DataFrame]:
    """``slots`` and its reductions up to one node in each group."""
    out = [slots]
    largest = slots.agg(F.max("total")).first()[0] or 0
    while largest > 1 or len(out) == 1:  # a lone leaf is a node of its own, reduced by no level
        out.append(cut_lineage(_reduced(out[-1], most)))
        largest = -(-largest >> most)
    return out


def _down(tree: list[DataFrame], paths: DataFrame, carried: list[str], most: int) -> DataFrame:
    for slots in reversed(tree[1:-1]):
        paths = cut_lineage(_siblings(slots, paths, [], most))
    return _siblings(tree[0], paths, carried, most)


def manifest(leaves: DataFrame, carried: tuple[str, ...] = (), most: int = ARRAY_LEVELS) -> DataFrame:
    """(grp, key, leaf, carried..., slot, path, subroot, root): a row for each leaf; other columns of ``leaves`` are not read.

    ``leaves`` is as in ``coordinates``. ``path`` holds a step for each level from the leaf to the root: the hash of the other
    node of its run and whether that stands before, with a NULL hash where the run has one node. Groups ascend by their bytes.
    Equal rows each have their slot and proof. No key, group or run of copies is gathered: tasks hold at most 2**``most`` slots, the
    driver one root. An empty table gives an empty result.
    """
    carried = list(carried)
    slots = coordinates(leaves, tuple(carried))
    tree = _tree(cut_lineage(slots.select("grp", "key", *carried, "first", "n", "total", "leaf")), most)
    groups = cut_lineage(with_position(tree[-1].select(F.col("grp").alias("of"), F.col("leaf")), [F.col("of")], "first", 0))
    top = _tree(groups.select(F.lit("").alias("grp"), "of", "first", F.lit(1).cast("bigint").alias("n"), F.lit(groups.count()).cast("bigint").alias("total"), "leaf"), most)
    root = (top[-1].first() or {"leaf": None})["leaf"]
    ends = top[-1].select("grp", "first", F.array().cast(f"array<{STEP}>").alias("path"), F.col("leaf").alias("subroot"))
    over = _down(top, ends, ["of"], most).select(F.col("of").alias("grp"), F.lit(0).cast("bigint").alias("first"), "path", F.col("leaf").alias("subroot"))
    found = _down(tree, cut_lineage(over), ["key", *carried], most)
    return found.select("grp", "key", "leaf", *carried, F.col("first").alias("slot"), "path", "subroot", F.lit(root).cast("string").alias("root"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the steps of its proof give."""
    step = lambda node, s: F.when(s["hash"].isNull(), hashed(node)).when(s["before"], hashed(s["hash"], node)).otherwise(hashed(node, s["hash"]))
    return F.aggregate(path, leaf, step)


def proof_hash(path: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: s["hash"])), 256)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")  # of a leaf, in this order


def document_leaves(documents: DataFrame) -> DataFrame:
    """(grp, key, leaf, tampered): of each document, in the group of its language (NULL apart from ''), with the leaf of the row
    whose n_chars is one more where 7 divides the crc32 of the id. Whole texts are hashed where they are read."""
    leaf = lambda n_chars: hashed(*[framed(n_chars if c == "n_chars" else F.col(c)) for c in FIELDS])
    altered = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    group = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    return documents.select(group.alias("grp"), F.col("doc_id").cast("bigint").alias("key"), leaf(F.col("n_chars")).alias("leaf"), F.when(altered, leaf(F.col("n_chars") + 1)).alias("tampered"))


def manifest_digest(documents: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document.

    NULL fields are part of the leaf; rows with a NULL id come first in their group and are never tampered with; rows of one id
    ascend by their leaf.
    """
    proved = manifest(cut_lineage(document_leaves(documents)), ("tampered",))
    out = proved.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"),
                        folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


# The checksum folds a list of steps: a byte, then eight shifts.
MANIFEST_SQL = """
WITH RECURSIVE sums AS (SELECT *, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc FROM documents),
framed AS (SELECT doc_id, lang, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS size, CASE WHEN crc % 7 = 0 THEN strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) END AS other_size,
    coalesce(strlen(text) || ':' || text, '-') AS tail FROM sums),
leaves AS (SELECT doc_id, lang, sha256(head || size || tail) AS leaf, sha256(head || coalesce(other_size, size) || tail) AS used FROM framed),
slots AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
tree(lang, level, slot, h, n) AS (SELECT lang, 0, slot, leaf, n FROM slots UNION ALL
  SELECT lang, level + 1, slot // 2, sha256(string_agg(h, '' ORDER BY slot)), (any_value(n) + 1) // 2 FROM tree WHERE n > 1 GROUP BY lang, level, slot // 2),
subroots AS (SELECT lang, level AS depth, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS slot, count(*) OVER () AS n FROM tree WHERE n = 1),
top(level, slot, h, n) AS (SELECT 0, slot, h, n FROM subroots UNION ALL
  SELECT level + 1, slot // 2, sha256(string_agg(h, '' ORDER BY slot)), (any_value(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY level, slot // 2),
root AS (SELECT h, level AS depth FROM top WHERE n = 1),
steps AS (SELECT s.r, l.level, s.slot >> l.level AS own, s.lang, true AS lower FROM slots s JOIN subroots g ON s.lang IS NOT DISTINCT FROM g.lang, LATERAL (SELECT unnest(range(0, g.depth)) AS level) l UNION ALL
  SELECT s.r, g.depth + l.level, g.slot >> l.level, s.lang, false FROM slots s JOIN subroots g ON s.lang IS NOT DISTINCT FROM g.lang, LATERAL (SELECT unnest(range(0, root.depth)) AS level FROM root) l),
path AS (SELECT p.r, p.level, p.own, coalesce(t.h, o.h) AS h FROM steps p JOIN slots s ON s.r = p.r JOIN subroots g ON g.lang IS NOT DISTINCT FROM s.lang
  LEFT JOIN tree t ON p.lower AND t.lang IS NOT DISTINCT FROM p.lang AND t.level = p.level AND t.slot = xor(p.own, 1)
  LEFT JOIN top o ON NOT p.lower AND o.level = p.level - g.depth AND o.slot = xor(p.own, 1)),
fold(r, level, h) AS (SELECT r, 0, used FROM slots UNION ALL
  SELECT f.r, f.level + 1, sha256(CASE WHEN p.h IS NULL THEN f.h WHEN p.own % 2 = 1 THEN p.h || f.h ELSE f.h || p.h END) FROM fold f JOIN path p ON p.r = f.r AND p.level = f.level),
ends AS (SELECT r, arg_max(h, level) AS h FROM fold GROUP BY r),
proofs AS (SELECT r, sha256(coalesce(string_agg(h, '' ORDER BY level), '')) AS h FROM path GROUP BY r)
SELECT s.doc_id, s.leaf, g.h AS subroot, root.h AS root, coalesce(p.h, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = root.h AS verified
FROM slots s JOIN subroots g ON g.lang IS NOT DISTINCT FROM s.lang JOIN ends e ON e.r = s.r LEFT JOIN proofs p ON p.r = s.r CROSS JOIN root"""
