"""Duplicate listings across portals: matching, clusters, and what is known about each cluster.

Two listings match when bedrooms agree, monthly prices differ by at most 2 %, and either their full postcodes agree or,
when one side has no usable postcode, they lie within 50 m. No step lists the pairs inside a group. Equal listings collapse
first; on a sorted price line the band is settled by neighbours alone; and only coordinates need a candidate join.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proplake.config import DUPLICATE_RADIUS_M, EARTH_RADIUS_M, OUTCODE_ONLY_PORTALS, PREFERRED_PORTAL, PRICE_BAND
from proplake.functions.geo import cell, haversine, neighbour_cells, parent_cell, space
from proplake.functions.graph import connected_components
from proplake.functions.hull import farthest_pair, hulls_of_runs
from proplake.functions.ranks import with_position
from proplake.functions.sequence import micros
from proplake.functions.skew import join_by_weight
from proplake.functions.text import normal_postcode
from proplake.operators.gate import price_pcm
from proplake.session import cut_lineage

FINE_EDGE_M = DUPLICATE_RADIUS_M / 3 ** 0.5 * 0.999  # any two points of one such cube are within the radius
BLOCK = ("bedrooms", "kind", "block")
KEY_COLUMNS = ("uid", "bedrooms", "latitude", "longitude")  # that a listing's keys hold unchanged
LIST_WORK = 4_096  # pairs of points that two cubes compare one by one
POINT = ("bedrooms", "pcm", "latitude", "longitude", "kind", "node", "component", "n")
ENRICHMENT_FIELDS = ("size_sqft", "epc_rating", "floorplan_data", "tube_distance", "commute_primary")


def in_band(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.least(a, b) <= F.lit(PRICE_BAND)


def _price_bucket(pcm: Column) -> Column:
    """Buckets five bands wide, so a price's band touches at most two of them."""
    return F.floor(F.log(pcm.cast("double")) / F.lit(5 * 0.0198026)).cast("int")


def _bucket_reach(pcm: Column) -> Column:
    """All buckets a partner's price can fall in."""
    low, high = pcm / F.lit(1 + PRICE_BAND * 1.001), pcm * F.lit(1 + PRICE_BAND * 1.001)
    return F.sequence(_price_bucket(low), _price_bucket(high))


def match_keys(df: DataFrame, outcode_only: tuple[str, ...] = OUTCODE_ONLY_PORTALS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(uid, bedrooms, pcm, postcode, latitude, longitude, kind): ``P`` matches by postcode, ``G`` by place only."""
    pc = F.when(~F.coalesce(F.col("portal").isin(list(outcode_only)), F.lit(False)), normal_postcode(F.col("postcode")))
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    usable = F.col("bedrooms").isNotNull() & (F.col("pcm") > 0)
    return df.select("uid", "bedrooms", price_pcm(F.col("price_numeric")).alias("pcm"), pc.alias("pc"), "latitude", "longitude",
                     *keep).withColumn(
        "kind", F.when(usable & F.col("pc").isNotNull(), "P").when(usable & located, "G")
    )


def _runs(groups: DataFrame) -> DataFrame:
    """Label distinct prices of a block that chain together inside the band; ``node`` is the number of the run's first row.

    Input: one row per (BLOCK, pcm), numbered. A gap wider than the band between neighbours cannot be bridged by any other
    pair of the block.
    """
    line = Window.partitionBy("hashed", *BLOCK).orderBy("pcm")
    before = F.lag("pcm").over(line)
    first = groups.withColumn("hashed", F.xxhash64(*BLOCK)).withColumn("first", F.when(before.isNull() | ~in_band(before, F.col("pcm")), F.col("number")))
    return first.withColumn("node", F.last("first", True).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("hashed", "first", "number")


def match_blocks(keys: DataFrame) -> DataFrame:
    """``keys`` with ``block`` for their postcode: the postcode of P, the cube of G, NULL of neither. Written, as it is read again."""
    fine = cell(F.col("latitude"), F.col("longitude"), FINE_EDGE_M)
    named = F.when(F.col("kind") == "P", F.col("pc")).when(F.col("kind") == "G", F.concat_ws(" ", *[fine[n] for n in "xyz"]))
    return cut_lineage(keys.withColumn("block", named).drop("pc"))


def match_spots(blocks: DataFrame, named: bool = True) -> DataFrame:
    """(BLOCK, pcm, latitude, longitude, n, rep if ``named``): the one grouping that reads all listings.

    The smallest uid, a string, makes it sort; a hash in front decides nearly all of its comparisons.
    """
    keys = (*BLOCK, "pcm", "latitude", "longitude")
    grouped = blocks.filter("kind IS NOT NULL").groupBy(F.xxhash64(*keys).alias("spot"), *keys)
    return cut_lineage(grouped.agg(F.count("*").alias("n"), *([F.min("uid").alias("rep")] if named else [])).drop("spot"))


def match_runs(spots: DataFrame) -> DataFrame:
    """(BLOCK, pcm, n, rep if there, node): distinct prices of each block and the run they are of."""
    rep = [F.min("rep").alias("rep")] if "rep" in spots.columns else []
    groups = cut_lineage(spots.groupBy(F.xxhash64(*BLOCK, "pcm").alias("group"), *BLOCK, "pcm").agg(F.sum("n").alias("n"), *rep).drop("group"))
    return _runs(groups.withColumn("number", F.monotonically_increasing_id()))  # numbered as written; no task groups and sorts


def match_points(keys: DataFrame) -> DataFrame:
    """Distinct (bedrooms, pcm, place, postcode) with a representative, a count and the fine cube of the place."""
    located = keys.filter("kind IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL")
    points = located.groupBy("bedrooms", "pcm", "latitude", "longitude", "kind", F.when(F.col("kind") == "P", F.col("pc")).alias("pc")).agg(
        F.min("uid").alias("rep"), F.count("*").alias("n"))
    return points.withColumn("fine", cell(F.col("latitude"), F.col("longitude"), FINE_EDGE_M))


def boxes(points: DataFrame, *cubes: str) -> DataFrame:
    """One row for each (bedrooms, cubes): the corners of its places, its lowest and highest price and its points."""
    axes = space(F.col("latitude"), F.col("longitude"))
    ends = [f(column).alias(f"{n}{end}") for n, column in axes.items() for f, end in ((F.min, "0"), (F.max, "1"))]
    cubes = cubes or ("fine",)
    rows = points.groupBy("bedrooms", *cubes).agg(*ends, F.min("pcm").alias("low"), F.max("pcm").alias("high"), F.count("*").alias("points"))
    return rows.withColumnRenamed(cubes[-1], "cube")


def _gap(a: str, b: str) -> tuple[Column, Column]:
    """Squared distances between the nearest and between the farthest corners of two boxes."""
    near, far = F.lit(0.0), F.lit(0.0)
    for n in "xyz":
        apart = F.greatest(F.col(f"{a}.{n}0") - F.col(f"{b}.{n}1"), F.col(f"{b}.{n}0") - F.col(f"{a}.{n}1"), F.lit(0.0))
        across = F.greatest(F.col(f"{a}.{n}1") - F.col(f"{b}.{n}0"), F.col(f"{b}.{n}1") - F.col(f"{a}.{n}0"))
        near, far = near + apart * apart, far + across * across
    return near, far


def _judged(pairs: DataFrame) -> DataFrame:
    """Of pairs of boxes ``a`` and ``b``: those with partners in reach and in band, ``near`` where all points are in reach."""
    near, far = _gap("a", "b")
    slack = 0.001  # metres, above what rounding and the bend of the earth add
    in_reach = near <= (DUPLICATE_RADIUS_M + slack) ** 2
    band = F.lit(1 + PRICE_BAND * 1.001)
    priced = (F.col("a.low") <= F.col("b.high") * band) & (F.col("b.low") <= F.col("a.high") * band)
    return pairs.filter(in_reach & priced).select(
        F.col("a.bedrooms").alias("bedrooms"), F.col("a.cube").alias("u"), F.col("b.cube").alias("v"),
        (far <= (DUPLICATE_RADIUS_M - slack) ** 2).alias("near"), (F.col("a.points") * F.col("b.points")).alias("work"))


def _neighbours(probes: DataFrame, targets: DataFrame, ordered: bool = False) -> DataFrame:
    """Judged pairs of boxes of fine cubes; fine cubes in reach are at most two apart, so those of twice the edge are at most
    one apart. ``ordered``: of one set of boxes, each pair once and every box with itself."""
    a = probes.withColumn("meet", F.explode(neighbour_cells(parent_cell(F.col("cube"))))).alias("a")
    b = targets.withColumn("meet", parent_cell(F.col("cube"))).alias("b")
    same = (F.col("a.bedrooms") == F.col("b.bedrooms")) & (F.col("a.meet") == F.col("b.meet"))
    return _judged(a.join(b, same & (F.col("a.cube") <= F.col("b.cube")) if ordered else same))


def near_candidates(probes: DataFrame, targets: DataFrame) -> DataFrame:
    """probes ⋈ targets that agree on bedrooms, lie within the radius and are in the price band: structs p and t.

    Cubes meet first, as boxes around their points; points meet only where two boxes can hold partners.
    """
    fine = lambda df: df if "fine" in df.columns else df.withColumn("fine", cell(F.col("latitude"), F.col("longitude"), FINE_EDGE_M))
    probes, targets = fine(probes), fine(targets)
    pairs = _neighbours(boxes(probes), boxes(targets)).drop("work")
    p, t = probes.alias("p"), targets.alias("t")
    asked = pairs.join(p, (F.col("p.bedrooms") == pairs["bedrooms"]) & (F.col("p.fine") == pairs["u"])).select(F.struct("p.*").alias("p"), "v", "near")
    met = asked.join(t, (F.col("p.bedrooms") == F.col("t.bedrooms")) & (F.col("v") == F.col("t.fine")) & in_band(F.col("p.pcm"), F.col("t.pcm")))
    within = haversine(F.col("p.latitude"), F.col("p.longitude"), F.col("t.latitude"), F.col("t.longitude"), EARTH_RADIUS_M) <= F.lit(DUPLICATE_RADIUS_M)
    return met.filter(F.col("near") | within).select("p", F.struct("t.*").alias("t"))


def settle(points: DataFrame, take_near, keep=None, list_work: int = LIST_WORK) -> DataFrame:
    """(bedrooms, p, t): pairs of points of straddling cubes, to be compared one by one; the rest goes to ``take_near``.

    Pairs of fine cubes are judged by their boxes. Where the farthest corners are in reach all points are, and
    ``take_near(points, pairs, cube)`` gets the cubes, itself once with itself; it may return ``points`` with further columns.
    Where the nearest are not, none is. Of the rest, those with at most ``list_work`` pairs of points list them; the others
    are cut into cubes of half the edge and judged again. ``keep(points, pairs, cube)`` may drop pairs that no longer matter.
    """
    box = boxes(points)
    judged = cut_lineage(_neighbours(box, box, ordered=True))
    cube, level, listed = "fine", 0, []
    while True:
        points = take_near(points, judged.filter("near"), cube) or points
        open_pairs = judged.filter("NOT near")
        open_pairs = cut_lineage(keep(points, open_pairs, cube)) if keep else open_pairs
        few, side = open_pairs.filter(F.col("work") <= list_work), lambda name: points.alias(name)  # noqa: E731, B023
        with_p = few.join(side("p"), (F.col("p.bedrooms") == few["bedrooms"]) & (F.col(f"p.{cube}") == F.col("u"))).select(F.struct("p.*").alias("p"), "v")
        listed.append(with_p.join(side("t"), (F.col("p.bedrooms") == F.col("t.bedrooms")) & (F.col("v") == F.col(f"t.{cube}"))).select(
            *[F.struct(*[f"{k}.{c}" for c in POINT if c in points.columns]).alias(k) for k in "pt"]))
        many = open_pairs.filter(F.col("work") > list_work)
        if many.isEmpty():
            break
        level, parent = level + 1, cube
        cube = f"fine{level}"
        points = points.withColumn(cube, cell(F.col("latitude"), F.col("longitude"), FINE_EDGE_M / 2 ** level))
        box = boxes(points, parent, cube)
        a, b = box.alias("a"), box.alias("b")
        inside = many.select(F.col("bedrooms").alias("of"), "u", "v").join(a, (F.col("of") == F.col("a.bedrooms")) & (F.col("u") == F.col(f"a.{parent}")))
        judged = cut_lineage(_judged(inside.drop("u").withColumnRenamed("v", "other").join(b, (F.col("of") == F.col("b.bedrooms")) & (F.col("other") == F.col(f"b.{parent}")))))
    out = listed[0]
    for more in listed[1:]:
        out = out.unionByName(more)
    return out


def _on_lines(points: DataFrame, near: DataFrame, cube: str) -> DataFrame:
    """(node, other) for runs of two cubes all of whose points are in reach, from one sorted price line for both.

    What lies between two prices of a band is in band with both, so each price needs the nearest G price below and, being P,
    the nearest above; G prices chain among themselves. Both are looked for backwards, the latter on the reversed line: a frame
    that reaches forward to the end would be walked again for every price.
    """
    prices = points.select("bedrooms", F.col(cube).alias("cube"), "node", "kind", "pcm").distinct()
    sides = near.select(F.col("bedrooms").alias("of"), "u", "v", F.explode(F.array_distinct(F.array("u", "v"))).alias("side"))
    line = sides.join(prices, (F.col("of") == F.col("bedrooms")) & (F.col("side") == F.col("cube")))
    pair, behind = Window.partitionBy(F.xxhash64("of", "u", "v"), "of", "u", "v"), (Window.unboundedPreceding, -1)
    up, down = pair.orderBy("pcm", "kind", "node"), pair.orderBy(F.desc("pcm"), F.desc("kind"), F.desc("node"))
    g = F.when(F.col("kind") == "G", F.struct("pcm", "node"))
    met = line.withColumns({
        "below": F.last(g, True).over(up.rowsBetween(*behind)),
        "above": F.when(F.col("kind") == "P", F.last(g, True).over(down.rowsBetween(*behind)))})
    found = met.select("node", "pcm", F.explode(F.array("below", "above")).alias("g")).filter(F.col("g").isNotNull() & in_band(F.col("pcm"), F.col("g.pcm")))
    return found.select("node", F.col("g.node").alias("other")).filter("node != other").distinct()


def place_components(points: DataFrame, list_work: int = LIST_WORK) -> DataFrame:
    """(node, component) of the runs that places link; ``points`` has bedrooms, pcm, place, kind, node and fine.

    Runs that whole cubes link are put together first; straddling cubes are looked into only where they could link more.
    """
    edges: list[DataFrame] = []

    def take_near(points: DataFrame, near: DataFrame, cube: str) -> DataFrame | None:
        found = _on_lines(points, near, cube)
        if edges:
            edges.append(found)
            return None
        known = cut_lineage(connected_components(found))
        edges.append(known.select("node", F.col("component").alias("other")))
        return cut_lineage(points.join(known, "node", "left").withColumn("component", F.coalesce("component", "node")))

    def keep(points: DataFrame, pairs: DataFrame, cube: str) -> DataFrame:
        held = points.groupBy("bedrooms", cube).agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.col("kind") == "G").alias("g"))
        side = lambda end: held.select("bedrooms", F.col(cube).alias(end), F.struct("low", "high", "g").alias(f"of_{end}"))
        both = pairs.join(side("u"), ["bedrooms", "u"]).join(side("v"), ["bedrooms", "v"])
        one = (F.col("of_u.low") == F.col("of_u.high")) & (F.col("of_v.low") == F.col("of_v.high")) & (F.col("of_u.low") == F.col("of_v.low"))
        return both.filter(~one & (F.col("of_u.g") | F.col("of_v.g"))).select(*pairs.columns)

    listed = settle(points, take_near, keep, list_work)
    links = listed.filter((F.col("p.component") != F.col("t.component")) & _linked()).select(F.col("p.node").alias("node"), F.col("t.node").alias("other"))
    for more in [links, *edges[1:]]:
        edges[0] = edges[0].unionByName(more)
    return connected_components(edges[0])


def _linked() -> Column:
    """Whether listed points p and t match by place."""
    within = haversine(F.col("p.latitude"), F.col("p.longitude"), F.col("t.latitude"), F.col("t.longitude"), EARTH_RADIUS_M) <= F.lit(DUPLICATE_RADIUS_M)
    return ((F.col("p.kind") == "G") | (F.col("t.kind") == "G")) & in_band(F.col("p.pcm"), F.col("t.pcm")) & within


def _place_pair_counts(points: DataFrame, list_work: int = LIST_WORK) -> DataFrame:
    """(branch, bedrooms, pcm_low, pcm_high, pairs) of listings that match by place; cubes in reach multiply their counts."""
    counted: list[DataFrame] = []
    named = lambda rows, pairs: rows.select(F.lit("place").alias("branch"), F.col("p.bedrooms").alias("bedrooms"), F.least("p.pcm", "t.pcm").alias("pcm_low"),
                                            F.greatest("p.pcm", "t.pcm").alias("pcm_high"), pairs.cast("long").alias("pairs"))

    def take_near(points: DataFrame, near: DataFrame, cube: str) -> None:
        prices = points.groupBy("bedrooms", F.col(cube).alias("cube"), "kind", "pcm").agg(F.sum("n").alias("n"))
        p, t = prices.alias("p"), prices.alias("t")
        asked = near.select(F.col("bedrooms").alias("of"), "u", "v").join(p, (F.col("of") == F.col("p.bedrooms")) & (F.col("u") == F.col("p.cube")))
        met = asked.join(t, (F.col("of") == F.col("t.bedrooms")) & (F.col("v") == F.col("t.cube")) & in_band(F.col("p.pcm"), F.col("t.pcm")) & (
            (F.col("p.kind") == "G") | (F.col("t.kind") == "G")))
        own, order = F.col("u") == F.col("v"), lambda k: F.struct(f"{k}.kind", f"{k}.pcm")
        pairs = F.when(~own | (order("p") < order("t")), F.col("p.n") * F.col("t.n")).when(order("p") == order("t"), F.floor(F.col("p.n") * (F.col("p.n") - 1) / 2)).otherwise(0)
        counted.append(named(met, pairs))

    listed = settle(points, take_near, None, list_work)
    out = named(listed.filter(_linked()), F.col("p.n") * F.col("t.n"))
    for more in counted:
        out = out.unionByName(more)
    return out


def dup_pairs(df: DataFrame) -> DataFrame:
    """Matching pairs counted by class: (branch, bedrooms, pcm_low, pcm_high, n_pairs).

    Postcode branch: distinct prices of a block are paired, which integer pounds bound. Place branch: prices of cubes in
    reach of each other, points only of cubes that straddle it. The number of listing pairs follows from the group sizes,
    so a block of any size never lists its pairs; which listings pair up is in the clusters.
    """
    keys = cut_lineage(match_keys(df))
    groups = keys.filter("kind = 'P'").groupBy("bedrooms", "pc", "pcm").agg(F.count("*").alias("n"))
    a = groups.withColumn("bucket", F.explode(_bucket_reach(F.col("pcm")))).alias("a")
    b = groups.withColumn("bucket", _price_bucket(F.col("pcm"))).alias("b")
    by_postcode = a.join(b, ["bedrooms", "pc", "bucket"]).filter(
        (F.col("a.pcm") <= F.col("b.pcm")) & in_band(F.col("a.pcm"), F.col("b.pcm"))
    ).select(
        F.lit("postcode").alias("branch"), "bedrooms", F.col("a.pcm").alias("pcm_low"), F.col("b.pcm").alias("pcm_high"),
        F.when(F.col("a.pcm") == F.col("b.pcm"), F.floor(F.col("a.n") * (F.col("a.n") - 1) / 2))
        .otherwise(F.col("a.n") * F.col("b.n")).cast("long").alias("pairs"),
    )
    points = cut_lineage(match_points(keys))
    by_place = _place_pair_counts(points)
    return by_postcode.unionByName(by_place).groupBy("branch", "bedrooms", "pcm_low", "pcm_high").agg(
        F.sum("pairs").alias("n_pairs")).filter("n_pairs > 0")


def dup_match_counts(df: DataFrame) -> DataFrame:
    """(uid, n_matches): how many other listings each listing matches; listings without a match are left out."""
    keys = cut_lineage(match_keys(df))
    groups = keys.filter("kind = 'P'").groupBy("bedrooms", "pc", "pcm").agg(F.count("*").alias("n"))
    a = groups.withColumn("bucket", F.explode(_bucket_reach(F.col("pcm")))).alias("a")
    b = groups.withColumn("bucket", _price_bucket(F.col("pcm"))).alias("b")
    group_hits = a.join(b, ["bedrooms", "pc", "bucket"]).filter(in_band(F.col("a.pcm"), F.col("b.pcm"))).groupBy(
        "bedrooms", "pc", F.col("a.pcm").alias("pcm")
    ).agg((F.sum("b.n") - 1).alias("hits"), F.first("a.n").alias("n"))
    p_rows = join_by_weight(keys.filter("kind = 'P'"), group_hits, ["bedrooms", "pc", "pcm"], "n").select("uid", "hits")

    points = cut_lineage(match_points(keys))
    spot = ["bedrooms", "pcm", "latitude", "longitude", "kind", "pc"]
    usable = (F.col("p.kind") == "G") | (F.col("t.kind") == "G")
    itself = (F.col("p.kind") == "G") & (F.col("t.kind") == "G") & (F.col("p.pcm") == F.col("t.pcm")) \
        & (F.col("p.latitude") == F.col("t.latitude")) & (F.col("p.longitude") == F.col("t.longitude"))
    point_hits = near_candidates(points.filter("kind = 'G'"), points).unionByName(
        near_candidates(points.filter("kind = 'P'"), points.filter("kind = 'G'"))
    ).filter(usable).groupBy(*[F.col(f"p.{c}").alias(c) for c in spot], F.col("p.n").alias("n")).agg(
        F.sum(F.col("t.n") - F.when(itself, 1).otherwise(0)).alias("hits"))
    located = keys.filter("kind IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL").withColumn(
        "pc", F.when(F.col("kind") == "P", F.col("pc")).otherwise(""))
    g_rows = join_by_weight(located, point_hits.withColumn("pc", F.coalesce("pc", F.lit(""))), spot, "n", materialise=True).select("uid", "hits")
    return p_rows.unionByName(g_rows).groupBy("uid").agg(F.sum("hits").alias("n_matches")).filter("n_matches > 0")


def _closed(df: DataFrame, columns: tuple[str, ...], named: bool) -> DataFrame:
    """(uid, cluster_id, columns): clusters by their smallest uid if ``named``, else by a number.

    The closure runs over price runs (one node per run), not over listings, so a block with a third of all rows is one node.
    Nodes are numbers. ``columns`` of ``df`` travel with the keys, so that listings are not shuffled by uid to meet their clusters.
    """
    keep = tuple(c for c in dict.fromkeys(columns) if c not in KEY_COLUMNS)
    found = match_blocks(match_keys(df, keep=keep))  # narrow
    spots = match_spots(found, named)
    runs = cut_lineage(match_runs(spots))
    placed = spots.filter("latitude IS NOT NULL AND longitude IS NOT NULL").select(*BLOCK, "pcm", "latitude", "longitude")
    fine = cell(F.col("latitude"), F.col("longitude"), FINE_EDGE_M)
    points = cut_lineage(placed.withColumn("fine", fine).join(runs.select(*BLOCK, "pcm", "node"), [*BLOCK, "pcm"]))
    components = place_components(points)
    clusters = runs.join(components, "node", "left").withColumn("cluster_id", F.coalesce("component", "node")).drop("node", "component")
    if named:
        clusters = cut_lineage(clusters.withColumnRenamed("cluster_id", "component"))
        names = clusters.groupBy("component").agg(F.min("rep").alias("cluster_id"), F.count("*").alias("size"))
        clusters = join_by_weight(clusters, names, ["component"], "size", materialise=True)
    out = [c for c in dict.fromkeys(("uid", "cluster_id", *columns))]
    held = list(dict.fromkeys(("uid", *BLOCK, "pcm", *columns)))
    lookup = clusters.select(*BLOCK, "pcm", "n", "cluster_id")
    rows = join_by_weight(found.filter("kind IS NOT NULL").select(*held), lookup, [*BLOCK, "pcm"], "n", materialise=True)
    alone = found.filter("kind IS NULL").withColumn("cluster_id", F.col("uid") if named else -1 - F.monotonically_increasing_id())
    return rows.select(*out).unionByName(alone.select(*out))


def with_cluster_id(df: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """(uid, cluster_id, columns) for every listing: the transitive closure of matching, named by the smallest uid."""
    return _closed(df, columns, named=True)


def cluster_labels(df: DataFrame) -> DataFrame:
    """(uid, cluster_id) for every listing, clusters numbered in no order: for those who only ask whether clusters agree.

    Written, as the numbers of listings that match by nothing would change when they are computed again.
    """
    return cut_lineage(_closed(df, (), named=False))


def dup_clusters(df: DataFrame) -> DataFrame:
    """(uid, cluster_id) for every listing."""
    return with_cluster_id(df)


def primary_rank(preferred: str = PREFERRED_PORTAL) -> Column:
    """Smallest is best: most enrichment fields filled, newest discovery, preferred portal, uid."""
    filled = sum((F.coalesce(F.col(f).cast("string"), F.lit("")) != "").cast("int") for f in ENRICHMENT_FIELDS)
    return F.struct((-filled).alias("f"), (-F.coalesce(micros("first_seen"), F.lit(-(2 ** 62)))).alias("t"),
                    (F.col("portal") != preferred).cast("int").alias("p"), F.col("uid").alias("u"))


def choose_primary(clustered: DataFrame, preferred: str = PREFERRED_PORTAL) -> DataFrame:
    return clustered.groupBy("cluster_id").agg(F.min(primary_rank(preferred)).alias("best")).select(
        "cluster_id", F.col("best.u").alias("primary_uid"))


def _extents() -> list[Column]:
    """Aggregates: how far the located members of a cluster reach on each axis."""
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    axes = {n: F.when(located, v) for n, v in space(F.col("latitude"), F.col("longitude")).items()}
    return [(F.max(v) - F.min(v)).alias(f"_d{n}") for n, v in axes.items()]


def _far(clustered: DataFrame, extents: DataFrame, radius: float) -> DataFrame:
    """cluster_id of scattered clusters, given the extents of each.

    Extents settle nearly all clusters: wider than the radius on one axis means scattered, a box diagonal within it means not.
    Of the rest every task keeps the convex hull of its places, hulls are merged, and the farthest pair is read off the merged
    hull: no places are paired.
    """
    slack = 0.001  # metres: leave borderline boxes to the exact test
    wide = F.greatest("_dx", "_dy", "_dz") > radius + slack
    tight = F.sqrt(F.col("_dx") ** 2 + F.col("_dy") ** 2 + F.col("_dz") ** 2) < radius - slack
    places = clustered.filter("latitude IS NOT NULL AND longitude IS NOT NULL").select("cluster_id", "latitude", "longitude")
    open_places = places.join(extents.filter(~wide & ~tight).select("cluster_id"), "cluster_id", "left_semi").distinct()
    kind = clustered.schema["cluster_id"].dataType.simpleString()
    rims = open_places.sortWithinPartitions("cluster_id").mapInPandas(hulls_of_runs, f"cluster_id {kind}, latitude double, longitude double")

    def is_far(rim: pd.DataFrame) -> pd.DataFrame:
        return rim[["cluster_id"]].head(1 if farthest_pair(rim["latitude"].to_numpy(), rim["longitude"].to_numpy()) > radius else 0)

    far = rims.groupBy("cluster_id").applyInPandas(is_far, f"cluster_id {kind}")
    return extents.filter(wide).select("cluster_id").unionByName(far)


def scattered_clusters(clustered: DataFrame, radius: float = DUPLICATE_RADIUS_M) -> DataFrame:
    """cluster_id of clusters with two located members further apart than ``radius``."""
    return _far(clustered, cut_lineage(clustered.groupBy("cluster_id").agg(*_extents())), radius)


def _with_centroid(clustered: DataFrame, *measures: Column) -> DataFrame:
    """(cluster_id, measures, centroid_lat, centroid_lng) from one aggregation, which is written since its extents are read again."""
    facts = cut_lineage(clustered.groupBy("cluster_id").agg(
        *measures, F.avg("latitude").alias("_lat"), F.avg("longitude").alias("_lng"), *_extents()))
    far = _far(clustered, facts.select("cluster_id", "_dx", "_dy", "_dz"), DUPLICATE_RADIUS_M).withColumn("_far", F.lit(True))
    return facts.join(far, "cluster_id", "left").withColumns({
        "centroid_lat": F.when(F.col("_far").isNull(), F.col("_lat")), "centroid_lng": F.when(F.col("_far").isNull(), F.col("_lng"))
    }).drop("_lat", "_lng", "_dx", "_dy", "_dz", "_far")


def cluster_centroid(clustered: DataFrame) -> DataFrame:
    """Mean place of each cluster whose located members all agree within the radius, else NULL."""
    return _with_centroid(clustered)


def cluster_table(clustered: DataFrame, preferred: str = PREFERRED_PORTAL) -> DataFrame:
    """One row per cluster; every measure is an algebraic aggregate, so hot clusters combine map-side."""
    pcm = price_pcm(F.col("price_numeric"))
    return _with_centroid(
        clustered,
        F.coalesce(F.max("bedrooms"), F.lit(0)).alias("bedrooms"),
        F.coalesce(F.min(pcm), F.lit(0)).alias("price_pcm_min"), F.coalesce(F.max(pcm), F.lit(0)).alias("price_pcm_max"),
        F.count("*").alias("member_count"), F.min(primary_rank(preferred))["u"].alias("primary_uid"),
        F.min("first_seen").alias("first_seen"), F.max("last_scraped").alias("last_seen"),
    )


def with_cluster_number(clusters: DataFrame) -> DataFrame:
    """Dense numbers 1, 2, ... in order of cluster_id."""
    return with_position(clusters, [F.asc("cluster_id")], "cluster_number")


def matching_cluster(arrivals: DataFrame, clustered: DataFrame) -> DataFrame:
    """(uid, cluster_id): the smallest existing cluster each arrival matches; arrivals without one are left out.

    Existing members collapse to one row per (block, price) or place, keeping only their smallest cluster.
    """
    new = cut_lineage(match_keys(arrivals))
    members = clustered.select("uid", "portal", "postcode", "bedrooms", "price_numeric", "latitude", "longitude", "cluster_id")
    known = cut_lineage(match_keys(members, keep=("cluster_id",)))
    groups = known.filter("kind = 'P'").groupBy("bedrooms", "pc", "pcm").agg(F.min("cluster_id").alias("cluster_id"))
    asks = new.filter("kind = 'P'").groupBy("bedrooms", "pc", "pcm").agg(F.count("*").alias("n"))
    a = asks.withColumn("bucket", F.explode(_bucket_reach(F.col("pcm")))).alias("a")
    b = groups.withColumn("bucket", _price_bucket(F.col("pcm"))).alias("b")
    price_hits = a.join(b, ["bedrooms", "pc", "bucket"]).filter(in_band(F.col("a.pcm"), F.col("b.pcm"))).groupBy(
        "bedrooms", "pc", F.col("a.pcm").alias("pcm"), F.col("a.n").alias("n")).agg(F.min("b.cluster_id").alias("cluster_id"))
    p_rows = join_by_weight(new.filter("kind = 'P'"), price_hits, ["bedrooms", "pc", "pcm"], "n").select("uid", "cluster_id")

    spot = ["bedrooms", "pcm", "latitude", "longitude", "kind"]
    located = "kind IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL"
    probes = new.filter(located).groupBy(*spot).agg(F.count("*").alias("n"))
    targets = known.filter(located).groupBy(*spot).agg(F.min("cluster_id").alias("cluster_id"))
    near = near_candidates(probes.filter("kind = 'G'"), targets).unionByName(
        near_candidates(probes.filter("kind = 'P'"), targets.filter("kind = 'G'")))
    place_hits = near.groupBy(*[F.col(f"p.{c}").alias(c) for c in spot], F.col("p.n").alias("n")).agg(
        F.min("t.cluster_id").alias("cluster_id"))
    g_rows = join_by_weight(new.filter(located), place_hits, spot, "n", materialise=True).select("uid", "cluster_id")
    return p_rows.unionByName(g_rows).groupBy("uid").agg(F.min("cluster_id").alias("cluster_id"))


def cluster_assign_incremental(arrivals: DataFrame, clustered: DataFrame) -> DataFrame:
    """(uid, cluster_id, is_new) for a batch: join the smallest matching cluster, else cluster the rest among themselves.

    Existing clusters are not merged here; a later full ``dup_clusters`` heals bridges. ``refreshed_clusters`` gives the rows
    that an assignment changes in the cluster table.
    """
    joined = cut_lineage(matching_cluster(arrivals, clustered))
    rest = arrivals.join(joined, "uid", "left_anti")
    return joined.withColumn("is_new", F.lit(False)).unionByName(dup_clusters(rest).withColumn("is_new", F.lit(True)))


def refreshed_clusters(assigned: DataFrame, clustered: DataFrame, preferred: str = PREFERRED_PORTAL) -> DataFrame:
    """Rows of the cluster table that a batch changes: of every cluster with an arrival, primary, prices, count, centroid and
    times over its old and new members. ``assigned`` holds the arrivals with their cluster_id; columns it lacks are NULL.

    Only members of touched clusters are kept of the store, by a semi join on the batch's clusters.
    """
    touched = assigned.select("cluster_id").distinct()
    members = clustered.join(touched, "cluster_id", "left_semi").unionByName(assigned, allowMissingColumns=True)
    return cluster_table(members, preferred)


def cluster_member_counts(df: DataFrame, clusters: DataFrame) -> DataFrame:
    """Stored member count, else the number of active members seen in the listings, else 1."""
    counted = df.filter(F.col("is_active") & F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(F.count("*").alias("seen"))
    sizes = df.filter(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(F.count("*").alias("n"))
    known = sizes.join(clusters.select("cluster_id", "member_count"), "cluster_id", "left").join(counted, "cluster_id", "left").select(
        "cluster_id", "n", F.coalesce("member_count", "seen", F.lit(1)).cast("long").alias("cluster_member_count"))
    with_id = join_by_weight(df.filter(F.col("cluster_id").isNotNull()), known, ["cluster_id"], "n").drop("n")
    without = df.filter(F.col("cluster_id").isNull()).withColumn("cluster_member_count", F.lit(1).cast("long"))
    return with_id.unionByName(without.select(*with_id.columns))


def cluster_other_members(page: DataFrame, df: DataFrame) -> DataFrame:
    """(uid, other_uid, other_portal) for the listings of one result page: the active rest of each one's cluster."""
    asked = page.filter("cluster_id IS NOT NULL").select("cluster_id", F.col("uid").alias("asked_uid"))
    members = df.filter("is_active").select("cluster_id", F.col("uid").alias("other_uid"), F.col("portal").alias("other_portal"))
    return asked.join(members, "cluster_id").filter("asked_uid != other_uid").select(
        F.col("asked_uid").alias("uid"), "other_uid", "other_portal").orderBy("uid", "other_portal", "other_uid")


def pair_precision_recall(pairs: DataFrame, assignment: DataFrame) -> DataFrame:
    """tp, fp, fn, tn, precision and recall of cluster assignments against labelled pairs (0.0 where undefined)."""
    def side(end: str) -> DataFrame:
        return assignment.select(F.xxhash64("uid").alias("hashed"), F.col("uid").alias(f"uid_{end}"), F.col("cluster_id").alias(f"c{end}"))

    judged = pairs.select("uid_a", "uid_b", (F.col("label") == "duplicate").alias("dup"))
    for end in "ab":  # a hash in front of the uids, which start alike, decides nearly all comparisons of the join's sort
        judged = judged.withColumn("hashed", F.xxhash64(f"uid_{end}")).join(side(end), ["hashed", f"uid_{end}"]).drop("hashed")
    same, dup = F.col("ca") == F.col("cb"), F.col("dup")
    counts = judged.agg(
        F.count_if(same & dup).alias("tp"), F.count_if(same & ~dup).alias("fp"),
        F.count_if(~same & dup).alias("fn"), F.count_if(~same & ~dup).alias("tn"))

    def share(part: str, other: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part), F.col(part) + F.col(other)), F.lit(0.0))

    return counts.select("*", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"))
