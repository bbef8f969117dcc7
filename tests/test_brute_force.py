"""Operators against plain-Python twins on small fixtures, hot keys included."""

import math
import random
import statistics
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from proplake import config as C
from proplake.functions.fuzzy import common_subsequence, token_set_score
from proplake.functions.graph import connected_components
from proplake.functions.hull import farthest_pair, hull
from proplake.functions import ranks
from proplake.functions.ranks import spearman
from proplake.functions.text import normal_postcode
from proplake.operators import enrich, evaluate, gate, lifecycle, merge, resolve, views

LISTING = ("uid string, portal string, postcode string, bedrooms int, price_numeric long, latitude double, longitude double")


def metres(a, b):
    la, lb = math.radians(a[5]), math.radians(b[5])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[6] - a[6]) / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(min(1.0, math.sqrt(h)))


def pair_matches(a, b):
    if a[3] is None or a[3] != b[3] or a[4] is None or b[4] is None:
        return False
    pa, pb = a[4] // 100, b[4] // 100
    if pa <= 0 or pb <= 0 or abs(pa - pb) / min(pa, pb) > 0.02:
        return False
    if "portal_c" in (a[1], b[1]) or not a[2] or not b[2]:
        return None not in (a[5], a[6], b[5], b[6]) and metres(a, b) <= 50
    return a[2].replace(" ", "") == b[2].replace(" ", "")


@pytest.fixture(scope="module")
def listings():
    """A third of the rows share one block and one place; the rest spread around it."""
    rng = random.Random(7)
    rows = []
    for i in range(240):
        hot = i % 3 == 0
        lat = 51.5 if hot and i % 2 else 51.5 + rng.randrange(40) * 0.0002
        lng = -0.1 if hot and i % 2 else -0.1 + rng.randrange(40) * 0.0002
        rows.append((
            f"u{i:03d}", rng.choice(["portal_a", "portal_b", "portal_c"]), "N1 1AA" if hot else rng.choice(["N1 1AA", "n11ab", "bad", None]),
            2 if hot else rng.choice([1, 2, None]), rng.choice([None, 0, *range(180000, 260000, 1700)]),
            None if rng.random() < 0.1 else lat, None if rng.random() < 0.1 else lng))
    return [(*r[:2], r[2] if r[2] != "bad" else "bad", *r[3:]) for r in rows]


def clean(rows):
    return [(*r[:2], None if r[2] == "bad" else (r[2].upper() if r[2] else None), *r[3:]) for r in rows]


def brute_pairs(rows):
    return [(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1:] if pair_matches(a, b)]


def brute_clusters(rows):
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute_pairs(rows):
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {u: find(u) for u in parent}


def test_clusters_and_pairs_match_brute_force(spark, listings):
    rows = clean(listings)
    pairs = brute_pairs(rows)
    matches = Counter(u for pair in pairs for u in pair)
    df = spark.createDataFrame(listings, LISTING)
    got = {r["uid"]: r["cluster_id"] for r in resolve.dup_clusters(df).collect()}
    assert got == brute_clusters(rows)
    assert resolve.dup_pairs(df).agg(F.sum("n_pairs")).first()[0] == len(pairs)
    assert {r["uid"]: r["n_matches"] for r in resolve.dup_match_counts(df).collect()} == matches
    shuffled = spark.createDataFrame(list(reversed(listings)), LISTING)
    assert {r["uid"]: r["cluster_id"] for r in resolve.dup_clusters(shuffled).collect()} == got


def test_scattered_clusters(spark):
    rng = random.Random(3)
    rows = [(f"u{i}", f"c{i % 40}", 51.5 + rng.random() * 0.0004, -0.1 + rng.random() * 0.0006) for i in range(200)]
    far = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            if a[1] == b[1] and metres((0,) * 5 + (a[2], a[3]), (0,) * 5 + (b[2], b[3])) > 50:
                far.add(a[1])
    df = spark.createDataFrame(rows, "uid string, cluster_id string, latitude double, longitude double")
    assert {r[0] for r in resolve.scattered_clusters(df).collect()} == far and 0 < len(far) < 40


def test_farthest_pairs_of_merged_hulls():
    draw = np.random.default_rng(8)
    for n, spread in ((1, 1), (2, 1), (3, 1), (40, 1), (40, 0), (400, 1)):
        lat, lng = 51.5 + draw.normal(0, 3e-4, n), -0.1 + spread * draw.normal(0, 4e-4, n)
        if n == 400:
            lat, lng = np.round(lat, 4), np.round(lng, 4)  # many on one line
        want = max((metres((0,) * 5 + (a, b), (0,) * 5 + (c, d)) for a, b in zip(lat, lng) for c, d in zip(lat, lng)), default=0)
        assert farthest_pair(lat, lng) == pytest.approx(want, abs=1e-6)
        parts = [np.arange(k, n, 3) for k in range(min(3, n))]
        merged = np.concatenate([p[hull(lat[p], lng[p])] for p in parts])
        assert farthest_pair(lat[merged], lng[merged]) == pytest.approx(want, abs=1e-6)


def crowded(n, wide, seed):
    """Places of postcodes and without, prices that chain and that do not."""
    draw = random.Random(seed)
    return [(f"u{i:05d}", "portal_a", draw.choice(["N1 1AA", "N1 1AB", None, None]), draw.choice([1, 2]), draw.choice([100_000, 101_500, 103_000, 150_000, 152_500]),
             51.5 + draw.random() * wide, -0.1 + draw.random() * wide * 1.6) for i in range(n)]


@pytest.mark.parametrize("list_work", [0, 30, 4_096])
def test_straddling_cubes_of_every_size(spark, monkeypatch, list_work):
    rows = crowded(260, 0.0011, 5)
    df = spark.createDataFrame(rows, LISTING)
    whole = resolve.settle
    monkeypatch.setattr(resolve, "settle", lambda points, take_near, keep=None, _=None: whole(points, take_near, keep, max(1, list_work)))
    pairs, clusters = brute_pairs(rows), brute_clusters(rows)
    found = {r["uid"]: r["cluster_id"] for r in resolve.dup_clusters(df).collect()}
    assert found == clusters and 1 < len(set(clusters.values())) < 200
    assert sum(r["n_pairs"] for r in resolve.dup_pairs(df).collect()) == len(pairs)


def test_a_crowded_place_lists_few_pairs(spark, monkeypatch):
    rows = [(f"u{i:05d}", "portal_c", None, 1, 100_000 + 100 * (i % 7), 51.5 + (i % 100) * 4e-6, -0.1 + (i // 100) * 6e-6) for i in range(10_000)]
    whole, listed = resolve.settle, []

    def counted(*args):
        out = whole(*args)
        listed.append(out.count())
        return out

    monkeypatch.setattr(resolve, "settle", counted)
    assert {r["cluster_id"] for r in resolve.dup_clusters(spark.createDataFrame(rows, LISTING)).collect()} == {"u00000"}
    assert listed[0] < 20_000


def test_long_chain_components(spark):
    edges = spark.createDataFrame([(f"n{i:04d}", f"n{i + 1:04d}") for i in range(300)], "node string, other string")
    assert {r["component"] for r in connected_components(edges).collect()} == {"n0000"}
    assert {r["component"] for r in connected_components(edges, edges_a_task=0).collect()} == {"n0000"}


def test_small_graphs_and_large_ones_agree(spark):
    draw = random.Random(4)
    names = [f"{draw.choice('aéz')}{i}" for i in range(300)]
    edges = spark.createDataFrame([(draw.choice(names), draw.choice(names)) for _ in range(220)], "node string, other string")
    found = [sorted(map(tuple, connected_components(edges, edges_a_task=n).collect())) for n in (0, 40, 10**6)]
    assert found[0] == found[1] == found[2] and len({c for _, c in found[0]}) > 3
    assert connected_components(edges.limit(0)).count() == 0


def test_fixed_replay_with_hot_listing(spark):
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(900):
        uid = "hot" if i % 3 == 0 else f"u{i % 17}"
        rows.append((uid, i, start + timedelta(minutes=rng.randrange(60 * 24 * 20))))
    df = spark.createDataFrame(rows, "uid string, event_id long, ts timestamp")
    clock, expected = {}, set()
    for uid, event_id, ts in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if uid not in clock or ts > clock[uid] + timedelta(hours=5):
            clock[uid] = ts
            expected.add((uid, event_id))
    for size in (1, 3, 8):
        got = gate.freshness_replay_fixed(df, 5, horizons_per_bucket=size)
        assert {(r["uid"], r["event_id"]) for r in got.collect()} == expected


def test_transition_fold_ignores_bucket_size(spark):
    rng = random.Random(9)
    start = datetime(2024, 1, 1)
    rows = [("hot" if i % 3 == 0 else f"u{i % 11}", i, start + timedelta(minutes=rng.randrange(9000)), rng.choice(C.STATES + ["odd"]), "r")
            for i in range(600)]
    df = spark.createDataFrame(rows, "uid string, id long, ts timestamp, to_status string, reason string")
    state, expected = {}, set()
    for uid, i, _, target, _ in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        now = state.get(uid, "new")
        ok = target in C.LEGAL_TRANSITIONS[now]
        expected.add((i, now, ok))
        state[uid] = target if ok else now
    for seconds in (600.0, 86_400.0):
        assert {(r["id"], r["from_status"], r["accepted"]) for r in lifecycle.transition_fold(df, seconds).collect()} == expected


def test_token_set_score_by_hand():
    assert common_subsequence("abcbdab", "bdcaba") == 4
    # shared "1 Mill"; "Lane" against "Hackney Lane," needs 9 edits over 11 + 20 characters
    assert token_set_score("1 Mill Lane", "1 Mill Lane, Hackney") == pytest.approx(100 - 100 * 9 / 31)
    assert token_set_score("12 High Road London", "12 High Road") == 100.0
    assert token_set_score("", "x") == 0.0
    assert token_set_score("ab", "cd") == 0.0
    assert token_set_score("a b", "a c") == pytest.approx(100 - 100 * 2 / 6)


def test_certificate_match_equals_brute_force(spark):
    from proplake.sources.adapters import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    certs = [r.asDict() for r in t.certificates.collect()]
    gate_df = {(r["address"], r["cert_id"]): r["ok"] for r in t.listings.select("address").distinct().crossJoin(
        t.certificates.select("cert_id", "address1", "address2")).select(
            "address", "cert_id", enrich.unit_gate(F.col("address"), F.col("address1"), F.col("address2")).alias("ok")).collect()}
    by_postcode = {}
    for c in certs:
        by_postcode.setdefault(c["postcode"], []).append(c)
    expected = {}
    for r in t.listings.select("uid", "postcode", "address").collect():
        best = None
        for c in by_postcode.get(r["postcode"], []):
            line = ", ".join(p.strip() for p in (c["address1"], c["address2"], c["address3"]) if p and p.strip())
            score = token_set_score(r["address"], line)
            if score >= 55 and gate_df[(r["address"], c["cert_id"])]:
                best = max(best or (-1,), (score, c["lodgement_date"] or "", c["cert_id"]))
        expected[r["uid"]] = best[2] if best else None
    got = enrich.cert_fuzzy_match(t.listings, t.certificates).select("uid", "match.cert.cert_id")
    assert {r["uid"]: r["cert_id"] for r in got.collect()} == expected
    assert any(expected.values())


def test_unit_gate_fixture(spark):
    rows = [("3-5 Crouch End Hill", "33-35 Crouch End Hill", "", False), ("3-5 Crouch End Hill", "3-5 Crouch End Hill", "", True),
            ("117 Junction Road", "115 Junction Road", None, False), ("117 Junction Road", "Flat 2", "117 Junction Road", True),
            ("Solar House, 915 High Road", "1 Other", "", True), ("22 Mill Lane", "22a Mill Lane", "", True)]
    df = spark.createDataFrame(rows, "address string, a1 string, a2 string, want boolean")
    assert df.filter(enrich.unit_gate(F.col("address"), F.col("a1"), F.col("a2")) != F.col("want")).count() == 0


def test_exclusive_p95_matches_standard_library(spark):
    rng = random.Random(2)
    rows = [("big", rng.randrange(5000)) for _ in range(333)] + [("small", v) for v in range(7)]
    got = {r["g"]: r for r in evaluate.exclusive_p95(spark.createDataFrame(rows, "g string, v long"), "v", "g").collect()}
    assert got["big"]["p95"] == pytest.approx(statistics.quantiles([v for g, v in rows if g == "big"], n=20)[18], abs=1e-3)
    assert got["small"]["p95"] == 6


def test_slices_follow_the_values_of_a_large_group(spark):
    draw = random.Random(2)
    rows = [("hot" if draw.random() < 0.9 else f"g{i % 5}", round(draw.lognormvariate(0, 2), 3)) for i in range(6_000)]
    df = spark.createDataFrame(rows, "g string, x double")
    counts = df.groupBy("g", "x").agg(F.count("*").alias("n"))
    cuts = ranks.slice_cuts(counts, "x", 100)
    sizes = Counter(sum(c < x for c in cuts) for g, x in set(rows) if g == "hot")
    assert len(sizes) > 30 and max(sizes.values()) < 2 * sum(sizes.values()) / len(sizes)
    positions = lambda slice_rows: sorted(map(tuple, ranks.value_positions(df, "x", ("g",), slice_rows).collect()))
    want, seen = [], Counter()
    for (g, x), n in sorted(Counter(rows).items()):
        want.append((g, x, n, seen[g]))
        seen[g] += n
    assert positions(100) == positions(10**6) == want


def test_spearman_ties(spark):
    rows = [(1, 10), (2, 20), (2, 20), (3, 15), (4, 40), (4, None)]
    got = spearman(spark.createDataFrame(rows, "x int, y int"), "x", "y").first()
    rx, ry = [1, 2.5, 2.5, 4, 5], [1, 3.5, 3.5, 2, 5]
    mx, my = statistics.mean(rx), statistics.mean(ry)
    top = sum((a - mx) * (b - my) for a, b in zip(rx, ry))
    rho = top / math.sqrt(sum((a - mx) ** 2 for a in rx) * sum((b - my) ** 2 for b in ry))
    assert got["n"] == 5 and got["rho"] == pytest.approx(rho)


def test_threshold_sweep_fixture(spark):
    rows = list(zip([0.80, 0.75, 0.70, 0.65, 0.55, 0.45], [1, 1, 1, 0, 0, 1]))
    sweep = evaluate.threshold_sweep(spark.createDataFrame(rows, "score double, label int"))
    assert sweep.count() == 9
    best = evaluate.best_threshold(sweep).first()
    assert (best["threshold"], best["precision"]) == (0.7, 1.0)


def test_hard_filter_fixture(spark):
    base = dict(uid="x", price_numeric=220000, bedrooms=2, epc_rating="C", tfl_zone=2, size_sqft=600, region="Highbury, North London", is_let_agreed=False)
    cases = [({}, None), ({"price_numeric": None}, "price"), ({"price_numeric": 280100}, "price"), ({"bedrooms": None}, "bedrooms"),
             ({"epc_rating": "E"}, "epc"), ({"epc_rating": None}, None), ({"epc_rating": "Z"}, None), ({"tfl_zone": 4}, "tfl_zone"),
             ({"tfl_zone": None}, None), ({"size_sqft": 399}, "size_sqft"), ({"is_let_agreed": True}, "let_agreed"), ({"region": None}, None)]
    schema = "uid string, price_numeric long, bedrooms int, epc_rating string, tfl_zone int, size_sqft int, region string, is_let_agreed boolean"
    rows = [tuple({**base, **change, "uid": str(i)}.values()) for i, (change, _) in enumerate(cases)]
    got = {int(r["uid"]): r["first_fail"] for r in gate.with_first_fail(spark.createDataFrame(rows, schema)).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    with pytest.raises(ValueError):
        gate.filter_rules({"epc_min_rating": "Q"})


def test_newness_fixture(spark):
    now = datetime(2026, 6, 1, 12)
    rows = [(str(i), now - timedelta(hours=h)) for i, h in enumerate((6, 18, 48, 120, 480, 1440))]
    df = spark.createDataFrame(rows, "uid string, first_seen timestamp")
    counts = {b: df.filter(views.newness(F.col("first_seen"), b, str(now))).count() for b in ("12h", "24h", "3d", "1w")}
    assert counts == {"12h": 1, "24h": 2, "3d": 3, "1w": 4}


def test_upsert_is_idempotent(spark):
    from proplake.sources.adapters import AS_OF, Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    once = merge.upsert_overwrite(t.listings, t.incoming, AS_OF)
    twice = merge.upsert_overwrite(once, t.incoming, AS_OF)
    keep = [c for c in once.columns if c != "scrape_count"]
    assert once.select(keep).exceptAll(twice.select(keep)).isEmpty()


def test_search_profiles():
    search = {"defaults": {"radius": 2.0}, "profiles": [{"name": "p", "overrides": {"max_price": 2500}, "locations": [{"name": "a", "region_id": "REGION^123"}]}]}
    row = C.search_profiles(search)[0]
    assert (row["min_price"], row["max_price"], row["radius"], row["max_bedrooms"]) == (1600, 2500, 2.0, 2)
    search["profiles"][0]["locations"][0]["region_id"] = "TODO"
    with pytest.raises(ValueError):
        C.search_profiles(search)


def test_clusters_of_an_earlier_batch_are_joined(spark):
    """One flat advertised in two batches is one cluster, and a replayed batch changes nothing."""
    from proplake.plans.scratch import scratch_folder
    from proplake.sources import sinks
    from proplake.streaming import streams

    schema = LISTING + ", first_seen timestamp, last_scraped timestamp"
    day = datetime(2026, 1, 1)
    advert = lambda uid, price, postcode: (uid, "portal_a", postcode, 2, price, None, None, day, day)
    start = spark.createDataFrame([advert("old", 200_000, "N1 1AB")], schema)
    root = scratch_folder(spark, "clusters")
    sinks.append_events(start.withColumns({"cluster_id": F.lit("old"), "is_new": F.lit(False)}), f"{root}/members", -1)
    write = streams.cluster_batches(root)
    batches = [[advert("b1", 300_000, "N2 2AB"), advert("a1", 201_000, "N1 1AB")], [advert("c1", 301_000, "N2 2AB"), advert("d1", 900_000, "N3 3AB")]]

    def state():
        members = {r["uid"]: (r["cluster_id"], r["is_new"]) for r in spark.read.parquet(f"{root}/members").collect()}
        facts = {(r["batch_id"], r["cluster_id"]): (r["member_count"], r["primary_uid"], r["price_pcm_min"], r["price_pcm_max"]) for r in spark.read.parquet(f"{root}/clusters").collect()}
        return members, facts

    for k, rows in enumerate(batches):
        write(spark.createDataFrame(rows, schema), k)
    members, facts = state()
    assert members == {"old": ("old", False), "a1": ("old", False), "b1": ("b1", True), "c1": ("b1", False), "d1": ("d1", True)}
    assert facts == {(0, "old"): (2, "a1", 2_000, 2_010), (0, "b1"): (1, "b1", 3_000, 3_000), (1, "b1"): (2, "b1", 3_000, 3_010), (1, "d1"): (1, "d1", 9_000, 9_000)}
    write(spark.createDataFrame(batches[1], schema), 1)
    assert state() == (members, facts)


def test_label_rollup_counts_names_once(spark):
    """Numbered and named bedrooms that share a name are one; a listing whose photos have no room keeps its row."""
    rng = random.Random(5)
    rows = [(f"u{i % 40}", i // 40, rng.choice(["bedroom", "bedroom", "kitchen", "hallway", None]), rng.choice([None, "", "b0", "bedroom_1", "bedroom_2", "bedroom_9"]),
             rng.choice([True, False, None]), 50) for i in range(400)] + [("none", 0, None, None, True, 3)]
    photos = spark.createDataFrame(rows, "uid string, photo_idx int, room_truth string, bedroom_slug string, has_carpet_truth boolean, bedrooms_declared int")
    found = {r["uid"]: (r["bedrooms_seen"], r["bedrooms_with_carpet"]) for r in evaluate.label_expected_rollup(photos).collect()}
    names, count = {u: {} for u, *_ in rows}, Counter()
    for uid, _, room, slug, carpet, _ in sorted(rows, key=lambda r: r[1]):
        if room == "bedroom":
            count[uid] += not slug
            name = slug or f"bedroom_{count[uid]}"
            names[uid][name] = names[uid].get(name, False) or bool(carpet)
    assert found == {u: (len(n), sum(n.values())) for u, n in names.items()}


def test_columns_travel_to_clusters(spark, listings):
    """Columns asked for come with the clusters, of listings without usable keys too, and repeated names once."""
    df = spark.createDataFrame(listings, LISTING)
    found = resolve.with_cluster_id(df, ("portal", "price_numeric", "portal", "latitude"))
    assert found.columns == ["uid", "cluster_id", "portal", "price_numeric", "latitude"]
    joined = df.select("uid", "portal", "price_numeric", "latitude").join(resolve.dup_clusters(df), "uid").select(*found.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, joined.collect()))


def test_clusters_read_all_listings_in_one_grouping(spark, listings, monkeypatch):
    """Of the steps that write a table, one alone reads the listings' keys; the rest work on their distinct places and prices."""
    real, cuts = resolve.cut_lineage, []

    def kept(df):
        out = real(df)
        cuts.append((set(df.inputFiles()), set(out.inputFiles())))
        return out

    monkeypatch.setattr(resolve, "cut_lineage", kept)
    df = spark.createDataFrame(listings, LISTING)
    names = {r["uid"]: r["cluster_id"] for r in resolve.dup_clusters(df).collect()}
    keys = cuts[0][1]
    assert sum(bool(keys & read) for read, _ in cuts[1:]) == 1
    labels = {r["uid"]: r["cluster_id"] for r in resolve.cluster_labels(df).collect()}
    assert labels.keys() == names.keys()
    assert len(set(labels.values())) == len(set(names.values())) == len({(labels[u], names[u]) for u in names})


def test_price_lines_are_not_walked_again_for_every_price(spark):
    points = spark.createDataFrame([(1, 1, "P", 2, 1000), (1, 1, "G", 1, 1001), (1, 1, "P", 3, 1002), (1, 1, "P", 5, 1500), (1, 1, "G", 4, 1510)],
                                   "bedrooms int, cube int, kind string, node long, pcm long")
    near = spark.createDataFrame([(1, 1, 1)], "bedrooms int, u int, v int")
    found = resolve._on_lines(points, near, "cube")
    assert sorted(map(tuple, found.collect())) == [(2, 1), (3, 1), (5, 4)]
    assert "unboundedfollowing$" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_postcodes_that_are_ready_and_not(spark):
    ready = {"N1 1AA": "N1 1AA", "SW1A 1AA": "SW1A 1AA"}
    others = {"n1 1aa": "N1 1AA", " N1 1AA\t": "N1 1AA", "N1 1AA\n": "N1 1AA", "N11AA": "N1 1AA", "N 11AA": "N1 1AA", "N1 11AA": "N11 1AA", "N1 1AA B": None, "": None, None: None}
    df = spark.createDataFrame([(g,) for g in [*ready, *others]], "given string")
    assert {r[0]: r[1] for r in df.select("given", normal_postcode(F.col("given"))).collect()} == {**ready, **others}
