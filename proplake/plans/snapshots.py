"""Freshness gates, snapshot merges and the logs around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from proplake.operators import gate, merge
from proplake.plans.registry import query
from proplake.sources.adapters import AS_OF

SEEN_AS_OF = "2024-01-31 00:00:00"


@query("freshness_gate", f"""
SELECT c.uid, coalesce(k.last_scraped >= TIMESTAMP '{SEEN_AS_OF}' - to_hours(23), FALSE) AS fresh
FROM (SELECT DISTINCT uid FROM sightings) c LEFT JOIN latest_sightings k ON k.uid=c.uid""", "sightings", "latest_sightings")
def freshness_gate(t):
    return gate.freshness_gate(t.sightings.select("uid").distinct(), t.latest_sightings, SEEN_AS_OF, 23)


@query("freshness_replay_sliding", """
SELECT uid, event_id, ts FROM (SELECT *, lag(ts) OVER (PARTITION BY uid ORDER BY ts, event_id) AS prev FROM sightings) WHERE prev IS NULL OR prev < ts - to_hours(6)""", "sightings")
def freshness_replay_sliding(t):
    return gate.freshness_replay_sliding(t.sightings, 6).select("uid", "event_id", "ts")


@query("freshness_replay_fixed", """
SELECT c.uid, s.event_id, c.ts FROM chain c JOIN sightings s ON s.uid=c.uid AND s.ts=c.ts""", "sightings", recursive=True, ctes="""
later AS (SELECT a.uid, a.ts, min(b.ts) AS next_ts FROM sightings a LEFT JOIN sightings b ON b.uid=a.uid AND b.ts > a.ts + to_hours(23) GROUP BY a.uid, a.ts),
chain AS (SELECT uid, min(ts) AS ts FROM sightings GROUP BY uid UNION ALL SELECT l.uid, l.next_ts FROM chain c JOIN later l ON l.uid=c.uid AND l.ts=c.ts WHERE l.next_ts IS NOT NULL)""")
def freshness_replay_fixed(t):
    return gate.freshness_replay_fixed(t.sightings, 23).select("uid", "event_id", "ts")


@query("rejected_gate", """
SELECT uid FROM incoming WHERE uid NOT IN (SELECT uid FROM listings WHERE current_status IN ('triage_reject','final_reject','not_contacted'))""", "incoming", "listings")
def rejected_gate(t):
    return gate.rejected_gate(t.incoming, t.listings).select("uid")


@query("touch_update", f"""
SELECT l.uid, CASE WHEN i.uid IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE l.last_scraped END AS last_scraped,
 CASE WHEN i.uid IS NOT NULL THEN coalesce(l.scrape_count,0)+1 ELSE l.scrape_count END AS scrape_count,
 CASE WHEN i.uid IS NOT NULL AND coalesce(l.current_status,'new') NOT IN ('triage_reject','final_reject','not_contacted') THEN TRUE ELSE l.is_active END AS is_active
FROM listings l LEFT JOIN incoming i ON i.uid=l.uid""", "listings", "incoming")
def touch_update(t):
    return merge.touch_update(t.listings, t.incoming, AS_OF).select("uid", "last_scraped", "scrape_count", "is_active")


MERGED = ["uid", "title", "price_numeric", "bedrooms", "size_sqft", "epc_rating", "garden", "score", "tfl_zone", "region", "first_seen",
          "last_scraped", "scrape_count", "is_active"]
STAMPS = f"""CASE WHEN o.uid IS NOT NULL THEN o.first_seen ELSE TIMESTAMP '{AS_OF}' END AS first_seen,
 CASE WHEN n.uid IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE o.last_scraped END AS last_scraped,
 CASE WHEN n.uid IS NOT NULL THEN coalesce(o.scrape_count,0)+1 ELSE o.scrape_count END AS scrape_count,
 CASE WHEN n.uid IS NOT NULL THEN TRUE ELSE o.is_active END AS is_active
FROM listings o FULL OUTER JOIN incoming n ON n.uid=o.uid"""


def taken(c: str) -> str:
    return f"CASE WHEN n.uid IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}"


@query("upsert_overwrite", f"""
SELECT coalesce(o.uid,n.uid) AS uid, CASE WHEN o.uid IS NOT NULL THEN o.title ELSE n.title END AS title, {taken('price_numeric')},
 CASE WHEN o.uid IS NOT NULL THEN o.bedrooms ELSE n.bedrooms END AS bedrooms, {taken('size_sqft')}, {taken('epc_rating')}, {taken('garden')}, {taken('score')}, {taken('tfl_zone')},
 o.region, {STAMPS}""", "listings", "incoming")
def upsert_overwrite(t):
    return merge.upsert_overwrite(t.listings, t.incoming, AS_OF).select(*MERGED)


def kept(c: str, empty: str) -> str:
    return f"CASE WHEN n.uid IS NULL THEN o.{c} WHEN o.uid IS NULL THEN n.{c} ELSE coalesce(nullif(n.{c},{empty}),o.{c}) END AS {c}"


@query("upsert_coalesce", f"""
SELECT coalesce(o.uid,n.uid) AS uid, {kept('title', "''")}, {kept('price_numeric', '0')}, {kept('bedrooms', '0')}, {taken('size_sqft')}, {kept('epc_rating', "''")},
 CASE WHEN n.uid IS NULL THEN o.garden WHEN o.uid IS NULL THEN n.garden ELSE coalesce(n.garden,o.garden) END AS garden, {taken('score')}, {taken('tfl_zone')}, o.region, {STAMPS}""",
       "listings", "incoming")
def upsert_coalesce(t):
    return merge.upsert_coalesce(t.listings, t.incoming, AS_OF).select(*MERGED)


TRUTH = """truth AS (SELECT CASE WHEN portal='portal_c' AND score%7=0 THEN uid||'-gone' ELSE uid END AS uid, CAST(coalesce(score,0)%3 AS INT) AS bedrooms_seen, CASE WHEN score%4=0 THEN NULL ELSE CAST(score%3 AS INT) END AS bedrooms_with_carpet,
 CASE WHEN score%5=0 THEN NULL ELSE score%2=0 END AS has_living_area_carpet FROM listings)"""


def truth(t):
    s = F.col("score")
    gone = F.coalesce((F.col("portal") == "portal_c") & (s % 7 == 0), F.lit(False))  # labelled, and in no snapshot
    return t.listings.select(
        F.when(gone, F.concat("uid", F.lit("-gone"))).otherwise(F.col("uid")).alias("uid"), (F.coalesce(s, F.lit(0)) % 3).cast("int").alias("bedrooms_seen"),
        F.when(s % 4 == 0, None).otherwise((s % 3).cast("int")).alias("bedrooms_with_carpet"),
        F.when(s % 5 == 0, None).otherwise(s % 2 == 0).alias("has_living_area_carpet"))


@query("apply_label_truth", """
SELECT l.uid, CASE WHEN t.uid IS NULL THEN l.bedrooms_with_carpet ELSE t.bedrooms_with_carpet END AS bedrooms_with_carpet,
 CASE WHEN t.uid IS NULL THEN l.has_living_area_carpet ELSE coalesce(t.has_living_area_carpet,FALSE) END AS has_living_area_carpet,
 CASE WHEN t.uid IS NULL THEN l.carpet_in_bedroom ELSE t.bedrooms_with_carpet>0 END AS carpet_in_bedroom,
 CASE WHEN t.uid IS NULL THEN l.carpet_other_areas ELSE coalesce(t.has_living_area_carpet,FALSE) END AS carpet_other_areas
FROM listings l LEFT JOIN (SELECT * FROM truth WHERE bedrooms_seen>0) t ON t.uid=l.uid""", "listings", ctes=TRUTH)
def apply_label_truth(t):
    return merge.apply_label_truth(t.listings, truth(t)).select(
        "uid", "bedrooms_with_carpet", "has_living_area_carpet", "carpet_in_bedroom", "carpet_other_areas")


@query("label_truth_counts", """
SELECT count(*) FILTER (WHERE bedrooms_seen>0 AND l.uid IS NOT NULL) AS updated, count(*) FILTER (WHERE bedrooms_seen=0) AS skipped,
 count(*) FILTER (WHERE bedrooms_seen>0 AND l.uid IS NULL) AS unknown FROM truth t LEFT JOIN listings l ON l.uid=t.uid""", "listings", ctes=TRUTH)
def label_truth_counts(t):
    return merge.label_truth_counts(t.listings, truth(t))


@query("price_change_log", """
SELECT uid, ts, event_id, price_step AS price_numeric, price_step-prev AS price_change, round((price_step-prev)/prev*100,6) AS price_change_percent
FROM (SELECT *, lag(price_step) OVER (PARTITION BY uid ORDER BY ts, event_id) AS prev FROM sightings) WHERE prev<>0 AND price_step<>0 AND prev<>price_step""", "sightings")
def price_change_log(t):
    return merge.price_change_log(t.sightings, "price_step").withColumn("price_change_percent", F.round("price_change_percent", 6))


@query("deactivate_stale", f"""
SELECT uid, CASE WHEN last_scraped < TIMESTAMP '{AS_OF}' - to_days(900) THEN FALSE ELSE is_active END AS is_active,
 CASE WHEN last_scraped < TIMESTAMP '{AS_OF}' - to_days(900) THEN 'inactive' ELSE status END AS status FROM listings""", "listings")
def deactivate_stale(t):
    return merge.deactivate_stale(t.listings, AS_OF, 900).select("uid", "is_active", "status")


@query("properties_since", "SELECT uid, last_scraped FROM listings WHERE last_scraped >= TIMESTAMP '2001-01-01 00:00:00'", "listings")
def properties_since(t):
    return merge.properties_since(t.listings, "2001-01-01 00:00:00").select("uid", "last_scraped")


@query("run_summary", """
SELECT measure, count(*) AS n FROM (SELECT 'discovered' AS measure FROM outcomes UNION ALL SELECT outcome FROM outcomes
 UNION ALL SELECT 'drop:'||outcome||':'||drop_rule FROM outcomes WHERE drop_rule IS NOT NULL) GROUP BY measure""", "outcomes")
def run_summary(t):
    return merge.run_summary(t.outcomes)


@query("sink_snapshot", "SELECT uid, score, is_active FROM listings", "listings")
def sink_snapshot(t):
    """Write a snapshot version, swap the pointer, read it back through the pointer."""
    from proplake.plans.scratch import scratch_folder
    from proplake.sources import sinks

    root = scratch_folder(t.spark, "snapshot")
    sinks.write_snapshot(t.listings.select("uid", "score", "is_active"), root)
    return sinks.read_snapshot(t.spark, root)


@query("sink_events", "SELECT uid, event_id, price_step AS price_numeric FROM sightings", "sightings")
def sink_events(t):
    """Append the sightings in two batches, replaying the second: a replay must not double its rows."""
    from proplake.plans.scratch import scratch_folder
    from proplake.sources import sinks

    root = scratch_folder(t.spark, "events")
    rows = t.sightings.select("uid", "event_id", F.col("price_step").alias("price_numeric"))
    early = F.coalesce(F.col("price_numeric") < 200, F.lit(False))  # rows without a price are in the second batch
    sinks.append_events(rows.filter(early), root, batch_id=0)
    for _ in range(2):
        sinks.append_events(rows.filter(~early), root, batch_id=1)
    return t.spark.read.parquet(root).drop("batch_id")


@query("sink_report_csv_json", "SELECT variant, count(*) AS n_calls FROM calls GROUP BY variant", "calls")
def sink_report_csv_json(t):
    from proplake.plans.scratch import scratch_folder
    from proplake.sources import sinks

    root = scratch_folder(t.spark, "report")
    sinks.write_report(t.calls, t.calls.groupBy("variant").agg(F.count("*").alias("n_calls")), root)
    calls = t.spark.read.option("header", True).csv(f"{root}/per_call").groupBy("variant").agg(F.count("*").alias("n_calls"))
    return calls.join(t.spark.read.json(f"{root}/summary").select("variant", "n_calls"), ["variant", "n_calls"])


@query("scan_labelled_csv", "SELECT CAST(label AS INT) AS label, count(*) AS n, round(sum(score),6) AS total FROM scored_pairs GROUP BY label", "scored_pairs")
def scan_labelled_csv(t):
    """Labelled scores written as CSV and scanned with the declared schema."""
    from proplake.plans.scratch import scratch_folder
    from proplake.sources import readers

    root = scratch_folder(t.spark, "csv")
    t.scored_pairs.select(F.lit("1 Mill Lane").alias("listing_address"), F.lit("1 Mill Lane, Hackney").alias("epc_address"), "score", "label").write.option(
        "header", True).csv(f"{root}/pairs")
    rows = readers.read_labelled_csv(t.spark, f"{root}/pairs")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"))
