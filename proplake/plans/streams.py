"""Streaming jobs over the event table, checked against their batch meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proplake.operators import merge
from proplake.plans.lifecycle import FOLD
from proplake.plans.registry import query
from proplake.plans.scratch import scratch_folder
from proplake.plans.snapshots import SEEN_AS_OF
from proplake.sources.adapters import pick
from proplake.streaming import streams as S


SLICES = 4  # micro-batches a stream arrives in
FILES = 4  # files of each


def events(t) -> DataFrame:
    """The event table as a stream of several micro-batches, a slice of time each.

    A last row, of no user and ten years on, stands for the time that goes by: the watermark passes all that came before.
    """
    root = scratch_folder(t.spark, "arrivals")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = t.events.agg(F.percentile_approx(at, [i / SLICES for i in range(1, SLICES)], 10_000).alias("cuts")).first()["cuts"] or []
    part = sum(((at > cut).cast("int") for cut in cuts), F.lit(0))
    for k in range(len(cuts) + 1):
        t.events.filter(part == k).repartition(FILES).write.mode("append").parquet(root)
    kinds = {f.name: f.dataType for f in t.events.schema}
    row = {c: F.lit(None).cast(k) for c, k in kinds.items()} | {"ts": (F.col("ts") + F.expr("INTERVAL 10 YEARS")).cast(kinds["ts"]), "event_id": F.lit(0).cast(kinds["event_id"])}
    t.events.agg(F.max("ts").alias("ts")).filter("ts IS NOT NULL").select(*[row[c].alias(c) for c in kinds]).write.mode("append").parquet(root)
    return t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", FILES).parquet(root)


def events_out_of_order(t) -> DataFrame:
    """The event table as a stream of several micro-batches, each from all over the time."""
    root = scratch_folder(t.spark, "arrivals")
    for k in range(SLICES):
        t.events.filter(F.pmod("event_id", F.lit(SLICES)) == k).repartition(FILES).write.mode("append").parquet(root)
    return t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", FILES).parquet(root)


def sightings(t) -> DataFrame:
    step = F.when(F.col("event_id") % 9 == 0, None).otherwise(F.floor("value").cast("long") % 5 * 100)
    return events(t).select(F.col("user_id").cast("string").alias("uid"), "event_id", F.col("ts").cast("timestamp").alias("ts"), step.alias("price_step"))


@query("stream_freshness_sliding", """
SELECT uid, event_id FROM (SELECT *, lag(ts) OVER (PARTITION BY uid ORDER BY ts, event_id) AS prev FROM sightings) WHERE prev IS NULL OR prev < ts - to_hours(6)""", "sightings")
def stream_freshness_sliding(t):
    return S.run_available(t.spark, S.stream_freshness_sliding(sightings(t), 6), scratch_folder(t.spark, "stream")).filter("uid IS NOT NULL").select("uid", "event_id")


@query("stream_freshness_fixed", "SELECT c.uid, s.event_id FROM chain c JOIN sightings s ON s.uid=c.uid AND s.ts=c.ts", "sightings", recursive=True, ctes="""
later AS (SELECT a.uid, a.ts, min(b.ts) AS next_ts FROM sightings a LEFT JOIN sightings b ON b.uid=a.uid AND b.ts > a.ts + to_hours(23) GROUP BY a.uid, a.ts),
chain AS (SELECT uid, min(ts) AS ts FROM sightings GROUP BY uid UNION ALL SELECT l.uid, l.next_ts FROM chain c JOIN later l ON l.uid=c.uid AND l.ts=c.ts WHERE l.next_ts IS NOT NULL)""")
def stream_freshness_fixed(t):
    return S.run_available(t.spark, S.stream_freshness_fixed(sightings(t), 23), scratch_folder(t.spark, "stream")).filter("uid IS NOT NULL").select("uid", "event_id")


@query("stream_price_change", """
SELECT uid, event_id, price_step AS price_numeric, price_step-prev AS price_change FROM (SELECT *, lag(price_step) OVER (PARTITION BY uid ORDER BY ts, event_id) AS prev FROM sightings)
WHERE prev<>0 AND price_step<>0 AND prev<>price_step""", "sightings")
def stream_price_change(t):
    return S.run_available(t.spark, S.stream_price_change(sightings(t), "price_step"), scratch_folder(t.spark, "stream")).filter("uid IS NOT NULL")


@query("stream_lifecycle", "SELECT uid, id, from_status, to_status, accepted FROM fold", "transitions", ctes=FOLD, recursive=True)
def stream_lifecycle(t):
    states = pick("(event_id*7+user_id)%8", "contact_queued", "contacted", "shortlisted", "triage_reject", "not_contacted", "final_reject", "new", "archived")
    asked = events(t).select(F.col("user_id").cast("string").alias("uid"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"),
                             F.expr(states).alias("to_status"))
    return S.run_available(t.spark, S.stream_lifecycle(asked), scratch_folder(t.spark, "stream")).filter("uid IS NOT NULL")


@query("stream_newness_counts", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM sightings GROUP BY 1", "sightings")
def stream_newness_counts(t):
    return S.run_available(t.spark, S.stream_newness_counts(sightings(t)), scratch_folder(t.spark, "stream"))


@query("stream_last_seen", f"""
SELECT uid, max(ts) AS last_scraped, max(ts) >= TIMESTAMP '{SEEN_AS_OF}' - to_days(2) AS is_active FROM sightings GROUP BY uid""", "sightings")
def stream_last_seen(t):
    seen = S.run_available(t.spark, S.stream_last_seen(sightings(t)), scratch_folder(t.spark, "stream"), "complete").filter("uid IS NOT NULL")
    return merge.deactivate_stale(seen.withColumns({"is_active": F.lit(True), "status": F.lit("active")}), SEEN_AS_OF, 2).select(
        "uid", "last_scraped", "is_active")


@query("stream_deactivate", """
SELECT uid, ts AS last_scraped, ts + to_days(2) AS deactivated_at FROM (SELECT uid, ts, lead(ts) OVER (PARTITION BY uid ORDER BY ts, event_id) AS later FROM sightings)
WHERE later IS NULL OR later >= ts + to_days(2)""", "sightings")
def stream_deactivate(t):
    return S.run_available(t.spark, S.stream_deactivate(sightings(t), 2), scratch_folder(t.spark, "stream")).filter("uid IS NOT NULL")


@query("stream_upsert", f"""
SELECT coalesce(k.uid, s.uid) AS uid, coalesce(s.price_numeric, 0) AS price_numeric, CAST(coalesce(k.scrape_count, 0) + coalesce(s.batches, 0) AS INT) AS scrape_count
FROM latest_sightings k FULL JOIN (SELECT uid, arg_max(price_numeric, (event_id % {SLICES}, ts, event_id)) AS price_numeric, count(DISTINCT event_id % {SLICES}) AS batches FROM sightings GROUP BY uid) s ON s.uid=k.uid""",
       "sightings", "latest_sightings")
def stream_upsert(t):
    """Stream sightings, in batches that are not in order of time, into a snapshot that starts with the known listings."""
    root = scratch_folder(t.spark, "upsert")
    start = t.latest_sightings.select("uid", F.col("last_scraped").cast("timestamp").alias("last_scraped"), "scrape_count", F.lit(0).cast("long").alias("price_numeric"),
                                      F.col("last_scraped").cast("timestamp").alias("first_seen"), F.lit(True).alias("is_active"), F.lit("active").alias("status"))
    S.write_buckets(start, root, "start")
    arriving = events_out_of_order(t).select(F.col("user_id").cast("string").alias("uid"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
                                F.floor(F.col("value") * 100).cast("long").alias("price_numeric"))
    arriving.writeStream.option("checkpointLocation", f"{root}/state").foreachBatch(
        S.upsert_batches(root, SEEN_AS_OF, ["ts", "event_id"], start.schema)).trigger(availableNow=True).start().awaitTermination()
    done = S.manifest(t.spark, root, str(SLICES - 1))
    return S.read_buckets(t.spark, root, done, start.schema).select("uid", "price_numeric", "scrape_count")


@query("stream_cluster_assign")
def stream_cluster_assign(t):
    """Later adverts arrive in batches and join the clusters of the snapshot, or those that an earlier batch has made."""
    from proplake.plans.matching import clustered
    from proplake.sources import sinks

    root = scratch_folder(t.spark, "clusters")
    columns = t.arrivals.columns
    sinks.append_events(clustered(t, *columns).select(*columns, "cluster_id", F.lit(False).alias("is_new")), f"{root}/members", -1)
    for k in range(2):
        t.arrivals.filter(F.pmod(F.xxhash64("uid"), F.lit(2)) == k).repartition(FILES).write.mode("append").parquet(f"{root}/arrivals")
    arriving = t.spark.readStream.schema(t.arrivals.schema).option("maxFilesPerTrigger", FILES).parquet(f"{root}/arrivals")
    arriving.writeStream.option("checkpointLocation", f"{root}/state").foreachBatch(
        S.cluster_batches(root)).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{root}/members").filter("batch_id >= 0").select("uid", "cluster_id", "is_new")
