"""Structured Streaming forms of the gates, logs and merges. Each has a batch twin that gives the same rows."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from proplake.config import LEGAL_TRANSITIONS, STATES
from proplake.operators import merge, resolve
from proplake.session import cut_lineage
from proplake.sources import sinks


def stream_freshness_sliding(sightings: DataFrame, hours: float, delay: str = "1 hour") -> DataFrame:
    """First sighting of every run of sightings no more than ``hours`` apart; a run closes when the watermark passes it."""
    gap = f"{int(hours * 3600)} seconds"
    return sightings.withWatermark("ts", delay).groupBy("uid", F.session_window("ts", gap)).agg(
        F.min(F.struct("ts", "event_id")).alias("first")).select("uid", "first.event_id", "first.ts")


def stream_newness_counts(listings: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Discoveries per hour, to be summed into the newness horizons."""
    return listings.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("hour"), "n")


def stream_last_seen(sightings: DataFrame) -> DataFrame:
    """Latest sighting per listing so far; every batch gives the whole table anew."""
    return sightings.groupBy("uid").agg(F.max("ts").alias("last_scraped"), F.count("*").alias("scrape_count"))


def stream_deactivate(sightings: DataFrame, days: int, delay: str = "1 hour") -> DataFrame:
    """(uid, last_scraped, deactivated_at), appended when a listing has been quiet for ``days``; its state goes with the row.

    A sighting at the limit or later starts anew and revives the listing. One that comes late, but before the watermark has
    passed the limit, still keeps it active.
    """
    quiet = F.session_window("ts", f"{days} days")
    runs = sightings.withWatermark("ts", delay).groupBy("uid", quiet).agg(F.max("ts").alias("last_scraped"))
    return runs.select("uid", "last_scraped", F.col("session_window.end").alias("deactivated_at"))


NONE_KNOWN = pickle.dumps(([], [], [], np.zeros((3, 0), np.int64), []))
FORGET_DAYS = 400
KEY_GROUPS = 2_048  # groups of keys that share a call and a state row; fixed for the life of a checkpoint


def _keyed(df: DataFrame, step: Callable, out_schema: str, delay: str, forget: int, groups: int = KEY_GROUPS) -> DataFrame:
    """Fold each key's rows in (ts, id) order through ``step(uid, state, ts, id, value) -> (state, output or None)``.

    ``df`` has uid, ts, id and value (string). Rows wait in the state until the watermark has passed them, so rows that arrive
    out of order by up to ``delay``, in one batch or over several, are folded in order; later ones are dropped. Keys share calls
    by a hash, ``groups`` of them, since a call costs more than the rows of one key. What is kept of a key is a number and the
    rows that wait; it goes when nothing waits and the key has been quiet for ``forget`` microseconds.
    """
    import pandas as pd

    names = [part.split()[0] for part in out_schema.split(", ")]

    def run(key, batches, state):
        uids, held, last, places, values = pickle.loads(state.get[0] if state.exists else NONE_KNOWN)
        number = {uid: i for i, uid in enumerate(uids)}
        if not state.hasTimedOut:
            parts = [places]
            for batch in batches:
                owners = [number.setdefault(uid, len(number)) for uid in batch["uid"].tolist()]
                parts.append(np.stack((np.array(owners, np.int64), batch["ts"].to_numpy(), batch["id"].to_numpy())))
                values += batch["value"].tolist()
            places = np.concatenate(parts, axis=1)
            uids = list(number)
            held += [None] * (len(uids) - len(held))
            last += [0] * (len(uids) - len(last))
        passed = state.getCurrentWatermarkMs() * 1_000
        ready = np.flatnonzero(places[1] <= passed)
        ready = ready[np.lexsort(places[::-1, ready])]
        out = []
        for owner, ts, row, at in zip(*places[:, ready].tolist(), ready.tolist()):
            last[owner] = ts
            held[owner], produced = step(uids[owner], held[owner], ts, row, values[at])
            if produced is not None:
                out.append(produced)
        wait = np.flatnonzero(places[1] > passed)
        places, values = places[:, wait], [values[i] for i in wait.tolist()]
        due = {i: at + forget for i, at in enumerate(last)}
        for owner, ts in zip(*places[:2, np.argsort(-places[1])].tolist()):
            due[owner] = ts  # its earliest row that waits comes last
        waiting = set(places[0].tolist())
        kept = [i for i in due if i in waiting or passed < due[i]]
        if kept:
            places[0] = np.searchsorted(kept, places[0])
            state.update((pickle.dumps(([uids[i] for i in kept], [held[i] for i in kept], [last[i] for i in kept], places, values)),))
            state.setTimeoutTimestamp(max(min(due[i] for i in kept), passed) // 1_000 + 1)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=names)

    at = F.unix_micros(F.col("event_time"))
    rows = df.withColumnRenamed("ts", "event_time").withWatermark("event_time", delay).select(
        F.pmod(F.xxhash64("uid"), F.lit(groups)).alias("keys"), "uid", "event_time", at.alias("ts"), "id", F.col("value").cast("string").alias("value"))
    return rows.groupBy("keys").applyInPandasWithState(run, out_schema, "known binary", "append", GroupStateTimeout.EventTimeTimeout)


def stream_freshness_fixed(sightings: DataFrame, hours: float, delay: str = "1 hour") -> DataFrame:
    """Sightings that trigger enrichment when only enrichment renews the clock; state is the last enrichment, forgotten once
    it is out of date."""
    span = int(hours * 3600 * 1_000_000)

    def step(uid, clock, ts, number, value):
        if clock is None or ts > clock + span:
            return ts, (uid, number, ts)
        return clock, None

    rows = sightings.select("uid", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("value"))
    return _keyed(rows, step, "uid string, event_id long, at long", delay, span).select("uid", "event_id", F.timestamp_micros("at").alias("ts"))


def stream_price_change(sightings: DataFrame, price: str = "price_numeric", delay: str = "1 hour", forget_days: int = FORGET_DAYS) -> DataFrame:
    """Price changes against the previous sighting; state is the last price, forgotten after ``forget_days`` without a sighting."""
    def step(uid, last, ts, number, value):
        now = None if value is None else int(value)
        changed = bool(last) and bool(now) and last != now
        return now, (uid, number, now, now - last) if changed else None

    rows = sightings.select("uid", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col(price).alias("value"))
    return _keyed(rows, step, "uid string, event_id long, price_numeric long, price_change long", delay, forget_days * 86_400_000_000)


def stream_lifecycle(requests: DataFrame, delay: str = "1 hour", forget_days: int = FORGET_DAYS) -> DataFrame:
    """Every request with the state it met and the verdict; state is the current status, forgotten after ``forget_days``
    without a request."""
    def step(uid, status, ts, number, asked):
        now = STATES[status or 0]
        legal = asked in LEGAL_TRANSITIONS[now]
        return STATES.index(asked) if legal else status or 0, (uid, number, now, asked, legal)

    rows = requests.select("uid", "id", F.col("ts").cast("timestamp").alias("ts"), F.col("to_status").alias("value"))
    return _keyed(rows, step, "uid string, id long, from_status string, to_status string, accepted boolean", delay, forget_days * 86_400_000_000)


BUCKETS = 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64("uid"), F.lit(BUCKETS)).cast("int")


def write_buckets(df: DataFrame, root: str, version: str, base: dict[int, str] | None = None) -> None:
    """Write the rows of some buckets as ``version`` and a manifest that takes all other buckets from ``base``.

    A manifest has one row for each bucket: the version that wrote it last. It is written after its data, so what it names exists.
    """
    spark = df.sparkSession
    path = f"{root}/data/version={version}"
    df.withColumn("bucket", _bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    written = {r["bucket"] for r in spark.read.parquet(path).select("bucket").distinct().collect()}
    held = sorted({**(base or {}), **{b: version for b in written}}.items())
    spark.createDataFrame(held, "bucket int, version string").coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/version={version}")


def manifest(spark: SparkSession, root: str, version: str) -> dict[int, str]:
    """Version of every bucket that holds rows; at most BUCKETS entries."""
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{root}/manifest/version={version}").collect()}


def read_buckets(spark: SparkSession, root: str, held: dict[int, str], schema: StructType) -> DataFrame:
    paths = [f"{root}/data/version={version}/bucket={bucket}" for bucket, version in sorted(held.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_batches(root: str, as_of: str, order: list[str], schema: StructType) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: last row per uid of the batch, merged into the snapshot in hash buckets under ``root``.

    Only buckets that the batch touches are read and written. The base of batch n is the manifest of batch n - 1 (of ``start``
    for the first), which a replay finds unchanged, so it writes the same version again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        latest = cut_lineage(merge.latest_per_key(batch, order))
        base = manifest(spark, root, str(batch_id - 1) if batch_id else "start")
        touched = {r["bucket"] for r in latest.select(_bucket().alias("bucket")).distinct().collect()}
        old = read_buckets(spark, root, {b: v for b, v in base.items() if b in touched}, schema)
        write_buckets(merge.upsert_overwrite(old, latest, as_of), root, str(batch_id), base)

    return write


def cluster_batches(root: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: assign each arrival to the smallest matching cluster, of the start or of an earlier batch, or a new one.

    ``root``/members holds clustered listings by batch (the start under batch -1), ``root``/clusters the refreshed rows of the
    clusters a batch touched: primary, prices, count, centroid, times. A batch reads earlier batches only and owns its folders, so a replay writes the same again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        members = batch.sparkSession.read.parquet(f"{root}/members")
        known = members.filter(F.col("batch_id") < batch_id).drop("batch_id")
        arrivals = cut_lineage(batch)
        done = resolve.cluster_assign_incremental(arrivals, known.select(*arrivals.columns, "cluster_id"))
        sinks.append_events(arrivals.join(done, "uid").select(*arrivals.columns, "cluster_id", "is_new"), f"{root}/members", batch_id)
        new = batch.sparkSession.read.parquet(f"{root}/members/batch_id={batch_id}")
        kinds = {c: F.lit(None).cast("string").alias(c) for c in resolve.ENRICHMENT_FIELDS if c not in new.columns and c not in known.columns}
        sinks.append_events(resolve.refreshed_clusters(new.select("*", *kinds.values()), known), f"{root}/clusters", batch_id)

    return write


def run_available(spark: SparkSession, df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a streaming frame over all available input into a parquet folder (complete mode keeps the last result)."""
    target = f"{folder}/out"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(target if mode == "complete" else f"{target}/batch_id={batch_id}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(target).select(*df.columns)
