"""Ordered hard filters with drop accounting, and the freshness gates that decide what is enriched again."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proplake.config import DEFAULTS, RATING_ORDER, REJECT_STATES
from proplake.functions.sequence import bucketed_fold, with_previous

# --- fixed values: title patterns -----------------------------------------------------------------------
LET_AGREED_TITLE = r"(?i)\blet\s*agreed\b|\bunder\s*offer\b|\blet\s*by\b|\bnow\s*let\b|\btenanted\b"
# --- end of fixed values --------------------------------------------------------------------------------


def price_pcm(pence: Column) -> Column:
    """Whole pounds per month from integer pence."""
    return F.floor(pence / 100).cast("long")


def is_let_agreed_title(title: Column) -> Column:
    return F.coalesce(title.rlike(LET_AGREED_TITLE), F.lit(False))


def _outside(value: Column, bounds: dict[str, Any]) -> Column:
    """True when the value is NULL or beyond either bound."""
    tests = [value.isNull()]
    if bounds.get("min") is not None:
        tests.append(value < bounds["min"])
    if bounds.get("max") is not None:
        tests.append(value > bounds["max"])
    return reduce(lambda a, b: a | b, tests)


def filter_rules(hard: dict[str, Any]) -> list[tuple[str, Column | None]]:
    """(rule name, failure test) in application order; a rule reported as disabled has no test."""
    rules: list[tuple[str, Column | None]] = []
    price, beds = hard.get("price") or {}, hard.get("bedrooms") or {}
    if price.get("min") is not None or price.get("max") is not None:
        rules.append(("price", _outside(price_pcm(F.col("price_numeric")), price)))
    if beds.get("min") is not None or beds.get("max") is not None:
        rules.append(("bedrooms", _outside(F.col("bedrooms"), beds)))
    floor = hard.get("epc_min_rating")
    if floor:
        floor = floor.upper()
        if floor not in RATING_ORDER:
            raise ValueError(f"rating floor {floor!r} is not one of {RATING_ORDER}")
        rating = F.upper("epc_rating")
        known = F.coalesce(rating.isin(RATING_ORDER), F.lit(False))
        worse = rating.isin(RATING_ORDER[RATING_ORDER.index(floor) + 1:] or [""])
        rules.append(("epc", F.when(known, worse).otherwise(F.lit(bool(hard.get("epc_drop_null", False))))))
    if hard.get("tfl_zone_max") is not None:
        zone = F.col("tfl_zone").try_cast("int")
        rules.append(("tfl_zone", F.coalesce(zone > hard["tfl_zone_max"], F.lit(False))))
    if hard.get("size_sqft_min") is not None:
        size = F.col("size_sqft").try_cast("int")
        rules.append(("size_sqft", F.coalesce(size < hard["size_sqft_min"], F.lit(False))))
    if hard.get("drop_let_agreed", False):
        rules.append(("let_agreed", F.coalesce(F.col("is_let_agreed"), F.lit(False))))
    if hard.get("regions") is not None and hard.get("region_drop_unlisted", False):
        rules.append(("region", ~F.coalesce(F.col("region").isin(list(hard["regions"])), F.lit(False))))
    else:
        rules.append(("region", None))
    return rules


def with_first_fail(df: DataFrame, hard: dict[str, Any] | None = None) -> DataFrame:
    """Add ``first_fail``: the first rule a listing breaks, NULL for survivors."""
    tests = [F.when(test, F.lit(name)) for name, test in filter_rules(hard or DEFAULTS["hard_filters"]) if test is not None]
    return df.withColumn("first_fail", F.coalesce(*tests) if tests else F.lit(None).cast("string"))


def hard_filter(df: DataFrame, hard: dict[str, Any] | None = None) -> DataFrame:
    """Survivors only."""
    return with_first_fail(df, hard).filter(F.col("first_fail").isNull()).drop("first_fail")


def hard_filter_drops(df: DataFrame, hard: dict[str, Any] | None = None) -> DataFrame:
    """(rule, dropped) for every rule in force, zeros included, from one aggregation pass."""
    hard = hard or DEFAULTS["hard_filters"]
    names = [name for name, _ in filter_rules(hard)]
    counts = with_first_fail(df, hard).agg(*[F.count_if(F.col("first_fail") == n).alias(n) for n in names])
    return counts.unpivot([], names, "rule", "dropped")


def two_stage_gate(df: DataFrame, stage2: DataFrame, hard: dict[str, Any] | None = None, key: str = "uid") -> DataFrame:
    """Filter, join the costly enrichment to the survivors only, filter again.

    ``stage2`` columns replace the listing's own where they are not NULL. Result: survivors of stage 1 with
    ``first_fail`` telling what stage 2 dropped.
    """
    survivors = hard_filter(df, hard)
    extra = [c for c in stage2.columns if c != key]
    joined = survivors.alias("l").join(stage2.alias("r"), key, "left")
    columns = [
        F.coalesce(F.col(f"r.{c}"), F.col(f"l.{c}")).alias(c) if c in extra and c in survivors.columns
        else F.col(f"r.{c}") if c in extra else F.col(f"l.{c}")
        for c in [c for c in survivors.columns if c != key] + [c for c in extra if c not in survivors.columns]
    ]
    return with_first_fail(joined.select(key, *columns), hard)


def skip_non_flat(df: DataFrame) -> DataFrame:
    """Keep rows that have both a bedroom count and a price; the rest count as failed."""
    return df.filter(F.col("bedrooms").isNotNull() & F.col("price_numeric").isNotNull())


def candidate_cap(df: DataFrame, n: int, profile: str = "profile", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """First ``n`` candidates of each search profile in discovery order."""
    w = Window.partitionBy(profile).orderBy(*order)
    return df.withColumn("rank_in_profile", F.row_number().over(w)).filter(F.col("rank_in_profile") <= n)


def freshness_gate(candidates: DataFrame, known: DataFrame, as_of: str, hours: float) -> DataFrame:
    """Mark candidates ``fresh`` when their stored sighting is at most ``hours`` old. Non-positive hours disable it."""
    if hours <= 0:
        return candidates.withColumn("fresh", F.lit(False))
    cutoff = F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(secs=F.lit(hours * 3600.0))
    recent = known.filter(F.col("last_scraped") >= cutoff).select("uid", F.lit(True).alias("seen"))
    return candidates.join(recent, "uid", "left").withColumn("fresh", F.coalesce("seen", F.lit(False))).drop("seen")


def rejected_gate(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates whose stored listing is not in a reject state."""
    return candidates.join(known.filter(F.col("current_status").isin(REJECT_STATES)).select("uid"), "uid", "left_anti")


def freshness_replay_sliding(sightings: DataFrame, hours: float, bucket_seconds: float = 86_400.0) -> DataFrame:
    """Sightings that trigger enrichment when every sighting renews the clock: the first of each gap-bounded run."""
    horizon = F.make_dt_interval(secs=F.lit(hours * 3600.0))
    previous = with_previous(sightings, ["ts"], bucket_seconds=bucket_seconds)
    stale = F.col("previous").isNull() | (F.col("previous.ts") < F.col("ts") - horizon)
    return previous.filter(stale).drop("previous")


def freshness_replay_fixed(sightings: DataFrame, hours: float, horizons_per_bucket: int = 8) -> DataFrame:
    """Sightings that trigger enrichment when only enrichment renews the clock.

    The clock is a sequential fold, but what one time bucket does to it is a step function: the clock on entry
    decides the first row enriched, which decides the clock on exit. Each bucket emits the steps (rows inside its first horizon,
    merged where they end alike), the steps are threaded per listing, and every bucket is then replayed on its own.
    """
    import numpy as np
    import pandas as pd

    span = int(hours * 3600.0 * 1_000_000)

    def micros(column: Any) -> Any:
        return column.astype("datetime64[us]").astype("int64").to_numpy()

    def steps(key, held):
        stamps = np.unique(np.asarray(held, dtype="int64"))
        follower = np.searchsorted(stamps, stamps + span, side="right")
        final = stamps.copy()
        for i in range(len(stamps) - 1, -1, -1):
            if follower[i] < len(stamps):
                final[i] = final[follower[i]]
        reach = min(int(np.searchsorted(stamps, stamps[0] + span, side="right")) + 1, len(stamps))
        # keep the last row of each run of equal exits: a bisect on it still finds the right exit
        last = np.append(final[1:reach] != final[:reach - 1], True)
        return [(*key, int(a), int(b)) for a, b in zip(stamps[:reach][last], final[:reach][last])]

    def summarise(batches):
        key, held = None, []
        for pdf in batches:
            rows = []
            for uid, bucket, stamp in zip(pdf["uid"], pdf["bucket"], micros(pdf["ts"])):
                if (uid, bucket) != key:
                    if held:
                        rows.extend(steps(key, held))
                    key, held = (uid, bucket), []
                held.append(stamp)
            yield pd.DataFrame(rows, columns=["uid", "bucket", "stamp", "final"])
        if held:
            yield pd.DataFrame(steps(key, held), columns=["uid", "bucket", "stamp", "final"])

    def thread(batches):
        key, clock, leave, settled = None, None, None, True
        for pdf in batches:
            rows = []
            for uid, bucket, stamp, final in zip(pdf["uid"], pdf["bucket"], pdf["stamp"], pdf["final"]):
                if (uid, bucket) != key:
                    clock = None if key is None or uid != key[0] else leave
                    key, leave, settled = (uid, bucket), clock, False
                    rows.append((uid, bucket, clock))
                if not settled and (clock is None or stamp > clock + span):
                    leave, settled = int(final), True
            out = pd.DataFrame(rows, columns=["uid", "bucket", "clock"])
            yield out.astype({"clock": "Int64"})

    names = sightings.columns

    def replay(batches):
        key, clock = None, None
        for pdf in batches:
            keep = []
            for uid, bucket, entry, stamp in zip(pdf["uid"], pdf["bucket"], pdf["clock"], micros(pdf["ts"])):
                if (uid, bucket) != key:
                    key, clock = (uid, bucket), None if pd.isna(entry) else int(entry)
                due = clock is None or stamp > clock + span
                if due:
                    clock = int(stamp)
                keep.append(due)
            yield pdf.loc[keep, names]

    return bucketed_fold(
        sightings, order=("ts", "event_id"), bucket_seconds=hours * 3600.0 * horizons_per_bucket,
        summarise=summarise, summary_schema="uid string, bucket long, stamp long, final long",
        thread=thread, entry_schema="uid string, bucket long, clock long",
        replay=replay, out_schema=sightings.schema, thread_order=("bucket", "stamp"),
    )
