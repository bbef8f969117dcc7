"""Table-driven weighted scoring. Curves are native expressions built from the configuration dict."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proplake.config import ALERT_THRESHOLD, DEFAULTS, seed_weights
from proplake.operators.gate import price_pcm

Config = dict[str, Any]


def _block(name: str, config: Config | None) -> Config:
    return (config or DEFAULTS)["scoring"]["components"].get(name, {})


def half_even(value: Column) -> Column:
    """Integer by rounding half to even."""
    return F.bround(value, 0).cast("int")


def lookup(key: Column, table: dict[Any, int], default: Column | int | None = None) -> Column:
    """CASE over a small literal map."""
    expr = F
    for k, v in table.items():
        expr = expr.when(key == F.lit(k), F.lit(int(v)))
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default)) if table else F.lit(default)


def tier_curve(value: Column, tiers: list[dict[str, int]], null_score: int = 50) -> Column:
    """First ``at_or_below`` tier that holds, else the ``above`` tier, else 0."""
    expr = F.when(value.isNull(), F.lit(int(null_score)))
    for tier in tiers:
        if "at_or_below" in tier:
            expr = expr.when(value <= int(tier["at_or_below"]), F.lit(int(tier["score"])))
    above = [tier["score"] for tier in tiers if "above" in tier]
    return expr.otherwise(F.lit(int(above[0]) if above else 0))


def price_score(pcm: Column, config: Config | None = None) -> Column:
    block = _block("price", config)
    full, zero = int(block.get("full_marks_at_or_below", 2800)), int(block.get("zero_marks_at_or_above", 3200))
    return (
        F.when(pcm.isNull() | (pcm <= 0), 0).when(pcm <= full, 100).when(pcm >= zero, 0)
        .otherwise(half_even((zero - pcm) * 100 / F.lit(max(zero - full, 1))))
    )


def size_score(sqft: Column, config: Config | None = None) -> Column:
    block = _block("size", config)
    full = int(block.get("full_marks_at_or_above_sqft", 650))
    zero = int(block.get("zero_marks_at_or_below_sqft", 400))
    return (
        F.when(sqft.isNull(), int(block.get("null_score", 50))).when(sqft >= full, 100).when(sqft <= zero, 0)
        .otherwise(half_even((sqft - zero) * 100 / F.lit(max(full - zero, 1))))
    )


def bedrooms_score(beds: Column, config: Config | None = None) -> Column:
    block = _block("bedrooms", config)
    rest = F.when(beds >= 2, 100).when(beds == 1, 50).otherwise(0)
    table = {int(k): v for k, v in (block.get("scores") or {}).items()}
    return F.when(beds.isNull(), int(block.get("null_score", 0))).otherwise(lookup(beds, table, rest) if table else rest)


def rating_score(rating: Column, config: Config | None = None, null_score: int | None = None) -> Column:
    block = _block("epc", config)
    missing = int(block.get("null_score", 0)) if null_score is None else null_score
    return F.when(rating.isNull(), missing).otherwise(lookup(F.upper(rating), block.get("scores") or {}, 50))


def transport_score(minutes: Column, zone: Column, config: Config | None = None) -> Column:
    block = _block("transport", config)
    zones = {int(k): v for k, v in block.get("zone_scores", {}).items()}
    zone_score = lookup(zone, zones, F.when(zone >= 4, 0).otherwise(50))
    journey = tier_curve(minutes, block["journey_minutes"])
    blend = float(block.get("journey_zone_blend", 0.75))
    mixed = half_even(
        journey * F.lit(blend) + F.when(zone.isNull(), 50).otherwise(zone_score) * F.lit(1.0 - blend)
    )
    return (
        F.when(minutes.isNull() & zone.isNull(), int(block.get("null_score", 50)))
        .when(minutes.isNull(), zone_score).otherwise(mixed)
    )


def outside_score(garden: Column, balcony: Column, config: Config | None = None) -> Column:
    scores = _block("outside", config).get("scores") or {"garden": 100, "balcony": 60, "none": 0}
    return F.when(garden, int(scores["garden"])).when(balcony, int(scores["balcony"])).otherwise(int(scores["none"]))


def flag_score(detected: Column, block: Config, detected_default: int = 20) -> Column:
    """Three-state flag curve: detected / not detected / unknown."""
    return (
        F.when(detected.isNull(), int(block.get("null_score", 50)))
        .when(detected, int(block.get("detected_score", detected_default)))
        .otherwise(int(block.get("not_detected_score", 100)))
    )


def carpet_count_score(bedrooms: Column, living: Column, block: Config) -> Column:
    """Count table with a living-area override; counts beyond the table take its highest entry."""
    null_score = int(block.get("null_score", 50))
    table = {int(k): int(v) for k, v in (block.get("bedrooms_with_carpet_score") or {}).items()}
    capped = F.lit(table[max(table)] if table else 50)
    return (
        F.when(bedrooms.isNull() & living.isNull(), null_score)
        .when(living, int(block.get("has_living_area_carpet_override", 0)))
        .when(bedrooms.isNull(), null_score)
        .otherwise(lookup(bedrooms, table, capped) if table else capped)
    )


def carpet_legacy_score(detected: Column, confidence: Column) -> Column:
    swing = F.coalesce(confidence, F.lit(0.0)) * 50
    return F.when(detected.isNull(), 50).when(detected, half_even(swing + 50)).otherwise(half_even(F.lit(50) - swing))


def carpet_path(weights: dict[str, float]) -> Column:
    """Which carpet breakdown a row takes: ``binary``, ``count`` or ``split``."""
    legacy = F.col("carpet_detected").isNotNull()
    counted = F.col("bedrooms_with_carpet").isNotNull() | F.col("has_living_area_carpet").isNotNull()
    split = F.col("carpet_in_bedroom").isNotNull() | F.col("carpet_other_areas").isNotNull()
    weighted = F.lit(weights.get("carpet", 0.0) > 0.0)
    return (
        F.when(legacy | ~(counted | split), "binary").when(counted & (weighted | ~split), "count").otherwise("split")
    )


def region_score(region: Column, config: Config | None = None) -> Column:
    """Tier score of a region by literal map; the join form for large tier tables is ``region_score_join``."""
    config = config or DEFAULTS
    block = config["scoring"]["components"].get("region_tier", {})
    table = {
        name: int(block.get(tier, 75)) for tier in ("tier_3", "tier_2", "tier_1")
        for name in config["regions_by_tier"].get(tier, [])
    }
    return F.when(region.isNull() | (region == ""), 0).otherwise(lookup(region, table, int(block.get("unlisted", 75))))


def region_score_join(df: DataFrame, tiers: DataFrame, unlisted: int = 75) -> DataFrame:
    """Same score from a (region, tier_score) table; Spark picks broadcast or shuffle by its size."""
    return df.join(tiers, "region", "left").withColumn(
        "region_pref",
        F.when(F.col("region").isNull() | (F.col("region") == ""), 0).otherwise(F.coalesce("tier_score", F.lit(unlisted))),
    ).drop("tier_score")


def curve_scores(values: DataFrame, curves: DataFrame, null_score: int = 50) -> DataFrame:
    """``values`` (.., component, value) plus ``curve_score``: the score of the first step that reaches the value, else of the
    open step, from a (component, at_or_below, score) table; NULL values get ``null_score``, values of no curve are left out.

    Each curve becomes one row that holds its steps, so values are never multiplied by steps or shuffled.
    """
    step = F.struct(F.coalesce("at_or_below", F.lit(2 ** 31 - 1)).alias("upto"), "score")
    steps = curves.groupBy("component").agg(F.array_sort(F.collect_list(step)).alias("steps"))  # as many rows as the configuration has curves
    reached = F.try_element_at(F.filter("steps", lambda s: s["upto"] >= F.col("value")), F.lit(1))["score"]
    return values.join(F.broadcast(steps), "component").withColumn(
        "curve_score", F.when(F.col("value").isNull(), null_score).otherwise(F.coalesce(reached, F.lit(0)))).drop("steps")


def in_profiles(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile, location, listing columns): listings inside the price and bedroom bounds of each search profile."""
    bound = lambda name: F.col(name).cast("long")
    pcm = F.expr("price_numeric div 100")
    inside = pcm.between(bound("min_price"), bound("max_price")) & F.col("bedrooms").between(bound("min_bedrooms"), bound("max_bedrooms"))
    return df.join(F.broadcast(profiles), inside)  # a configuration table


def primary_commute(first: Column, second: Column, mode: str = "min") -> Column:
    """``min`` ignores unknown legs; ``first`` takes the first known non-zero leg."""
    return F.least(first, second) if mode == "min" else F.coalesce(F.nullif(first, F.lit(0)), second)


COMPONENTS = ["price", "size", "bedrooms", "epc", "transport", "outside"]


def with_score(df: DataFrame, config: Config | None = None, weights: dict[str, float] | None = None,
               commute_mode: str = "min", with_region: bool = True) -> DataFrame:
    """Add ``score``, ``score_breakdown`` (map) and one ``comp_*`` column per component.

    The weighted sum adds the components in a fixed order, so the same row always gets the same double.
    """
    weights = weights if weights is not None else seed_weights(config)
    w = {k: float(v) for k, v in weights.items()}
    minutes = primary_commute(F.col("commute_primary"), F.col("commute_secondary"), commute_mode)
    parts: dict[str, Column] = {
        "price": price_score(price_pcm(F.col("price_numeric")), config),
        "size": size_score(F.col("size_sqft"), config),
        "bedrooms": bedrooms_score(F.col("bedrooms"), config),
        "epc": rating_score(F.col("epc_rating"), config),
        "transport": transport_score(minutes, F.col("tfl_zone"), config),
        "outside": outside_score(F.col("garden"), F.col("balcony"), config),
    }
    path = carpet_path(w)
    block = _block("carpet", config)
    carpet = (
        F.when(path == "binary", flag_score(F.col("carpet_detected"), block))
        .when(path == "count", carpet_count_score(F.col("bedrooms_with_carpet"), F.col("has_living_area_carpet"), block))
    )
    bedroom = F.when(path == "split", flag_score(F.col("carpet_in_bedroom"), _block("carpet_bedroom", config), 30))
    other = F.when(path == "split", flag_score(F.col("carpet_other_areas"), _block("carpet_other_areas", config), 30))
    out = df.select(
        "*", *[c.cast("int").alias(f"comp_{n}") for n, c in parts.items()], carpet.cast("int").alias("comp_carpet"),
        bedroom.cast("int").alias("comp_carpet_bedroom"), other.cast("int").alias("comp_carpet_other_areas"),
        *([region_score(F.col("region"), config).cast("int").alias("comp_region_pref")] if with_region else []),
    )
    total = F.col("comp_price") * F.lit(w.get("price", 0.0))
    for name in COMPONENTS[1:]:
        total = total + F.col(f"comp_{name}") * F.lit(w.get(name, 0.0))
    total = F.when(F.col("comp_carpet").isNotNull(), total + F.col("comp_carpet") * F.lit(w.get("carpet", 0.0))).otherwise(
        total + F.col("comp_carpet_bedroom") * F.lit(w.get("carpet_bedroom", 0.0))
        + F.col("comp_carpet_other_areas") * F.lit(w.get("carpet_other_areas", 0.0))
    )
    keys = COMPONENTS + ["carpet", "carpet_bedroom", "carpet_other_areas"]
    if with_region:
        total = total + F.col("comp_region_pref") * F.lit(w.get("region_pref", w.get("region_tier", 0.0)))
        keys.append("region_pref")
    breakdown = F.map_filter(
        F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.col(f"comp_{k}") for k in keys])),
        lambda _, v: v.isNotNull(),
    )
    return out.withColumns({"score": half_even(total), "score_breakdown": breakdown})


def latest_weights(log: DataFrame, config: Config | None = None) -> dict[str, float]:
    """Weights of the newest log row; the configured seed when the log is empty. One row reaches the driver."""
    import json

    row = log.agg(F.max_by("weights_json", "id").alias("w")).first()
    return json.loads(row["w"]) if row and row["w"] else seed_weights(config)


def weights_table(log: DataFrame) -> DataFrame:
    """(component, weight) of the newest row."""
    newest = log.agg(F.max_by("weights_json", "id").alias("w"))
    return newest.select(F.explode(F.from_json("w", "map<string,double>")).alias("component", "weight"))


def weights_row(log: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The row that a rescoring with new weights adds to the log: the next id and the weights as JSON."""
    import json

    return log.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).withColumn("weights_json", F.lit(json.dumps(weights)))


def rescore_active(df: DataFrame, weights: dict[str, float], config: Config | None = None) -> DataFrame:
    """Recompute active rows with new weights; the commute leg is the first known one, as at rescoring time."""
    return with_score(df.filter("is_active").drop("score", "score_breakdown"), config, weights, commute_mode="first")


def breakdown_key_histogram(scored: DataFrame, expected: list[str]) -> DataFrame:
    """Rows per breakdown key, whether every row has it, and whether the key is expected."""
    keys = scored.select(F.explode(F.map_keys("score_breakdown")).alias("key")).groupBy("key").agg(F.count("*").alias("n_rows"))
    total = scored.agg(F.count("*").alias("total")).scalar()
    return keys.select(
        "key", "n_rows", (F.col("n_rows") == total).alias("on_every_row"),
        F.col("key").isin(expected).alias("expected"),
    )


def score_band(score: Column, high: int = 80, threshold: int = ALERT_THRESHOLD) -> Column:
    return F.when(score.isNull(), "unscored").when(score >= high, "high").when(score >= threshold, "alert").otherwise("below")


def count_above_threshold(df: DataFrame, threshold: int = ALERT_THRESHOLD) -> DataFrame:
    return df.filter("is_active").agg(
        F.count("*").alias("n_active"), F.count_if(F.col("score") >= threshold).alias("n_above")
    )


def top_n_above_threshold(df: DataFrame, n: int, threshold: int = ALERT_THRESHOLD) -> DataFrame:
    """The push list: active listings at or above the threshold, best first (a bounded top-k)."""
    return df.filter(F.col("is_active") & (F.col("score") >= threshold)).orderBy(F.desc("score"), "uid").limit(n)
