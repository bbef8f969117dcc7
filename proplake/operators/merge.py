"""Merging a crawl into the listing snapshot, and the logs that fall out of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proplake.config import REJECT_STATES
from proplake.functions.sequence import with_previous

# --- fixed values: columns a merge writes ---------------------------------------------------------------
UPSERT_COLUMNS = [
    "price", "price_numeric", "score", "score_breakdown", "size_sqft", "carpet_detected", "carpet_confidence",
    "carpet_in_bedroom", "carpet_other_areas", "epc_rating", "tube_distance", "cycle_minutes",
    "commute_primary", "commute_secondary", "commute_pass_40min", "tfl_zone", "nearest_station", "garden",
    "balcony", "furnished", "bills_included", "council_tax_band", "let_available_date", "latitude", "longitude",
    "region", "images", "property_metadata", "total_floor_area_sqm", "current_energy_efficiency",
    "potential_energy_efficiency", "number_habitable_rooms", "number_heated_rooms", "built_form",
    "property_type_epc", "construction_age_band", "tenure_epc", "windows_description", "windows_energy_eff",
    "walls_description", "walls_energy_eff", "roof_description", "floor_level", "mains_gas_flag",
    "heating_cost_current", "epc_lodgement_date", "epc_inspection_date", "size_sqft_source",
    "size_sqft_confidence", "floorplan_data", "epc_graph_url", "epc_rating_source", "epc_rating_confidence",
]
SCRAPED_COLUMNS = [
    "title", "address", "area", "price", "price_numeric", "bedrooms", "bathrooms", "furnished",
    "let_available_date", "epc_rating", "images",
]
FLAG_COLUMNS = ["garden", "bills_included"]
# --- end of fixed values --------------------------------------------------------------------------------


def _now(as_of: str) -> Column:
    return F.to_timestamp(F.lit(as_of))


def latest_per_key(df: DataFrame, order: list[str], key: str = "uid") -> DataFrame:
    """The last row of each key by ``order``; an aggregate, so duplicates combine before the shuffle."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("row"))
    return best.select("row.*")


def touch_update(snapshot: DataFrame, touched: DataFrame, as_of: str) -> DataFrame:
    """Seen again: renew the sighting, count it, and reactivate unless the listing was rejected."""
    hit = F.col("_touched").isNotNull()
    revive = hit & ~F.coalesce("current_status", F.lit("new")).isin(REJECT_STATES)
    marked = snapshot.join(touched.select("uid").distinct().withColumn("_touched", F.lit(True)), "uid", "left")
    return marked.withColumns({
        "last_scraped": F.when(hit, _now(as_of)).otherwise(F.col("last_scraped")),
        "scrape_count": F.when(hit, F.coalesce("scrape_count", F.lit(0)) + 1).otherwise(F.col("scrape_count")),
        "is_active": F.when(revive, True).otherwise(F.col("is_active")),
        "status": F.when(revive, "active").otherwise(F.col("status")),
    }).drop("_touched")


def _upsert(snapshot: DataFrame, incoming: DataFrame, as_of: str, chosen) -> DataFrame:
    """Full outer merge on uid; ``chosen(column)`` gives the merged value of a column both sides have."""
    old = snapshot.withColumn("_old", F.lit(True)).alias("o")
    new = incoming.withColumn("_new", F.lit(True)).alias("n")
    joined = old.join(new, F.col("o.uid") == F.col("n.uid"), "full_outer")
    is_old, is_new = F.col("o._old").isNotNull(), F.col("n._new").isNotNull()
    special = {
        "uid": F.coalesce("o.uid", "n.uid"),
        "last_scraped": F.when(is_new, _now(as_of)).otherwise(F.col("o.last_scraped")),
        "first_seen": F.when(is_old, F.col("o.first_seen")).otherwise(_now(as_of)),
        "scrape_count": F.when(is_new, F.coalesce("o.scrape_count", F.lit(0)) + 1).otherwise(F.col("o.scrape_count")),
        "is_active": F.when(is_new, True).otherwise(F.col("o.is_active")),
        "status": F.when(is_new, "active").otherwise(F.col("o.status")),
    }
    out = []
    for field in snapshot.schema:
        c = field.name
        if c in special:
            value = special[c]
        elif c in incoming.columns:
            value = F.when(is_new & is_old, chosen(c)).when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        else:
            value = F.col(f"o.{c}")
        out.append(value.cast(field.dataType).alias(c))
    return joined.select(*out)


def upsert_overwrite(snapshot: DataFrame, incoming: DataFrame, as_of: str, columns: list[str] | None = None) -> DataFrame:
    """Known listings take the listed columns from the crawl, NULLs included, and keep all others; new ones are added."""
    listed = set(columns or UPSERT_COLUMNS)
    return _upsert(snapshot, incoming, as_of, lambda c: F.col(f"n.{c}") if c in listed else F.col(f"o.{c}"))


def upsert_coalesce(snapshot: DataFrame, incoming: DataFrame, as_of: str) -> DataFrame:
    """Scraped columns change only to non-empty, non-zero values; flags only to known ones; enrichment always."""
    kinds = {f.name: f.dataType.typeName() for f in incoming.schema}

    def chosen(c: str) -> Column:
        new = F.col(f"n.{c}")
        if c in FLAG_COLUMNS:
            return F.coalesce(new, F.col(f"o.{c}"))
        if c in SCRAPED_COLUMNS:
            empty = F.lit("") if kinds[c] == "string" else F.lit(0)
            return F.coalesce(F.nullif(new, empty), F.col(f"o.{c}"))
        return new

    return _upsert(snapshot, incoming, as_of, chosen)


def apply_label_truth(snapshot: DataFrame, truth: DataFrame) -> DataFrame:
    """Hand labels replace four photo columns wherever a bedroom was seen; the rest is untouched."""
    usable = truth.filter("bedrooms_seen > 0").select(
        "uid", F.col("bedrooms_with_carpet").alias("_beds"), F.coalesce("has_living_area_carpet", F.lit(False)).alias("_living"))
    hit = F.col("_living").isNotNull()
    return snapshot.join(usable, "uid", "left").withColumns({
        "bedrooms_with_carpet": F.when(hit, F.col("_beds")).otherwise(F.col("bedrooms_with_carpet")),
        "has_living_area_carpet": F.when(hit, F.col("_living")).otherwise(F.col("has_living_area_carpet")),
        "carpet_in_bedroom": F.when(hit, F.col("_beds") > 0).otherwise(F.col("carpet_in_bedroom")),
        "carpet_other_areas": F.when(hit, F.col("_living")).otherwise(F.col("carpet_other_areas")),
    }).drop("_beds", "_living")


def label_truth_counts(snapshot: DataFrame, truth: DataFrame) -> DataFrame:
    """How many labelled listings were updated, skipped for want of bedroom photos, or unknown."""
    known = truth.join(snapshot.select("uid", F.lit(True).alias("_known")), "uid", "left")
    seen = F.coalesce(F.col("bedrooms_seen") > 0, F.lit(False))
    return known.agg(
        F.count_if(seen & F.col("_known").isNotNull()).alias("updated"), F.count_if(~seen).alias("skipped"),
        F.count_if(seen & F.col("_known").isNull()).alias("unknown"))


def price_change_log(sightings: DataFrame, price: str = "price_numeric", bucket_seconds: float = 86_400.0) -> DataFrame:
    """Sightings whose price differs from the previous sighting's, both known and non-zero, with change and percent."""
    old, new = F.col(f"previous.{price}"), F.col(price)
    changed = (old != 0) & (new != 0) & (old != new)
    return with_previous(sightings, [price], bucket_seconds=bucket_seconds).filter(changed).select(
        "uid", "ts", "event_id", new.alias("price_numeric"), (new - old).alias("price_change"),
        ((new - old) / old * 100).alias("price_change_percent"))


def deactivate_stale(snapshot: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    old = F.coalesce(F.col("last_scraped") < _now(as_of) - F.make_dt_interval(days=F.lit(days)), F.lit(False))
    return snapshot.withColumns({
        "is_active": F.when(old, False).otherwise(F.col("is_active")), "status": F.when(old, "inactive").otherwise(F.col("status"))})


def properties_since(snapshot: DataFrame, since: str) -> DataFrame:
    return snapshot.filter(F.col("last_scraped") >= F.to_timestamp(F.lit(since))).orderBy(F.desc("last_scraped"), "uid")


def run_summary(outcomes: DataFrame) -> DataFrame:
    """(measure, n): listings discovered, per outcome, and per stage and rule dropped, in one pass."""
    rule = F.when(F.col("drop_rule").isNotNull(), F.concat_ws(":", F.lit("drop"), "outcome", "drop_rule"))
    measures = F.array_compact(F.array(F.lit("discovered"), F.col("outcome"), rule))
    return outcomes.select(F.explode(measures).alias("measure")).groupBy("measure").agg(F.count("*").alias("n"))
