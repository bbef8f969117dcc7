"""Schema-tolerant scans and small configuration tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proplake.config import DEFAULTS, TAG_AXES

LISTING_CONTRACT: dict[str, str] = {
    "uid": "string", "portal": "string", "url": "string", "title": "string", "address": "string", "postcode": "string",
    "area": "string", "price": "string", "price_numeric": "long", "bedrooms": "int", "size_sqft": "int",
    "epc_rating": "string", "garden": "boolean", "balcony": "boolean", "images": "string", "first_seen": "timestamp",
    "last_scraped": "timestamp", "is_active": "boolean", "score": "int", "score_breakdown": "string", "region": "string",
    "tube_distance": "int", "nearest_station": "string", "tfl_zone": "int", "commute_primary": "int",
    "commute_secondary": "int", "commute_pass_40min": "boolean", "carpet_in_bedroom": "boolean",
    "carpet_other_areas": "boolean", "bedrooms_with_carpet": "int", "has_living_area_carpet": "boolean",
    "current_status": "string", "current_status_reason": "string", "cluster_id": "string",
    "total_floor_area_sqm": "double", "current_energy_efficiency": "int", "potential_energy_efficiency": "int",
    "number_habitable_rooms": "int", "number_heated_rooms": "int", "built_form": "string", "property_type_epc": "string",
    "construction_age_band": "string", "tenure_epc": "string", "windows_description": "string",
    "windows_energy_eff": "string", "walls_description": "string", "walls_energy_eff": "string",
    "roof_description": "string", "floor_level": "string", "mains_gas_flag": "string", "heating_cost_current": "int",
    "epc_lodgement_date": "string", "epc_inspection_date": "string", "size_sqft_source": "string",
    "size_sqft_confidence": "double", "floorplan_data": "string", "epc_graph_url": "string",
    "epc_rating_source": "string", "epc_rating_confidence": "string", "furnished": "string",
    "council_tax_band": "string", "let_available_date": "string", "let_available_iso": "string",
    **{f"tag_{axis}": "string" for axis in TAG_AXES}, "tags_extracted_at": "timestamp", "tag_raw_captions": "string",
}


def scan_tolerant(df: DataFrame, contract: dict[str, str] | None = None) -> DataFrame:
    """Exactly the contract's columns: typed where the snapshot has them, NULL where it predates them."""
    contract = contract or LISTING_CONTRACT
    return df.select([
        (F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)).alias(c) for c, kind in contract.items()
    ])


def read_listings(spark: SparkSession, path: str, contract: dict[str, str] | None = None) -> DataFrame:
    """Parquet snapshot written by any version of the job; files may differ in columns."""
    return scan_tolerant(spark.read.option("mergeSchema", "true").parquet(path), contract)


MATCH_CSV = "listing_address string, epc_address string, score double, label int"
PAIR_CSV = "uid_a string, uid_b string, label string"


def read_labelled_csv(spark: SparkSession, path: str, schema: str = MATCH_CSV) -> DataFrame:
    """CSV with a header and a declared schema; a row that does not fit is an error."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def region_tiers_table(spark: SparkSession, config: dict[str, Any] | None = None) -> DataFrame:
    """(region, tier, tier_score) from the configured tiers. A region listed twice keeps its best tier."""
    config = config or DEFAULTS
    block = config["scoring"]["components"]["region_tier"]
    best = {r: tier for tier in ("tier_3", "tier_2", "tier_1") for r in config["regions_by_tier"].get(tier, [])}
    return spark.createDataFrame([(r, t, int(block[t])) for r, t in best.items()], "region string, tier string, tier_score int")


def tier_curves_table(spark: SparkSession, config: dict[str, Any] | None = None) -> DataFrame:
    """(component, at_or_below, score) of every step curve; the open last step has a NULL bound."""
    rows = []
    for name, block in (config or DEFAULTS)["scoring"]["components"].items():
        for tier in block.get("tiers") or block.get("journey_minutes") or []:
            rows.append((name, tier.get("at_or_below"), tier["score"]))
    return spark.createDataFrame(rows, "component string, at_or_below int, score int")


def profiles_table(spark: SparkSession, search: dict[str, Any], config: dict[str, Any] | None = None) -> DataFrame:
    from proplake.config import search_profiles

    rows = [{k: str(v) for k, v in r.items()} for r in search_profiles(search, config)]
    return spark.createDataFrame(rows) if rows else spark.createDataFrame([], "profile string, location string")
