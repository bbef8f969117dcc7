"""Fixed values and default settings. Every operator takes them as parameters, so a caller can pass its own."""

from __future__ import annotations

import copy
from typing import Any

# --- fixed values: domains -------------------------------------------------------------------------------
RATING_ORDER = ["A", "B", "C", "D", "E", "F", "G"]
SAP_BUCKETS = {"A": (92, 100), "B": (81, 91), "C": (69, 80), "D": (55, 68), "E": (39, 54), "F": (21, 38), "G": (1, 20)}
PROPERTY_TYPE_RULES = [
    ("flat", "flat"), ("apartment", "apartment"), ("house", "house"), ("studio", "studio"),
    ("maisonette", "maisonette"), ("bungalow", "bungalow"), ("semi-detached", "house"), ("detached", "house"),
    ("terraced", "house"), ("end terrace", "house"),
]
TAG_AXES = {
    "window_style": ["floor_to_ceiling", "sash", "casement", "picture", "skylight", "mixed", "unclear"],
    "ceiling_height": ["standard", "tall", "vaulted", "low", "unclear"],
    "exposed_brick": ["yes", "no", "unclear"],
    "exposed_beams_or_ducts": ["yes", "no", "unclear"],
    "building_era": ["period", "warehouse_conversion", "mid_century", "new_build", "ex_local", "unclear"],
    "kitchen_finish": ["basic", "mid", "premium", "not_shown"],
    "bathroom_finish": ["basic", "mid", "premium", "not_shown"],
    "flooring": ["wood", "laminate", "tile", "carpet", "mixed", "unclear"],
    "natural_light": ["low", "medium", "high", "unclear"],
    "wall_palette": ["white", "neutral", "dark", "colour_heavy", "unclear"],
    "open_plan": ["yes", "no", "unclear"],
    "view": ["street", "garden", "skyline", "courtyard", "blocked", "unclear"],
    "outdoor_access": ["garden", "balcony", "roof_terrace", "shared_garden", "none", "unclear"],
}
TAG_IGNORED = {"unclear", "not_shown"}
NEWNESS_HOURS = {"3h": 3, "6h": 6, "12h": 12, "24h": 24, "3d": 72, "1w": 168, "1m": 720}
STATES = ["new", "contact_queued", "contacted", "shortlisted", "triage_reject", "not_contacted", "final_reject"]
REJECT_STATES = ["triage_reject", "final_reject", "not_contacted"]
LEGAL_TRANSITIONS = {
    "new": ["triage_reject", "contact_queued", "contacted"],
    "contact_queued": ["contacted", "not_contacted", "triage_reject"],
    "contacted": ["shortlisted", "final_reject", "not_contacted"],
    "shortlisted": ["final_reject"],
    "triage_reject": ["contact_queued"],
    "not_contacted": ["contact_queued"],
    "final_reject": [],
}
CARPET_ROOMS = ["bedroom", "living-room", "hallway", "dining-room"]
LIVING_ROOMS = ["living-room", "hallway", "dining-room"]
SIZE_TRUST = [  # trust order, best first, with the confidence attached to each source
    ("structured", 0.95), ("nlp", 0.85), ("floorplan_vision", 0.80), ("epc_interpolated", 0.50), ("epc_direct", 0.70),
]
TIER_RANK = {"best": 4, "good": 3, "bad": 2, "worse": 1}
TIER_ORDER = ["best", "good", "bad", "worse"]
STOP_WORDS = (
    "the a an and or but is are in on of to for with without as at by this that it be has have had not no yes i its "
    "it's very too much lot lots some any more less most least than then so if do does did being been from into out "
    "off up down all each every few many good bad ok okay alright"
).split()
PRICE_BAND = 0.02
DUPLICATE_RADIUS_M = 50.0
EARTH_RADIUS_M = 6_371_000.0
EARTH_RADIUS_MILES = 3958.8
MATCH_THRESHOLD = 55
SQM_TO_SQFT = 10.7639
SQM_TO_SQFT_DISPLAY = 10.764
PREFERRED_PORTAL = "portal_a"
OUTCODE_ONLY_PORTALS = ("portal_c",)
ALERT_THRESHOLD = 60

DEFAULTS: dict[str, Any] = {
    "hard_filters": {
        "price": {"min": 1600, "max": 2800},
        "bedrooms": {"min": 1, "max": 2},
        "epc_min_rating": "D",
        "epc_drop_null": False,
        "tfl_zone_max": 3,
        "size_sqft_min": 400,
        "drop_let_agreed": True,
        "region_drop_unlisted": False,
    },
    "scoring": {
        "components": {
            "price": {"weight": 0.25, "full_marks_at_or_below": 2800, "zero_marks_at_or_above": 3200},
            "carpet": {"weight": 0.25, "detected_score": 20, "not_detected_score": 100, "null_score": 50},
            "carpet_bedroom": {"weight": 0.0, "detected_score": 30, "not_detected_score": 100, "null_score": 50},
            "carpet_other_areas": {"weight": 0.0, "detected_score": 0, "not_detected_score": 100, "null_score": 50},
            "size": {"weight": 0.20, "full_marks_at_or_above_sqft": 650, "zero_marks_at_or_below_sqft": 400,
                     "null_score": 50},
            "bedrooms": {"weight": 0.10, "scores": {3: 100, 2: 100, 1: 50, 0: 0}, "null_score": 0},
            "epc": {"weight": 0.05, "scores": {"A": 100, "B": 100, "C": 100, "D": 40, "E": 0, "F": 0, "G": 0},
                    "null_score": 0},
            "transport": {
                "weight": 0.10,
                "journey_minutes": [
                    {"at_or_below": 15, "score": 100}, {"at_or_below": 25, "score": 80},
                    {"at_or_below": 35, "score": 60}, {"at_or_below": 45, "score": 30}, {"above": 45, "score": 0},
                ],
                "zone_scores": {1: 100, 2: 100, 3: 50, 4: 0},
                "journey_zone_blend": 0.75,
                "null_score": 50,
            },
            "outside": {"weight": 0.0, "scores": {"garden": 100, "balcony": 60, "none": 0}},
            "floor_level_high": {
                "weight": 0.0, "null_score": 50,
                "tiers": [{"at_or_below": 3, "score": 100}, {"at_or_below": 6, "score": 90},
                          {"at_or_below": 10, "score": 70}, {"above": 10, "score": 30}],
            },
            "photo_count": {
                "weight": 0.0, "null_score": 50,
                "tiers": [{"at_or_below": 2, "score": 30}, {"at_or_below": 4, "score": 70}, {"above": 4, "score": 100}],
            },
            "size_sqft_credibility": {"weight": 0.0, "scores": {"trusted": 100, "missing": 50, "conflict": 30},
                                      "null_score": 50},
            "region_tier": {"weight": 0.05, "tier_1": 100, "tier_2": 75, "tier_3": 50, "unlisted": 75},
        }
    },
    "regions_by_tier": {
        "tier_1": [
            "Shoreditch, East London", "Hoxton, North London", "Haggerston, East London", "Dalston, East London",
            "London Fields, East London", "De Beauvoir Town, North London", "Stoke Newington, North London",
            "Homerton, East London", "Clapton, East London", "Hackney Wick, East London", "Finsbury Park, North London",
            "Islington, North London", "Highbury, North London", "Canonbury, North London", "Barnsbury, North London",
            "Kings Cross, North London",
        ],
        "tier_2": [
            "Holloway, North London", "Lower Holloway, North London", "Upper Holloway, North London",
            "Tufnell Park, North London", "Archway, London", "Fitzrovia, London", "Bloomsbury, Central London",
            "Holborn, Central London",
        ],
        "tier_3": [
            "Camden Town, North West London", "Kentish Town, North West London", "Primrose Hill, North West London",
            "Belsize Park, North West London", "Chalk Farm, North West London", "Hampstead, North West London",
            "Walthamstow", "Tottenham Hale", "Seven Sisters", "Blackhorse Road",
        ],
    },
}
DEFAULTS["hard_filters"]["regions"] = [r for tier in DEFAULTS["regions_by_tier"].values() for r in tier]
# --- end of fixed values ---------------------------------------------------------------------------------


def merged(*layers: dict[str, Any]) -> dict[str, Any]:
    """Later layers win key by key; nested dicts merge, everything else is replaced."""
    out: dict[str, Any] = {}
    for layer in layers:
        for key, value in (layer or {}).items():
            if isinstance(value, dict) and isinstance(out.get(key), dict):
                out[key] = merged(out[key], value)
            else:
                out[key] = copy.deepcopy(value)
    return out


def seed_weights(config: dict[str, Any] | None = None) -> dict[str, float]:
    components = (config or DEFAULTS)["scoring"]["components"]
    return {name: float(block.get("weight", 0.0)) for name, block in components.items()}


def is_location_id(value: Any) -> bool:
    """An area or a station id: a kind prefix, a caret and something after it."""
    return isinstance(value, str) and len(value) > 7 and value.split("^")[0] in {"REGION", "STATION"} and "^" in value


def search_profiles(search: dict[str, Any], config: dict[str, Any] | None = None) -> list[dict[str, Any]]:
    """One row per (profile, location). Precedence: filter bounds, then search defaults, then profile overrides."""
    bounds = (config or DEFAULTS)["hard_filters"]
    inherited = {
        f"{side}_{name}": bounds[block][side]
        for block, name in (("price", "price"), ("bedrooms", "bedrooms"))
        for side in ("min", "max")
        if side in bounds.get(block, {})
    }
    fallback = {"min_price": 0, "max_price": 999999, "min_bedrooms": 1, "max_bedrooms": 2, "radius": 1.0,
                "max_results": 40}
    rows = []
    for profile in search.get("profiles", []):
        settings = merged(fallback, inherited, search.get("defaults", {}), profile.get("overrides", {}))
        for location in profile.get("locations", []):
            if not is_location_id(location.get("region_id")):
                raise ValueError(f"location {location.get('name')!r} has no valid id: {location.get('region_id')!r}")
            rows.append({"profile": profile.get("name", ""), "location": location.get("name", ""),
                         "region_id": location["region_id"], **settings})
    return rows
