"""Enrichment joins and column rules: certificates, ratings, sizes, travel times, photo roll-ups and tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proplake.config import CARPET_ROOMS, LIVING_ROOMS, MATCH_THRESHOLD, RATING_ORDER, SAP_BUCKETS, SIZE_TRUST, SQM_TO_SQFT, TAG_AXES
from proplake.functions.fuzzy import token_set_ratio
from proplake.functions.skew import left_join_spread
from proplake.functions.text import extract, strip


# --- certificates -----------------------------------------------------------------------------------------
def joined_address(*parts: Column) -> Column:
    """Non-empty stripped parts joined by a comma and a space."""
    return F.concat_ws(", ", *[F.nullif(strip(p), F.lit("")) for p in parts])


def unit_gate(address: Column, line1: Column, line2: Column) -> Column:
    """True when the listing's leading number is a token of the certificate's first two lines, or there is none.

    Tokens are words of the lower-cased, punctuation-free lines; ``22a`` also stands for ``22``.
    """
    lead = leading_number(address)
    return lead.isNull() | F.array_contains(number_tokens(line1, line2), lead)


def leading_number(address: Column) -> Column:
    return extract(address, r"^\s*(\d+)")


def number_tokens(line1: Column, line2: Column) -> Column:
    """The distinct numbers among the words of both lines, those before a letter included."""
    words = F.lower(F.concat_ws(" ", F.coalesce(line1, F.lit("")), F.coalesce(line2, F.lit(""))))
    tokens = F.split(F.regexp_replace(words, r"(?U)[^\w\s]+", " "), r"\s+")
    return F.array_distinct(F.transform(F.filter(tokens, lambda t: t.rlike(r"^\d+[a-z]*$")), lambda t: F.regexp_extract(t, r"^(\d+)", 1)))


def cert_fields(certs: DataFrame) -> DataFrame:
    """Typed certificate columns: lenient numbers and the floor area in both units."""
    area = F.col("floor_area_text").try_cast("double")
    return certs.withColumns({
        "total_floor_area_sqm": area,
        "size_sqft_fallback": F.bround(area * SQM_TO_SQFT, 0).cast("int"),
        "current_energy_efficiency": F.col("efficiency_text").try_cast("int"),
        "potential_energy_efficiency": F.col("potential_text").try_cast("int"),
    })


def cert_candidates(listings: DataFrame, certs: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """(listing address, certificate) pairs of one postcode whose similarity reaches the threshold and pass the unit gate.

    Listings collapse to distinct (postcode, address); certificates to the latest of each (postcode, address lines), since
    all of one address score alike. The gate is an equality, so an address with a leading number meets only certificates
    that name this number; only addresses without one meet all of their postcode. Empty addresses score 0 and stay out.
    """
    pc = F.upper(strip(F.col("postcode")))
    asks = listings.select(pc.alias("pc"), "address").filter("pc IS NOT NULL AND pc != '' AND address IS NOT NULL AND address != ''").distinct()
    asks = asks.withColumn("lead", leading_number(F.col("address")))
    order = F.struct(F.coalesce("lodgement_date", F.lit("")).alias("lodged"), F.col("cert_id").alias("id"))
    cards = certs.filter(pc.isNotNull()).groupBy(pc.alias("pc"), "address1", "address2", "address3").agg(F.max_by(F.struct(*certs.columns), order).alias("cert"))
    numbered = cards.withColumn("lead", F.explode(number_tokens(F.col("address1"), F.col("address2"))))
    columns = ["pc", "address", "cert"]
    pairs = asks.filter("lead IS NOT NULL").join(numbered, ["pc", "lead"]).select(*columns).unionByName(
        asks.filter("lead IS NULL").join(cards, "pc").select(*columns))
    line = joined_address(F.col("cert.address1"), F.col("cert.address2"), F.col("cert.address3"))
    return pairs.withColumn("match_score", token_set_ratio("address", line)).filter(F.col("match_score") >= threshold)


def cert_fuzzy_match(listings: DataFrame, certs: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Listings with their best certificate (highest score, then latest lodgement, then id), NULL where none qualifies."""
    order = F.struct("match_score", F.coalesce("cert.lodgement_date", F.lit("")).alias("lodged"), F.col("cert.cert_id").alias("id"))
    best = cert_candidates(listings, certs, threshold).groupBy("pc", "address").agg(
        F.max_by(F.struct("match_score", "cert"), order).alias("match"))
    keyed = listings.withColumns({"_pc": F.upper(strip(F.col("postcode"))), "_address": F.coalesce("address", F.lit(""))})
    hits = best.select(F.col("pc").alias("_pc"), F.col("address").alias("_address"), "match")
    return keyed.join(hits, ["_pc", "_address"], "left").drop("_pc", "_address")


def cert_latest_by_postcode(listings: DataFrame, certs: DataFrame) -> DataFrame:
    """Rating of the newest certificate of the postcode, with no look at the address."""
    newest = certs.groupBy(F.upper(strip(F.col("postcode"))).alias("_pc")).agg(
        F.max_by("rating", F.struct("lodgement_date", "cert_id")).alias("latest_rating"))
    return left_join_spread(listings.withColumn("_pc", F.upper(strip(F.col("postcode")))), newest, ["_pc"]).drop("_pc")


def rating_priority(scraper: Column, text: Column, cert: Column, read: Column, read_confidence: Column) -> dict[str, Column]:
    """Rating with its provenance: scraper, then text, then certificate; an image read only fills what is still empty."""
    own = F.coalesce(F.nullif(scraper, F.lit("")), F.nullif(text, F.lit("")))
    official = F.when(own.isNull(), F.nullif(cert, F.lit("")))
    rescue = F.when(own.isNull() & official.isNull() & (read_confidence == "sap_derived"), F.nullif(read, F.lit("")))
    return {
        "epc_rating": F.coalesce(own, official, rescue),
        "epc_rating_source": F.when(official.isNotNull(), "epc_api").when(rescue.isNotNull(), "vision_ocr"),
        "epc_rating_confidence": F.when(official.isNotNull(), "epc_api_match").when(rescue.isNotNull(), "sap_derived"),
    }


def sap_to_letter(sap: Column) -> Column:
    expr = F
    for letter, (low, high) in SAP_BUCKETS.items():
        expr = expr.when(sap.between(low, high), letter)
    return expr.otherwise(F.lit(None).cast("string"))


def sap_reconcile(rating: Column, sap: Column, potential: Column) -> dict[str, Column]:
    """Letter derived from the number when the two numbers agree with each other, with the reason either way."""
    derived = sap_to_letter(sap)
    reason = (
        F.when(sap.isNull(), "missing_current_sap").when(~sap.between(1, 100), "current_sap_out_of_range")
        .when(potential < sap, "potential_sap_below_current").when(derived.isNull(), "sap_not_in_any_bucket")
        .when(derived.eqNullSafe(rating), "ok")
        .otherwise(F.concat(F.lit("sap_derived_letter_overrides_model_letter("), F.coalesce(rating, F.lit("None")), F.lit(")")))
    )
    good = F.coalesce(sap.between(1, 100), F.lit(False)) & ~F.coalesce(potential < sap, F.lit(False))
    return {
        "reconciled_rating": F.when(good, derived), "reconciled_sap": F.when(good, sap),
        "confidence": F.when(good, "sap_derived").otherwise("miss"), "reason": reason,
    }


def sap_consistent(rating: Column, sap: Column, potential_rating: Column, potential_sap: Column) -> Column:
    """True when the letter fits the number and the potential is no worse on either scale."""
    fits = sap_to_letter(sap) == rating
    worse_letter = potential_rating.isin(RATING_ORDER) & (potential_rating > rating)
    return F.coalesce(fits & ~F.coalesce(worse_letter, F.lit(False)) & ~F.coalesce(potential_sap < sap, F.lit(False)), F.lit(False))


# --- sizes ------------------------------------------------------------------------------------------------
def size_merge(df: DataFrame, minimum: int = 100, per_bedroom: int = 800) -> DataFrame:
    """First plausible size in trust order with its source and confidence, and a flag for floorplan against certificate."""
    beds = F.col("bedrooms")

    def plausible(size: Column) -> Column:
        crowded = F.coalesce((beds > 0) & (size / beds > per_bedroom), F.lit(False))
        return F.coalesce(size >= minimum, F.lit(False)) & ~crowded

    choice = F.coalesce(*[
        F.when(plausible(F.col(s)), F.struct(F.col(s).alias("size"), F.lit(s).alias("source"), F.lit(conf).alias("confidence")))
        for s, conf in SIZE_TRUST])
    plan, cert = F.col("floorplan_vision"), F.coalesce("epc_interpolated", "epc_direct")
    differ = (plan >= minimum) & (cert >= minimum) & (F.abs(plan - cert) / F.greatest(plan, cert) > 0.30)
    return df.withColumn("_choice", choice).withColumns({
        "size_sqft": F.col("_choice.size"), "size_sqft_source": F.col("_choice.source"),
        "size_sqft_confidence": F.col("_choice.confidence"), "epc_floorplan_disagreement": F.coalesce(differ, F.lit(False)),
    }).drop("_choice")


def floorplan_total(plan: Column) -> Column:
    """Stated total under any of its four names, else the sum of the room sizes; only positive values count."""
    stated = [F.when(plan[k] > 0, plan[k]) for k in ("total_size_sqft", "total_area_sqft", "total_sqft", "size_sqft")]
    rooms = F.aggregate(F.coalesce(plan["rooms"], F.array().cast("array<struct<name:string,size_sqft:double>>")), F.lit(0.0),
                        lambda acc, r: acc + F.coalesce(r["size_sqft"], F.lit(0.0)))
    return F.coalesce(*stated, F.when(rooms > 0, rooms))


def size_credibility(size: Column, total: Column, tolerance: float = 0.10) -> Column:
    gap = F.abs(size - total) / F.greatest(size.cast("double"), total)
    usable = F.coalesce((size > 0) & (total > 0), F.lit(False))
    return F.when(~usable, "missing").when(gap <= tolerance, "trusted").otherwise("conflict")


# --- fixed values: words that tell a room's kind --------------------------------------------------------
ROOM_RULES = [
    ("bedroom", ["bedroom", "master"]), ("bathroom", ["bathroom", "shower", "wc", "toilet"]),
    ("reception", ["reception", "living", "lounge", "dining"]), ("kitchen", ["kitchen"]),
]
# --- end of fixed values --------------------------------------------------------------------------------


def room_category(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    expr = F
    for category, words in ROOM_RULES:
        expr = expr.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), category)
    return expr.otherwise("other")


def room_counts(rooms: Column) -> dict[str, Column]:
    """Rooms per category of one listing, counted inside the row."""
    kinds = F.transform(rooms, lambda r: room_category(r["name"]))

    def count(category: str) -> Column:
        return F.coalesce(F.size(F.filter(kinds, lambda k: k == category)), F.lit(0))

    return {category: count(category) for category in [name for name, _ in ROOM_RULES] + ["other"]}


# --- places and travel ------------------------------------------------------------------------------------
def postcode_to_coords(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """Coordinates of a postcode, historical ones when it is no longer in use."""
    place = lookup.select("postcode_key", F.coalesce("lat", "hist_lat").alias("pc_lat"), F.coalesce("lng", "hist_lng").alias("pc_lng"),
                          (F.col("lat").isNull() & F.col("hist_lat").isNotNull()).alias("terminated"))
    key = F.upper(F.regexp_replace(F.col("postcode"), r"\s+", ""))
    return left_join_spread(df.withColumn("postcode_key", key), place, ["postcode_key"]).drop("postcode_key")


def commute_minutes(times: DataFrame, destinations: list[str]) -> DataFrame:
    """Fastest public journey to each destination, and by cycle to the first, one row per origin."""
    public = F.col("mode") == "public"
    return times.groupBy("origin").agg(
        *[F.min(F.when(public & (F.col("destination") == d), F.col("minutes"))).alias(d) for d in destinations],
        F.min(F.when((F.col("mode") == "cycle") & (F.col("destination") == destinations[0]), F.col("minutes"))).alias("cycle_minutes"))


def commute_pass(columns: list[str], cap: int = 40, strict: bool = True) -> Column:
    """Strict: every leg known and within the cap. Otherwise unknown legs are ignored, and none known gives NULL."""
    legs = [F.col(c) for c in columns]
    if strict:
        return F.coalesce(reduce(lambda a, b: a & b, [leg <= cap for leg in legs]), F.lit(False))
    return F.greatest(*legs) <= cap


# --- photo roll-ups ---------------------------------------------------------------------------------------
def photo_rollup_any(photos: DataFrame) -> DataFrame:
    """Any carpet over the judged photos, their number and mean confidence (in thousandths)."""
    judged = F.col("carpet").isNotNull()
    return photos.groupBy("uid").agg(
        F.count("*").alias("n_photos"), F.count_if(judged).alias("n_judged"), F.bool_or("carpet").alias("carpet_detected"),
        F.sum(F.when(judged, F.coalesce("confidence_milli", F.lit(0)))).alias("confidence_sum"))


def photo_rollup_two_signal(photos: DataFrame) -> DataFrame:
    """Carpet in bedrooms, elsewhere, and anywhere; NULL where no photo was judged."""
    bedroom = F.coalesce(F.col("room_type"), F.lit("other")) == "bedroom"
    judged = photos.filter("carpet IS NOT NULL")
    return judged.groupBy("uid").agg(
        F.coalesce(F.bool_or(F.when(bedroom, F.col("carpet"))), F.lit(False)).alias("carpet_in_bedroom"),
        F.coalesce(F.bool_or(F.when(~bedroom, F.col("carpet"))), F.lit(False)).alias("carpet_other_areas"),
        F.bool_or("carpet").alias("carpet_detected"), F.sum("confidence_milli").alias("confidence_sum"), F.count("*").alias("n_judged"))


def photo_rollup_two_step(photos: DataFrame) -> DataFrame:
    """Bedroom counts, and living areas by majority: at least two carpeted photos and more than half of them."""
    carpet = F.coalesce(F.col("carpet"), F.lit(False)) & F.col("room_type").isin(CARPET_ROOMS)
    living = F.col("room_type").isin(LIVING_ROOMS)
    counts = photos.groupBy("uid").agg(
        F.count_if(F.col("room_type") == "bedroom").alias("bedrooms_seen"),
        F.count_if((F.col("room_type") == "bedroom") & carpet).alias("bedrooms_with_carpet"),
        F.count_if(living).alias("_living"), F.count_if(living & carpet).alias("_carpeted"))
    majority = (F.col("_carpeted") >= 2) & (F.col("_carpeted") * 2 > F.col("_living"))
    return counts.select("uid", "bedrooms_seen", "bedrooms_with_carpet", majority.alias("has_living_area_carpet"),
                         (F.col("bedrooms_with_carpet") > 0).alias("carpet_in_bedroom"),
                         ((F.col("bedrooms_with_carpet") > 0) | majority).alias("carpet_detected"))


def tag_coerce(df: DataFrame) -> DataFrame:
    """Each tag outside its axis becomes ``unclear``, or ``not_shown`` on axes that have no ``unclear``."""
    def coerced(axis: str) -> Column:
        allowed = TAG_AXES[axis]
        fallback = "unclear" if "unclear" in allowed else "not_shown"
        return F.when(F.col(f"tag_{axis}").isin(allowed), F.col(f"tag_{axis}")).otherwise(fallback)

    return df.withColumns({f"tag_{axis}": coerced(axis) for axis in TAG_AXES})
