"""The query surface: filters, sorts, pages, facets, counts and row decoration over a listing snapshot."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proplake.config import NEWNESS_HOURS, REJECT_STATES, SQM_TO_SQFT, TAG_AXES, TAG_IGNORED
from proplake.operators.score import half_even

SORTS = {
    "score_desc": [("score", False)], "price_asc": [("price_numeric", True)], "sqft_desc": [("size_sqft", False)],
    "first_seen_desc": [("first_seen", False)], "transition_desc": [("last_transition_at", False)],
    "transition_asc": [("last_transition_at", True)],
}
SORT_ALIASES = {"score": "score_desc", "price": "price_asc", "sqft": "sqft_desc", "first_seen": "first_seen_desc",
                "newest": "first_seen_desc"}
TAB_SORTS = {"main": "score_desc", "queued": "transition_asc", "contacted": "transition_asc",
             "shortlisted": "transition_asc", "rejected": "transition_desc"}


def tab_clause(tab: str | None) -> Column:
    status, active = F.col("current_status"), F.col("is_active")
    clauses = {
        "main": active & (status.isNull() | (status == "new")),
        "queued": active & (status == "contact_queued"),
        "contacted": active & (status == "contacted"),
        "shortlisted": active & (status == "shortlisted"),
        "rejected": status.isin(REJECT_STATES),
    }
    return clauses.get((tab or "main").lower(), clauses["main"])


def _as_int(value: Any) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def newness(first_seen: Column, bucket: str, as_of: str) -> Column:
    return first_seen >= F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(hours=F.lit(NEWNESS_HOURS[bucket]))


def view_clause(filters: dict[str, Any], as_of: str, present: set[str] | None = None) -> Column:
    """Conjunction of the requested filters. Empty values, unparsable numbers and absent columns are ignored."""
    def has(column: str) -> bool:
        return present is None or column in present

    def number(name: str, column: str) -> int | None:
        return _as_int(filters[name]) if filters.get(name) and has(column) else None

    tests = [tab_clause(filters.get("tab"))]
    if filters.get("source") and has("portal"):
        tests.append(F.upper("portal") == str(filters["source"]).upper())
    if filters.get("region") and has("region"):
        tests.append(F.lower("region") == str(filters["region"]).lower())
    if (beds := number("beds", "bedrooms")) is not None:
        tests.append(F.col("bedrooms") == beds)
    if filters.get("epc") and has("epc_rating"):
        tests.append(F.upper("epc_rating") == str(filters["epc"]).upper())
    if (cap := number("max_price", "price_numeric")) is not None:
        tests.append(F.col("price_numeric").isNull() | (F.col("price_numeric") <= cap * 100))
    if (sqft := number("min_sqft", "size_sqft")) is not None:
        tests.append(F.col("size_sqft").isNull() | (F.col("size_sqft") >= sqft))
    if filters.get("glazing") and has("windows_description"):
        tests.append(F.lower("windows_description").contains(str(filters["glazing"]).lower()))
    if filters.get("built_form") and has("built_form"):
        tests.append(F.lower("built_form") == str(filters["built_form"]).lower())
    if (score := number("min_score", "score")) is not None:
        tests.append(F.col("score") >= score)
    if filters.get("available_from") and has("let_available_iso"):
        iso = F.col("let_available_iso")
        known = iso >= str(filters["available_from"])
        tests.append(known | iso.isNull() | (iso == "") if filters.get("include_unknown") else known)
    if str(filters.get("newness") or "") in NEWNESS_HOURS and has("first_seen"):
        tests.append(newness(F.col("first_seen"), str(filters["newness"]), as_of))
    for axis in TAG_AXES:
        column = f"tag_{axis}"
        wanted = [v.strip() for v in str(filters.get(column) or "").split(",")]
        wanted = [v for v in wanted if v and v not in TAG_IGNORED]
        if wanted and has(column):
            tests.append(F.col(column).isin(wanted))
    return reduce(lambda a, b: a & b, tests)


def view_filters(df: DataFrame, filters: dict[str, Any], as_of: str) -> DataFrame:
    return df.filter(view_clause(filters, as_of, set(df.columns)))


def sort_keys(sort: str | None = None, tab: str | None = None) -> list[Column]:
    """NULLs last, uid as the final key. Without a sort the tab's default applies; unknown sorts mean score."""
    if sort:
        name = SORT_ALIASES.get(sort.lower(), sort.lower())
    else:
        name = TAB_SORTS.get((tab or "main").lower(), "score_desc")
    keys = SORTS.get(name, SORTS["score_desc"])
    return [F.asc_nulls_last(c) if asc else F.desc_nulls_last(c) for c, asc in keys] + [F.asc("uid")]


def view_page(df: DataFrame, filters: dict[str, Any], as_of: str, sort: str | None = None, page: int = 1,
              page_size: int = 20) -> tuple[DataFrame, int, int]:
    """(rows of the page, total matches, page actually served). Only the count reaches the driver."""
    matches = view_filters(df, filters, as_of)
    total = matches.count()
    size = max(1, int(page_size))
    served = min(max(1, int(page or 1)), max(1, -(-total // size)))
    rows = matches.orderBy(*sort_keys(sort, filters.get("tab"))).offset((served - 1) * size).limit(size)
    return rows, total, served


def facets(df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """(facet, value, n): distinct values with counts over active rows, one shuffle of pre-aggregated values."""
    columns = columns or {"portals": "portal", "regions": "region", "glazings": "windows_description", "built_forms": "built_form"}
    present = {facet: c for facet, c in columns.items() if c in df.columns}
    renamed = df.filter("is_active").select(*[F.col(c).alias(facet) for facet, c in present.items()])
    return renamed.unpivot([], list(present), "facet", "value").filter(F.col("value").isNotNull()).groupBy("facet", "value").agg(
        F.count("*").alias("n")
    )


def tab_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(tab_clause(tab)).alias(tab) for tab in TAB_SORTS]).unpivot([], list(TAB_SORTS), "tab", "n")


def price_display(pence: Column, text: Column) -> Column:
    """Amounts above 50000 are pence, smaller ones pounds already; unknown falls back to the text, then dashes."""
    pounds = F.when(pence > 50000, F.floor(pence / 100)).otherwise(pence)
    shown = F.concat(F.lit("£"), F.format_number(pounds, 0), F.lit(" pcm"))
    return F.when(pence.isNotNull(), shown).otherwise(F.coalesce(F.nullif(text, F.lit("")), F.lit("--")))


def decorate(df: DataFrame) -> DataFrame:
    """Add display price, certificate area in square feet, panel flag and duplicate flags."""
    sqm = F.nullif(F.col("total_floor_area_sqm"), F.lit(0.0))
    texts = [F.nullif(F.col(c), F.lit("")) for c in ("epc_rating", "built_form", "windows_description", "walls_description")]
    numbers = [F.col("total_floor_area_sqm").cast("string"), F.col("current_energy_efficiency").cast("string")]
    members = F.col("cluster_member_count") if "cluster_member_count" in df.columns else F.lit(1)
    others = F.greatest(F.coalesce(members, F.lit(1)) - 1, F.lit(0))
    return df.withColumns({
        "price_display": price_display(F.col("price_numeric"), F.col("price")),
        "total_floor_area_sqft": half_even(sqm * SQM_TO_SQFT),
        "has_cert_panel": F.coalesce(*texts, *numbers).isNotNull(),
        "cluster_other_count": others,
        "is_cluster_dupe": others >= 1,
    })


def dashboard_rows(df: DataFrame) -> DataFrame:
    return df.filter("is_active").orderBy(F.desc_nulls_last("score"), F.asc_nulls_first("price_numeric"), "uid")


def portal_statistics(df: DataFrame, as_of: str) -> DataFrame:
    """Counts, prices and last-day activity per portal plus the grand total (portal ``ALL``), in one rollup."""
    day_ago = F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(days=F.lit(1))
    return df.rollup("portal").agg(
        F.count("*").alias("total"), F.count("price_numeric").alias("with_price"),
        F.round(F.avg("price_numeric"), 4).alias("avg_price"), F.min("price_numeric").alias("min_price"),
        F.max("price_numeric").alias("max_price"), F.count_if(F.col("last_scraped") >= day_ago).alias("recent"),
            F.grouping("portal").alias("_all"),
    ).withColumn("portal", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("portal"))).drop("_all")


def search_properties(df: DataFrame, portal: str | None = None, min_price: int | None = None, max_price: int | None = None,
                      bedrooms: int | None = None, property_type: str | None = None, postcode_area: str | None = None,
                      max_commute: int | None = None, limit: int = 100) -> DataFrame:
    """Active listings by optional criteria (empty or zero means absent), most recently seen first."""
    tests = [F.col("is_active")]
    if portal:
        tests.append(F.col("portal") == portal)
    if min_price:
        tests.append(F.col("price_numeric") >= min_price)
    if max_price:
        tests.append(F.col("price_numeric") <= max_price)
    if bedrooms:
        tests.append(F.col("bedrooms") == bedrooms)
    if property_type:
        tests.append(F.col("property_type") == property_type)
    if postcode_area:
        tests.append(F.col("postcode").startswith(postcode_area))
    if max_commute:
        tests.append(F.col("commute_primary") <= max_commute)
    return df.filter(reduce(lambda a, b: a & b, tests)).orderBy(F.desc("last_scraped"), "uid").limit(limit)


def recheck_targets(df: DataFrame, min_score: int = 85) -> DataFrame:
    """Active listings worth re-checking, with the state they would move to when found let."""
    status = F.col("current_status")
    fresh = status.isNull() | (status == "new")
    engaged = status.isin("contact_queued", "contacted")
    return df.filter(F.col("is_active") & (engaged | (fresh & (F.col("score") >= min_score)))).withColumn(
        "planned_status", F.when(engaged, "not_contacted").when(fresh, "triage_reject")
    ).orderBy("portal", F.desc_nulls_last("score"), "uid")


def backfill_candidates(df: DataFrame, as_of: str, days: int = 7, limit: int | None = None) -> DataFrame:
    """Active, untagged, recently found listings that carry at least one photo, newest first."""
    from proplake.functions.jsoncols import string_array

    since = F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(days=F.lit(days))
    chosen = df.filter(
        F.col("tags_extracted_at").isNull() & F.col("is_active") & (F.col("first_seen") > since)
        & F.col("images").isNotNull() & (F.size(string_array(F.col("images"))) > 0)
    ).orderBy(F.desc("first_seen"), "uid")
    return chosen.limit(limit) if limit is not None else chosen


def floorplan_backfill_candidates(df: DataFrame, portal: str) -> DataFrame:
    return df.filter((F.col("portal") == portal) & F.col("is_active") & F.col("floorplan_data").isNull()
                     & F.col("url").isNotNull())


def listing_detail(df: DataFrame, uid: str, history: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """One listing with its ordered history, the other members of its cluster (uid, portal, url) and how many there are."""
    one = df.filter(F.col("uid") == uid)
    log = history.filter(F.col("uid") == uid).groupBy("uid").agg(
        F.array_sort(F.collect_list(F.struct("ts", "id", "from_status", "to_status", "reason", "accepted"))).alias("history")
    )
    out = one.join(log, "uid", "left")
    if clusters is not None:
        own = clusters.filter(F.col("uid") == uid).select("uid", "cluster_id")
        others = clusters.join(own.select("cluster_id"), "cluster_id", "left_semi").filter(F.col("uid") != uid)
        member = F.struct("uid", *[F.col(c) if c in clusters.columns else F.lit(None).cast("string").alias(c) for c in ("portal", "url")])
        facts = others.groupBy("cluster_id").agg(F.array_sort(F.collect_set(member)).alias("cluster_others"))  # adverts of one flat
        out = out.drop("cluster_id").join(own, "uid", "left").join(facts, "cluster_id", "left").withColumn(
            "cluster_size", F.coalesce(F.size("cluster_others"), F.lit(0)) + 1)
    return out
