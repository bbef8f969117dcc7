"""The query surface over a listing snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from proplake.functions import jsoncols as J
from proplake.operators import views
from proplake.plans.registry import query
from proplake.sources import readers
from proplake.sources.adapters import AS_OF

MAIN = "is_active AND (current_status IS NULL OR current_status='new')"


@query("scan_listing_tolerant", """
SELECT uid, portal, price_numeric, epc_rating, CASE WHEN CAST(property_id AS BIGINT)%2=0 THEN tag_view END AS tag_view, CAST(NULL AS STRING) AS roof_description, CAST(NULL AS INT) AS heating_cost_current
FROM listings""", "listings")
def scan_listing_tolerant(t):
    """Two versions on disk, the older one without some columns, scanned as one table."""
    from proplake.plans.scratch import scratch_folder

    root, recent = scratch_folder(t.spark, "versions"), F.col("property_id").cast("long") % 2 == 0
    t.listings.filter(~recent).drop("commute_primary", "tags_extracted_at", "tag_view").write.parquet(f"{root}/version=1")
    t.listings.filter(recent).write.parquet(f"{root}/version=2")
    return readers.read_listings(t.spark, root).select(
        "uid", "portal", "price_numeric", "epc_rating", "tag_view", "roof_description", "heating_cost_current")


@query("decode_json_columns", """
SELECT uid, CASE WHEN images IS NULL OR images='' OR NOT json_valid(images) OR json_type(images)<>'ARRAY' THEN 0
   ELSE len(list_filter(CAST(json_extract_string(images,'$[*]') AS VARCHAR[]), lambda x: x IS NOT NULL AND x<>'')) END AS n_images,
 CASE WHEN score_breakdown IS NULL OR NOT json_valid(score_breakdown) THEN 0 ELSE
   len(list_filter(json_keys(score_breakdown), lambda k: TRY_CAST(json_extract_string(score_breakdown, '$."'||k||'"') AS DOUBLE) IS NOT NULL)) END AS n_components,
 CASE WHEN json_valid(score_breakdown) THEN CAST(round_even(CAST(json_extract_string(score_breakdown,'$.size') AS DOUBLE),0) AS INT) END AS size_component,
 CASE WHEN floorplan_data IS NOT NULL AND floorplan_data<>'' AND json_valid(floorplan_data) AND json_extract_string(floorplan_data,'$.error') IS NULL
   THEN coalesce(json_array_length(floorplan_data,'$.rooms'),-1) END AS n_rooms
FROM listings""", "listings")
def decode_json_columns(t):
    breakdown, plan = J.int_map(F.col("score_breakdown")), J.floorplan(F.col("floorplan_data"))
    return t.listings.select(
        "uid", F.size(J.string_array(F.col("images"))).alias("n_images"), F.size(breakdown).alias("n_components"),
        F.try_element_at(breakdown, F.lit("size")).alias("size_component"), F.size(plan["rooms"]).alias("n_rooms"))


@query("encode_json_columns", """
SELECT uid, CASE WHEN images IS NULL OR images='' OR NOT json_valid(images) OR json_type(images)<>'ARRAY' THEN '[]'
  ELSE coalesce('["'||nullif(array_to_string(list_filter(CAST(json_extract_string(images,'$[*]') AS VARCHAR[]), lambda x: x IS NOT NULL AND x<>''),'","'),'')||'"]', '[]') END AS images_json,
 CASE WHEN json_valid(score_breakdown) THEN CAST(json_extract_string(score_breakdown,'$.price') AS INT) END AS price_back,
 CASE WHEN plan IS NOT NULL THEN coalesce(CAST(json_array_length(plan,'$.rooms') AS INT), -1) END AS rooms_back, CAST(json_extract_string(plan,'$.total_size_sqft') AS DOUBLE) AS size_back
FROM (SELECT uid, images, score_breakdown, CASE WHEN floorplan_data IS NOT NULL AND floorplan_data<>'' AND json_valid(floorplan_data) AND json_extract_string(floorplan_data,'$.error') IS NULL THEN floorplan_data END AS plan FROM listings) l""", "listings")
def encode_json_columns(t):
    """Arrays to text, and a map and a struct to text and back."""
    decoded = t.listings.select("uid", J.string_array(F.col("images")).alias("images"), J.int_map(F.col("score_breakdown")).alias("breakdown"), J.floorplan(F.col("floorplan_data")).alias("plan"))
    back = J.int_map(F.to_json("breakdown"))
    plan = J.floorplan(F.to_json("plan"))
    rooms = F.when(plan.isNotNull(), F.coalesce(F.size(plan["rooms"]), F.lit(-1)))
    return decoded.select("uid", F.to_json("images").alias("images_json"), F.try_element_at(back, F.lit("price")).alias("price_back"), rooms.alias("rooms_back"), plan["total_size_sqft"].alias("size_back"))


FILTER_CASES = {
    "view_filters": ({"tab": "main", "source": "Portal_A", "max_price": "3400", "min_sqft": "320", "beds": "2", "epc": "c"},
                     f"{MAIN} AND upper(portal)='PORTAL_A' AND (price_numeric IS NULL OR price_numeric<=340000) AND (size_sqft IS NULL OR size_sqft>=320) AND bedrooms=2 AND upper(epc_rating)='C'"),
    "view_filters_text": ({"region": "highbury, north london", "glazing": "DOUBLE", "min_score": "40", "beds": "two", "max_price": ""},
                          f"{MAIN} AND lower(region)='highbury, north london' AND lower(windows_description) LIKE '%double%' AND score>=40"),
    "view_filters_built_form": ({"tab": "rejected", "built_form": "DETACHED"},
                                "current_status IN ('triage_reject','final_reject','not_contacted') AND lower(built_form)='detached'"),
    "view_filters_available": ({"tab": "queued", "available_from": "2001-05-01", "include_unknown": "1"},
                               "is_active AND current_status='contact_queued' AND (let_available_iso>='2001-05-01' OR let_available_iso IS NULL OR let_available_iso='')"),
    "view_filters_tags": ({"tag_flooring": "wood, unclear", "tag_view": "street,skyline", "tag_open_plan": "unclear"},
                          f"{MAIN} AND tag_flooring IN ('wood') AND tag_view IN ('street','skyline')"),
}


def _filter_case(name, filters, where):
    @query(name, f"SELECT uid, portal, price_numeric, score FROM listings WHERE {where}", "listings")
    def run(t):
        return views.view_filters(t.listings, filters, AS_OF).select("uid", "portal", "price_numeric", "score")


for _name, (_filters, _where) in FILTER_CASES.items():
    _filter_case(_name, _filters, _where)


@query("newness_bucket", f"""
SELECT h.bucket, count(*) AS n FROM (VALUES ('3h',3),('6h',6),('12h',12),('24h',24),('3d',72),('1w',168),('1m',720)) h(bucket,hours)
JOIN listings l ON l.is_active AND l.first_seen >= TIMESTAMP '{AS_OF}' - to_hours(h.hours*12) GROUP BY h.bucket""", "listings")
def newness_bucket(t):
    # horizons are stretched twelvefold so that every one of them holds rows of the test calendar
    since = F.to_timestamp(F.lit(AS_OF))
    counts = t.listings.filter("is_active").agg(*[
        F.count_if(F.col("first_seen") >= since - F.make_dt_interval(hours=F.lit(hours * 12))).alias(bucket)
        for bucket, hours in views.NEWNESS_HOURS.items()])
    return counts.unpivot([], list(views.NEWNESS_HOURS), "bucket", "n").filter("n > 0")


@query("newness_filter", f"SELECT uid, first_seen FROM listings WHERE {MAIN} AND first_seen>=TIMESTAMP '{AS_OF}' - to_hours(720)", "listings")
def newness_filter(t):
    return views.view_filters(t.listings, {"newness": "1m"}, AS_OF).select("uid", "first_seen")


SORTED = {
    "score_desc": "score DESC NULLS LAST", "price_asc": "price_numeric ASC NULLS LAST", "sqft_desc": "size_sqft DESC NULLS LAST",
    "first_seen_desc": "first_seen DESC NULLS LAST", "transition_desc": "last_transition_at DESC NULLS LAST",
    "transition_asc": "last_transition_at ASC NULLS LAST",
}
ARM = "SELECT '{s}' AS sort, uid, row_number() OVER (ORDER BY {o}, uid) AS position FROM listings WHERE is_active"


@query("view_sort", " UNION ALL ".join(ARM.format(s=s, o=o) for s, o in SORTED.items()), "listings")
def view_sort(t):
    """Every active listing with its place under every sort."""
    from functools import reduce

    from proplake.functions.ranks import with_position

    rows = t.listings.filter("is_active").select("uid", "score", "price_numeric", "size_sqft", "first_seen", "last_transition_at")
    arms = [with_position(rows, views.sort_keys(s), "position").select(F.lit(s).alias("sort"), "uid", "position") for s in SORTED]
    return reduce(lambda a, b: a.unionAll(b), arms)


@query("view_page", f"""
SELECT uid, score, (SELECT count(*) FROM listings WHERE {MAIN} AND (price_numeric IS NULL OR price_numeric<=300000)) AS total
FROM listings WHERE {MAIN} AND (price_numeric IS NULL OR price_numeric<=300000) ORDER BY score DESC NULLS LAST, uid LIMIT 20 OFFSET 40""", "listings")
def view_page(t):
    rows, total, _ = views.view_page(t.listings, {"tab": "main", "max_price": 3000}, AS_OF, page=3)
    return rows.select("uid", "score", F.lit(total).cast("long").alias("total"))


@query("facets", """
SELECT facet, value, count(*) AS n FROM (
 SELECT 'portals' AS facet, portal AS value FROM listings WHERE is_active UNION ALL SELECT 'regions', region FROM listings WHERE is_active
 UNION ALL SELECT 'glazings', windows_description FROM listings WHERE is_active UNION ALL SELECT 'built_forms', built_form FROM listings WHERE is_active)
WHERE value IS NOT NULL GROUP BY facet, value""", "listings")
def facets(t):
    return views.facets(t.listings)


@query("tab_counts", f"""
SELECT 'main' AS tab, count(*) AS n FROM listings WHERE {MAIN} UNION ALL SELECT 'queued', count(*) FROM listings WHERE is_active AND current_status='contact_queued'
UNION ALL SELECT 'contacted', count(*) FROM listings WHERE is_active AND current_status='contacted'
UNION ALL SELECT 'shortlisted', count(*) FROM listings WHERE is_active AND current_status='shortlisted'
UNION ALL SELECT 'rejected', count(*) FROM listings WHERE current_status IN ('triage_reject','final_reject','not_contacted')""", "listings")
def tab_counts(t):
    return views.tab_counts(t.listings)


@query("decorate", """
SELECT uid, CASE WHEN price_numeric IS NULL THEN '--' ELSE chr(163)||format('{:,}', CASE WHEN price_numeric>50000 THEN price_numeric//100 ELSE price_numeric END)||' pcm' END AS price_display,
 CAST(round_even(total_floor_area_sqm*10.7639::DOUBLE,0) AS INT) AS total_floor_area_sqft,
 epc_rating IS NOT NULL OR total_floor_area_sqm IS NOT NULL OR current_energy_efficiency IS NOT NULL OR coalesce(built_form,'')<>'' OR windows_description IS NOT NULL OR walls_description IS NOT NULL AS has_cert_panel,
 greatest(coalesce(scrape_count,1)-1,0) AS cluster_other_count, coalesce(scrape_count,1)>1 AS is_cluster_dupe FROM listings""", "listings")
def decorate(t):
    return views.decorate(t.listings.withColumn("cluster_member_count", F.col("scrape_count"))).select(
        "uid", "price_display", "total_floor_area_sqft", "has_cert_panel", "cluster_other_count", "is_cluster_dupe")


@query("dashboard_rows", "SELECT uid, portal, score, price_numeric FROM listings WHERE is_active", "listings")
def dashboard_rows(t):
    return views.dashboard_rows(t.listings).select("uid", "portal", "score", "price_numeric")


@query("portal_statistics", f"""
SELECT coalesce(portal,'ALL') AS portal, count(*) AS total, count(price_numeric) AS with_price, round(avg(price_numeric),4) AS avg_price,
 min(price_numeric) AS min_price, max(price_numeric) AS max_price, count(*) FILTER (WHERE last_scraped >= TIMESTAMP '{AS_OF}' - to_days(1)) AS recent
FROM listings GROUP BY ROLLUP (portal)""", "listings")
def portal_statistics(t):
    return views.portal_statistics(t.listings, AS_OF)


@query("search_properties", """
SELECT uid, portal, price_numeric, last_scraped FROM listings WHERE is_active AND portal='portal_a' AND price_numeric>=180000 AND price_numeric<=320000
 AND bedrooms=2 AND postcode LIKE 'N1%' AND commute_primary<=40 ORDER BY last_scraped DESC, uid LIMIT 100""", "listings")
def search_properties(t):
    return views.search_properties(t.listings, portal="portal_a", min_price=180000, max_price=320000, bedrooms=2,
                                   postcode_area="N1", max_commute=40).select("uid", "portal", "price_numeric", "last_scraped")


@query("recheck_targets", """
SELECT uid, portal, score, CASE WHEN current_status IN ('contact_queued','contacted') THEN 'not_contacted' ELSE 'triage_reject' END AS planned_status
FROM listings WHERE is_active AND (current_status IN ('contact_queued','contacted') OR ((current_status IS NULL OR current_status='new') AND score>=85))""", "listings")
def recheck_targets(t):
    return views.recheck_targets(t.listings).select("uid", "portal", "score", "planned_status")


@query("backfill_candidates", f"""
SELECT uid, first_seen FROM listings WHERE tags_extracted_at IS NULL AND is_active AND first_seen > TIMESTAMP '{AS_OF}' - to_days(90)
 AND images IS NOT NULL AND images NOT IN ('','[]') AND json_valid(images) AND json_type(images)='ARRAY'""", "listings")
def backfill_candidates(t):
    return views.backfill_candidates(t.listings, AS_OF, days=90).select("uid", "first_seen")


@query("floorplan_backfill_candidates", "SELECT uid, url FROM listings WHERE portal='portal_b' AND is_active AND floorplan_data IS NULL", "listings")
def floorplan_backfill_candidates(t):
    return views.floorplan_backfill_candidates(t.listings, "portal_b").select("uid", "url")


@query("export_top1000_json", f"""
SELECT uid, score FROM listings WHERE {MAIN} AND tag_natural_light='high' ORDER BY score DESC NULLS LAST, uid LIMIT 1000""", "listings")
def export_top1000_json(t):
    """The export as written, read back."""
    from proplake.plans.scratch import scratch_folder
    from proplake.sources.sinks import export_top_json

    path = scratch_folder(t.spark, "export")
    export_top_json(t.listings, {"tag_natural_light": "high"}, AS_OF, path)
    return t.spark.read.schema("uid string, score int").json(path)


@query("backfill_counts", r"""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE images IS NULL OR images='' OR CASE WHEN json_valid(images) THEN coalesce(json_type(images)='ARRAY' OR json_type(json_extract(images,'$.urls'))='ARRAY',FALSE) ELSE FALSE END) AS photo_count,
 count(*) FILTER (WHERE lower(trim(floor_level)) IN ('ground','ground floor','gr','g') OR regexp_matches(trim(floor_level),'^-?\d')) AS floor_level_int,
 count(*) FILTER (WHERE regexp_matches(title,'(?i)\blet\s*agreed\b|\bunder\s*offer\b|\blet\s*by\b|\bnow\s*let\b|\btenanted\b')) AS let_agreed
FROM listings""", "listings")
def backfill_counts(t):
    from proplake.functions.text import floor_level_int
    from proplake.operators.gate import is_let_agreed_title

    return t.listings.agg(
        F.count("*").alias("n_rows"), F.count(J.photo_count(F.col("images"))).alias("photo_count"),
        F.count(floor_level_int(F.col("floor_level"))).alias("floor_level_int"),
        F.count_if(is_let_agreed_title(F.col("title"))).alias("let_agreed"))


@query("floor_level_int", r"""
SELECT uid, CASE WHEN lower(trim(floor_level)) IN ('ground','ground floor','gr','g') THEN 0 ELSE TRY_CAST(nullif(regexp_extract(lower(trim(floor_level)),'^(-?\d+)',1),'') AS INT) END AS floor_level_int
FROM listings""", "listings")
def floor_level(t):
    from proplake.functions.text import floor_level_int

    return t.listings.select("uid", floor_level_int(F.col("floor_level")).alias("floor_level_int"))


@query("photo_count", """
SELECT uid, CASE WHEN images IS NULL OR images='' THEN 0 WHEN NOT json_valid(images) THEN NULL WHEN json_type(images)='ARRAY' THEN json_array_length(images)
 WHEN json_type(json_extract(images,'$.urls'))='ARRAY' THEN json_array_length(images,'$.urls') END AS photo_count FROM listings""", "listings")
def photo_count(t):
    return t.listings.select("uid", J.photo_count(F.col("images")).alias("photo_count"))
