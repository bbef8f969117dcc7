"""Enrichment joins and column rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from proplake.config import MATCH_THRESHOLD, TAG_AXES
from proplake.functions import jsoncols as J
from proplake.operators import enrich as E
from proplake.operators import geojoin as G
from proplake.plans.features import NEAREST
from proplake.plans.registry import query


NUMBERS = r"list_transform(list_filter(regexp_split_to_array(trim(regexp_replace(lower(coalesce(address1,'')||' '||coalesce(address2,'')),'[^\w\s]+',' ','g')),'\s+'), lambda x: regexp_full_match(x,'\d+[a-z]*')), lambda x: regexp_extract(x,'^(\d+)',1))"
#: Similarity in SQL: token sets, and the longest common subsequence of what is left, one character of ``b`` per step.
CERT_MATCH = r"""
asks AS (SELECT DISTINCT upper(trim(postcode)) AS pc, address, regexp_extract(address,'^\s*(\d+)',1) AS lead FROM listings WHERE coalesce(trim(postcode),'')<>'' AND coalesce(address,'')<>''),
cards AS (SELECT upper(trim(postcode)) AS pc, cert_id, rating, coalesce(lodgement_date,'') AS lodged, NUMS AS nums,
 array_to_string(list_filter([trim(address1), trim(address2), trim(address3)], lambda x: coalesce(x,'')<>''),', ') AS line FROM certificates),
met AS (SELECT a.pc, a.address, c.line, c.cert_id, c.rating, c.lodged FROM asks a JOIN cards c ON c.pc=a.pc AND (a.lead='' OR list_contains(c.nums, a.lead))),
token_sets AS (SELECT address, line, list_distinct(list_filter(regexp_split_to_array(trim(address),'\s+'), lambda x: x<>'')) AS ta, list_distinct(list_filter(regexp_split_to_array(trim(line),'\s+'), lambda x: x<>'')) AS tb FROM (SELECT DISTINCT address, line FROM met)),
parts AS (SELECT address, line, len(ta)*len(tb) AS some_, array_to_string(list_sort(list_filter(ta, lambda x: list_contains(tb,x))),' ') AS shared_text,
 array_to_string(list_sort(list_filter(ta, lambda x: NOT list_contains(tb,x))),' ') AS a, array_to_string(list_sort(list_filter(tb, lambda x: NOT list_contains(ta,x))),' ') AS b FROM token_sets),
walks AS (SELECT DISTINCT a, b, 0 AS i, list_transform(range(0,length(a)+1), lambda x: CAST(0 AS BIGINT)) AS r FROM parts
 UNION ALL SELECT a, b, i+1, list_transform(range(1,length(a)+2), lambda k: list_max(list_transform(range(1,k+1), lambda j: greatest(r[j], CASE WHEN j>1 AND substr(a,j-1,1)=substr(b,i+1,1) THEN r[j-1]+1 ELSE 0 END)))) FROM walks WHERE i<length(b)),
commons AS (SELECT a, b, r[length(a)+1] AS lcs FROM walks WHERE i=length(b)),
sized AS (SELECT p.*, c.lcs, length(shared_text) AS base, CASE WHEN shared_text<>'' THEN 1 ELSE 0 END AS gap FROM parts p JOIN commons c ON c.a=p.a AND c.b=p.b),
scored AS (SELECT address, line, CASE WHEN some_=0 THEN 0.0 WHEN shared_text<>'' AND (a='' OR b='') THEN 100.0 ELSE greatest(100.0-100.0*(length(a)+length(b)-2*lcs)/(2*(base+gap)+length(a)+length(b)),
  CASE WHEN shared_text<>'' THEN 100.0-100.0*(gap+length(a))/(2*base+gap+length(a)) ELSE 0 END, CASE WHEN shared_text<>'' THEN 100.0-100.0*(gap+length(b))/(2*base+gap+length(b)) ELSE 0 END) END AS match_score FROM sized),
best AS (SELECT m.pc, m.address, arg_max(struct_pack(cert_id:=m.cert_id, rating:=m.rating, match_score:=s.match_score), (s.match_score, m.lodged, m.cert_id)) AS m FROM met m JOIN scored s ON s.address=m.address AND s.line=m.line
 WHERE s.match_score>=THRESH GROUP BY m.pc, m.address)"""


@query("cert_fuzzy_match", """
SELECT l.uid, b.m.cert_id AS cert_id, b.m.rating AS rating, round(b.m.match_score,4) AS match_score FROM listings l
LEFT JOIN best b ON b.pc=upper(trim(l.postcode)) AND b.address=l.address""", "listings", "certificates",
       ctes=CERT_MATCH.replace("NUMS", NUMBERS).replace("THRESH", str(MATCH_THRESHOLD)), recursive=True)
def cert_fuzzy_match(t):
    return E.cert_fuzzy_match(t.listings, t.certificates).select(
        "uid", F.col("match.cert.cert_id").alias("cert_id"), F.col("match.cert.rating").alias("rating"),
        F.round("match.match_score", 4).alias("match_score"))


TOKENS = r"regexp_split_to_array(trim(regexp_replace(lower(coalesce(c.address1,'')||' '||coalesce(c.address2,'')),'[^\w\s]+',' ','g')),'\s+')"


@query("unit_gate", rf"""
SELECT l.postcode, l.address, count(*) AS n_certs, count(*) FILTER (WHERE lead='' OR list_contains({TOKENS}, lead)
  OR list_contains(list_transform(list_filter({TOKENS}, lambda x: regexp_full_match(x,'\d+[a-z]+')), lambda x: regexp_extract(x,'^(\d+)',1)), lead)) AS n_pass
FROM (SELECT DISTINCT postcode, address, regexp_extract(address,'^\s*(\d+)',1) AS lead FROM listings WHERE postcode IS NOT NULL) l
JOIN certificates c ON c.postcode=l.postcode GROUP BY l.postcode, l.address""", "listings", "certificates")
def unit_gate(t):
    asks = t.listings.filter("postcode IS NOT NULL").select("postcode", "address").distinct()
    passed = E.unit_gate(F.col("address"), F.col("address1"), F.col("address2"))
    return asks.join(t.certificates, "postcode").groupBy("postcode", "address").agg(
        F.count("*").alias("n_certs"), F.count_if(passed).alias("n_pass"))


@query("cert_fields", """
SELECT cert_id, TRY_CAST(floor_area_text AS DOUBLE) AS total_floor_area_sqm, CAST(round_even(TRY_CAST(floor_area_text AS DOUBLE)*10.7639::DOUBLE,0) AS INT) AS size_sqft_fallback,
 TRY_CAST(efficiency_text AS INT) AS current_energy_efficiency, TRY_CAST(potential_text AS INT) AS potential_energy_efficiency FROM certificates""", "certificates")
def cert_fields(t):
    return E.cert_fields(t.certificates).select(
        "cert_id", "total_floor_area_sqm", "size_sqft_fallback", "current_energy_efficiency", "potential_energy_efficiency")


@query("cert_latest_by_postcode", """
SELECT l.uid, c.rating AS latest_rating FROM listings l LEFT JOIN (SELECT postcode, rating, row_number() OVER (PARTITION BY postcode ORDER BY lodgement_date DESC, cert_id DESC) AS rn FROM certificates) c
 ON c.postcode=l.postcode AND c.rn=1""", "listings", "certificates")
def cert_latest_by_postcode(t):
    return E.cert_latest_by_postcode(t.listings, t.certificates).select("uid", "latest_rating")


LETTER = "CASE WHEN {0} BETWEEN 92 AND 100 THEN 'A' WHEN {0} BETWEEN 81 AND 91 THEN 'B' WHEN {0} BETWEEN 69 AND 80 THEN 'C' WHEN {0} BETWEEN 55 AND 68 THEN 'D' WHEN {0} BETWEEN 39 AND 54 THEN 'E' WHEN {0} BETWEEN 21 AND 38 THEN 'F' WHEN {0} BETWEEN 1 AND 20 THEN 'G' END"


@query("rating_priority", """
SELECT uid, coalesce(nullif(scraper_rating,''), text_rating, cert_rating, CASE WHEN read_sap BETWEEN 1 AND 100 THEN read_rating END) AS epc_rating,
 CASE WHEN coalesce(nullif(scraper_rating,''), text_rating) IS NOT NULL THEN NULL WHEN cert_rating IS NOT NULL THEN 'epc_api'
  WHEN read_sap BETWEEN 1 AND 100 AND read_rating IS NOT NULL THEN 'vision_ocr' END AS epc_rating_source,
 CASE WHEN coalesce(nullif(scraper_rating,''), text_rating) IS NOT NULL THEN NULL WHEN cert_rating IS NOT NULL THEN 'epc_api_match'
  WHEN read_sap BETWEEN 1 AND 100 AND read_rating IS NOT NULL THEN 'sap_derived' END AS epc_rating_confidence FROM size_sources""", "size_sources")
def rating_priority(t):
    confidence = F.when(F.col("read_sap").between(1, 100), "sap_derived").otherwise("miss")
    chosen = E.rating_priority(F.col("scraper_rating"), F.col("text_rating"), F.col("cert_rating"), F.col("read_rating"), confidence)
    return t.size_sources.select("uid", *[c.alias(n) for n, c in chosen.items()])


@query("sap_to_letter", f"SELECT uid, {LETTER.format('read_sap')} AS letter FROM size_sources", "size_sources")
def sap_to_letter(t):
    return t.size_sources.select("uid", E.sap_to_letter(F.col("read_sap")).alias("letter"))


@query("sap_reconcile", f"""
SELECT uid, CASE WHEN good THEN letter END AS reconciled_rating, CASE WHEN good THEN read_sap END AS reconciled_sap, CASE WHEN good THEN 'sap_derived' ELSE 'miss' END AS confidence,
 CASE WHEN read_sap IS NULL THEN 'missing_current_sap' WHEN read_sap NOT BETWEEN 1 AND 100 THEN 'current_sap_out_of_range' WHEN read_potential_sap<read_sap THEN 'potential_sap_below_current'
  WHEN letter=read_rating THEN 'ok' ELSE 'sap_derived_letter_overrides_model_letter('||coalesce(read_rating,'None')||')' END AS reason
FROM (SELECT *, {LETTER.format('read_sap')} AS letter, coalesce(read_sap BETWEEN 1 AND 100,FALSE) AND NOT coalesce(read_potential_sap<read_sap,FALSE) AS good FROM size_sources)""", "size_sources")
def sap_reconcile(t):
    out = E.sap_reconcile(F.col("read_rating"), F.col("read_sap"), F.col("read_potential_sap"))
    return t.size_sources.select("uid", *[c.alias(n) for n, c in out.items()])


@query("sap_consistent", f"""
SELECT uid, coalesce({LETTER.format('read_sap')}=read_rating,FALSE) AND NOT coalesce(read_potential_rating>read_rating,FALSE) AND NOT coalesce(read_potential_sap<read_sap,FALSE) AS consistent
FROM size_sources""", "size_sources")
def sap_consistent(t):
    return t.size_sources.select("uid", E.sap_consistent(
        F.col("read_rating"), F.col("read_sap"), F.col("read_potential_rating"), F.col("read_potential_sap")).alias("consistent"))


@query("nearest_region", f"SELECT uid, region FROM (SELECT DISTINCT latitude, longitude, CASE WHEN latitude IS NOT NULL THEN {NEAREST.replace('texts.', 'p.')} END AS region FROM (SELECT DISTINCT latitude, longitude FROM listings) p) r JOIN listings l ON l.latitude IS NOT DISTINCT FROM r.latitude AND l.longitude IS NOT DISTINCT FROM r.longitude".replace("SELECT uid, region", "SELECT l.uid, r.region"), "listings", "centroids")
def nearest_region(t):
    return G.nearest_region(t.listings.drop("region"), t.centroids).select("uid", "region")


#: Nearest by (distance, number) as a pair: adding numbers of any size to a scaled distance lets farther points win.
NEAREST_SPOT = NEAREST.replace("texts.", "p.").replace("centroids c", "spots c").replace("dist*1000000+ord", "(dist, ord)")
STATION_POINTS = """spots AS (SELECT station AS name, lat, lng, CAST(row_number() OVER (ORDER BY station) AS INT) AS ord FROM stations)"""


@query("nearest_region_rings", f"SELECT l.uid, r.region FROM (SELECT latitude, longitude, CASE WHEN latitude IS NOT NULL THEN {NEAREST_SPOT} END AS region FROM (SELECT DISTINCT latitude, longitude FROM listings) p) r JOIN listings l ON l.latitude IS NOT DISTINCT FROM r.latitude AND l.longitude IS NOT DISTINCT FROM r.longitude",
       "listings", "stations", ctes=STATION_POINTS)
def nearest_region_rings(t):
    # against a point table that grows with the data
    spots = t.stations.select(F.col("station").alias("name"), "lat", "lng", F.col("station").alias("ord"))
    return G.nearest_region(t.listings, spots).select("uid", "region")


METRES = "2*6371000.0*asin(sqrt(power(sin(radians(l.latitude-s.lat)/2),2)+cos(radians(s.lat))*cos(radians(l.latitude))*power(sin(radians(l.longitude-s.lng)/2),2)))"


@query("radius_prune", f"SELECT uid FROM listings l WHERE latitude IS NOT NULL AND EXISTS (SELECT 1 FROM centroids s WHERE {METRES}<=2000)", "listings", "centroids")
def radius_prune(t):
    return G.radius_prune(t.listings, t.centroids, 2.0).select("uid")


@query("nearest_station", rf"""
SELECT l.uid, n.station AS nearest_station, CASE WHEN n.station IS NOT NULL THEN greatest(1, CAST(round_even(n.metres/80,0) AS INT)) END AS tube_distance,
 TRY_CAST(list_min(regexp_extract_all(n.zone_text,'(\d+)',1)) AS INT) AS tfl_zone
FROM listings l LEFT JOIN (SELECT * FROM (SELECT l.latitude, l.longitude, s.station, s.zone_text, round({METRES},6) AS metres,
   row_number() OVER (PARTITION BY l.latitude, l.longitude ORDER BY round({METRES},6), s.station) AS rn
  FROM (SELECT DISTINCT latitude, longitude FROM listings WHERE latitude IS NOT NULL) l JOIN stations s ON abs(s.lat-l.latitude)<0.02 AND {METRES}<=1200) WHERE rn=1) n
 ON n.latitude=l.latitude AND n.longitude=l.longitude""", "listings", "stations")
def nearest_station(t):
    return G.nearest_station(t.listings, t.stations).select("uid", "nearest_station", "tube_distance", "tfl_zone")


@query("postcode_to_coords", """
SELECT l.uid, coalesce(p.lat,p.hist_lat) AS pc_lat, coalesce(p.lng,p.hist_lng) AS pc_lng, p.lat IS NULL AND p.hist_lat IS NOT NULL AND p.postcode_key IS NOT NULL AS terminated
FROM listings l LEFT JOIN postcode_lookup p ON p.postcode_key=upper(replace(l.postcode,' ',''))""", "listings", "postcode_lookup")
def postcode_to_coords(t):
    return E.postcode_to_coords(t.listings, t.postcode_lookup).select(
        "uid", "pc_lat", "pc_lng", F.coalesce("terminated", F.lit(False)).alias("terminated"))


LEGS = ["hub_one", "hub_two", "hub_three"]
FASTEST = """fastest AS (SELECT origin, min(minutes) FILTER (WHERE mode='public' AND destination='hub_one') AS hub_one, min(minutes) FILTER (WHERE mode='public' AND destination='hub_two') AS hub_two,
 min(minutes) FILTER (WHERE mode='public' AND destination='hub_three') AS hub_three, min(minutes) FILTER (WHERE mode='cycle' AND destination='hub_one') AS cycle_minutes FROM travel_times GROUP BY origin)"""


@query("commute_minutes", "SELECT * FROM fastest", "travel_times", ctes=FASTEST)
def commute_minutes(t):
    return E.commute_minutes(t.travel_times, LEGS)


@query("commute_pass", """
SELECT origin, coalesce(hub_one<=40 AND hub_two<=40 AND hub_three<=40, FALSE) AS strict_pass, greatest(hub_one,hub_two,hub_three)<=40 AS known_pass FROM fastest""",
       "travel_times", ctes=FASTEST)
def commute_pass(t):
    return E.commute_minutes(t.travel_times, LEGS).select(
        "origin", E.commute_pass(LEGS).alias("strict_pass"), E.commute_pass(LEGS, strict=False).alias("known_pass"))


OK = "({0}>=100 AND NOT coalesce(bedrooms>0 AND {0}/bedrooms>800,FALSE))"
ORDER = ["structured", "nlp", "floorplan_vision", "epc_interpolated", "epc_direct"]
CONF = {"structured": "0.95", "nlp": "0.85", "floorplan_vision": "0.8", "epc_interpolated": "0.5", "epc_direct": "0.7"}


@query("size_merge", f"""
SELECT uid, CASE {' '.join(f"WHEN {OK.format(s)} THEN {s}" for s in ORDER)} END AS size_sqft, CASE {' '.join(f"WHEN {OK.format(s)} THEN '{s}'" for s in ORDER)} END AS size_sqft_source,
 CASE {' '.join(f"WHEN {OK.format(s)} THEN {CONF[s]}::DOUBLE" for s in ORDER)} END AS size_sqft_confidence,
 coalesce(floorplan_vision>=100 AND e>=100 AND abs(floorplan_vision-e)/greatest(floorplan_vision,e)>0.30::DOUBLE,FALSE) AS epc_floorplan_disagreement
FROM (SELECT *, coalesce(epc_interpolated,epc_direct) AS e FROM size_sources)""", "size_sources")
def size_merge(t):
    return E.size_merge(t.size_sources).select("uid", "size_sqft", "size_sqft_source", "size_sqft_confidence", "epc_floorplan_disagreement")


PLAN = """plans AS (SELECT uid, size_sqft, CASE WHEN json_valid(nullif(floorplan_data,'')) AND json_extract_string(floorplan_data,'$.error') IS NULL THEN floorplan_data END AS p FROM listings),
totals AS (SELECT uid, size_sqft, p, coalesce(CASE WHEN CAST(json_extract_string(p,'$.total_size_sqft') AS DOUBLE)>0 THEN CAST(json_extract_string(p,'$.total_size_sqft') AS DOUBLE) END,
  CASE WHEN CAST(json_extract_string(p,'$.total_area_sqft') AS DOUBLE)>0 THEN CAST(json_extract_string(p,'$.total_area_sqft') AS DOUBLE) END,
  nullif(list_sum(CAST(json_extract_string(p,'$.rooms[*].size_sqft') AS DOUBLE[])),0)) AS total FROM plans)"""


@query("size_credibility", """
SELECT uid, total AS floorplan_sqft, CASE WHEN size_sqft IS NULL OR total IS NULL THEN 'missing' WHEN abs(size_sqft-total)/greatest(size_sqft,total)<=0.10::DOUBLE THEN 'trusted' ELSE 'conflict' END AS credibility FROM totals""",
       "listings", ctes=PLAN)
def size_credibility(t):
    with_total = t.listings.withColumn("floorplan_sqft", E.floorplan_total(J.floorplan(F.col("floorplan_data"))))
    return with_total.select("uid", "floorplan_sqft", E.size_credibility(F.col("size_sqft"), F.col("floorplan_sqft")).alias("credibility"))


def room_sql(category: str) -> str:
    kind = "CASE WHEN contains(lower(x),'bedroom') OR contains(lower(x),'master') THEN 'bedroom' WHEN contains(lower(x),'bathroom') OR contains(lower(x),'shower') OR contains(lower(x),'wc') OR contains(lower(x),'toilet') THEN 'bathroom' WHEN contains(lower(x),'reception') OR contains(lower(x),'living') OR contains(lower(x),'lounge') OR contains(lower(x),'dining') THEN 'reception' WHEN contains(lower(x),'kitchen') THEN 'kitchen' ELSE 'other' END"
    return f"coalesce(len(list_filter(CAST(json_extract_string(p,'$.rooms[*].name') AS VARCHAR[]), lambda x: {kind}='{category}')),0) AS {category}"


@query("room_categories", f"SELECT uid, {', '.join(room_sql(c) for c in ('bedroom', 'bathroom', 'reception', 'kitchen', 'other'))} FROM plans WHERE p IS NOT NULL", "listings", ctes=PLAN)
def room_categories(t):
    plan = t.listings.withColumn("plan", J.floorplan(F.col("floorplan_data"))).filter("plan IS NOT NULL")
    return plan.select("uid", *[c.alias(n) for n, c in E.room_counts(F.col("plan.rooms")).items()])


@query("photo_rollup_any", """
SELECT uid, count(*) AS n_photos, count(carpet) AS n_judged, bool_or(carpet) AS carpet_detected,
 CASE WHEN count(carpet)>0 THEN CAST(round(sum(coalesce(confidence_milli,0)) FILTER (WHERE carpet IS NOT NULL)/count(carpet),4) AS DOUBLE) END AS avg_confidence_milli FROM photo_predictions GROUP BY uid""", "photo_predictions")
def photo_rollup_any(t):
    return E.photo_rollup_any(t.photo_predictions).select(
        "uid", "n_photos", "n_judged", "carpet_detected", F.round(F.try_divide("confidence_sum", "n_judged"), 4).alias("avg_confidence_milli"))


@query("photo_rollup_two_signal", """
SELECT uid, coalesce(bool_or(carpet) FILTER (WHERE room_type='bedroom'),FALSE) AS carpet_in_bedroom, coalesce(bool_or(carpet) FILTER (WHERE coalesce(room_type,'other')<>'bedroom'),FALSE) AS carpet_other_areas,
 bool_or(carpet) AS carpet_detected, round(sum(confidence_milli)/count(*),4) AS avg_confidence_milli FROM photo_predictions WHERE carpet IS NOT NULL GROUP BY uid""", "photo_predictions")
def photo_rollup_two_signal(t):
    return E.photo_rollup_two_signal(t.photo_predictions).select(
        "uid", "carpet_in_bedroom", "carpet_other_areas", "carpet_detected", F.round(F.col("confidence_sum") / F.col("n_judged"), 4).alias("avg_confidence_milli"))


@query("photo_rollup_two_step", """
SELECT uid, bedrooms_seen, bedrooms_with_carpet, living2>=2 AND living2*2>living AS has_living_area_carpet, bedrooms_with_carpet>0 AS carpet_in_bedroom,
 bedrooms_with_carpet>0 OR (living2>=2 AND living2*2>living) AS carpet_detected FROM (SELECT uid, count(*) FILTER (WHERE room_type='bedroom') AS bedrooms_seen,
  count(*) FILTER (WHERE room_type='bedroom' AND carpet) AS bedrooms_with_carpet, count(*) FILTER (WHERE room_type IN ('living-room','hallway','dining-room')) AS living,
  count(*) FILTER (WHERE room_type IN ('living-room','hallway','dining-room') AND carpet) AS living2 FROM photo_predictions GROUP BY uid)""", "photo_predictions")
def photo_rollup_two_step(t):
    return E.photo_rollup_two_step(t.photo_predictions)


def tag_sql(axis: str) -> str:
    allowed = ",".join(f"'{v}'" for v in TAG_AXES[axis])
    return f"CASE WHEN tag_{axis} IN ({allowed}) THEN tag_{axis} ELSE '{'unclear' if 'unclear' in TAG_AXES[axis] else 'not_shown'}' END AS tag_{axis}"


@query("tag_coerce", f"SELECT uid, {', '.join(tag_sql(a) for a in TAG_AXES)} FROM listings", "listings")
def tag_coerce(t):
    return E.tag_coerce(t.listings).select("uid", *[f"tag_{a}" for a in TAG_AXES])
