"""Deterministic views that give the star-schema test tables the shape of listing data.

Each view is one SELECT over the given tables, written in integer arithmetic so that any SQL engine yields
the same rows. ``deps`` names the base tables or other views the SELECT reads. No view caps or samples rows.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from proplake.sources.dialect import Duck, Spark

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

AS_OF = "2001-08-15 00:00:00"
TODAY = "2026-03-10"

_VIEWS: dict[str, tuple[list[str], Callable[[Any], str]]] = {}


def _view(name: str, *deps: str):
    def register(fn: Callable[[Any], str]) -> Callable[[Any], str]:
        _VIEWS[name] = (list(deps), fn)
        return fn

    return register


def pick(expr: str, *values: str | None) -> str:
    """CASE over consecutive integers 0, 1, 2 ... of ``expr``; the last value is the ELSE branch."""
    def lit(v: str | None) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'"

    if len(values) == 1:
        return lit(values[0])
    arms = " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values[:-1]))
    return f"CASE {expr} {arms} ELSE {lit(values[-1])} END"


TAG_VALUES = {  # three values per tag axis are enough to exercise the filters
    "window_style": ("sash", "casement", "unclear"),
    "ceiling_height": ("tall", "standard", "unclear"),
    "exposed_brick": ("yes", "no", "maybe"),
    "exposed_beams_or_ducts": ("yes", "no", "unclear"),
    "building_era": ("period", "new_build", "1990s"),
    "kitchen_finish": ("premium", "basic", "shiny"),
    "bathroom_finish": ("mid", "premium", "not_shown"),
    "flooring": ("wood", "carpet", "unclear"),
    "natural_light": ("high", "low", "unclear"),
    "wall_palette": ("white", "dark", "unclear"),
    "open_plan": ("yes", "no", "unclear"),
    "view": ("street", "skyline", "unclear"),
    "outdoor_access": ("garden", "none", "unclear"),
}


@_view("listings", "orders")
def _listings(d: Any) -> str:
    tags = ",\n ".join(
        f"{pick(f'(k+{i})%4', None, *values)} AS tag_{axis}" for i, (axis, values) in enumerate(TAG_VALUES.items())
    )
    pence = "CASE WHEN k%53=0 THEN NULL ELSE (1500+CAST(floor(p) AS BIGINT)%2000)*100 END"
    seen = d.hours("d", "k%24")
    region = pick(
        "c%9", "Highbury, North London", "Hoxton, North London", "Archway, London", "Holborn, Central London",
        "Walthamstow", "Hampstead, North West London", "Other", None, "Dalston, East London",
    )
    return f"""
SELECT portal||':'||CAST(k AS STRING) AS uid, portal, CAST(k AS STRING) AS property_id,
 CASE portal WHEN 'portal_a' THEN 'https://a.test/properties/'||CAST(k AS STRING)
      WHEN 'portal_b' THEN 'https://b.test/to-rent/details/'||CAST(k AS STRING)||'/'
      ELSE 'https://c.test/'||CAST(k AS STRING) END AS url,
 CASE WHEN k%29=0 THEN NULL
      ELSE CAST(1+c%3 AS STRING)||' bedroom flat to rent in '||CAST(1+k%90 AS STRING)||' Mill Lane'
           ||CASE WHEN k%31=0 THEN ' - Let  Agreed' WHEN k%37=0 THEN ' (under offer)' ELSE '' END END AS title,
 CASE WHEN k%43=0 THEN '' ELSE CAST(1+c%40 AS STRING)||' '||{pick('c%4', 'Mill Lane', 'Old Street', 'Park Road', 'High Road')}
      ||', '||{pick('c%3', 'Islington', 'Hackney', 'Camden')} END AS address,
 CASE WHEN portal='portal_c' OR k%17=0 THEN NULL
      ELSE 'N'||CAST(1+c%20 AS STRING)||' '||CAST({d.idiv('c', 20)}%10 AS STRING)
           ||substr('ABDEFGHJLN',CAST(1+{d.idiv('c', 200)}%10 AS INT),1)||'B' END AS postcode,
 'N'||CAST(1+c%20 AS STRING) AS area,
 CASE WHEN k%53=0 THEN NULL ELSE chr(163)||CAST(1500+CAST(floor(p) AS BIGINT)%2000 AS STRING)||' pcm' END AS price,
 {pence} AS price_numeric,
 CASE WHEN k%41=0 THEN NULL ELSE CAST(c%4 AS INT) END AS bedrooms,
 CASE WHEN k%3=0 THEN NULL ELSE CAST(1+c%2 AS INT) END AS bathrooms,
 {pick('k%7', 'flat', 'apartment', 'house', 'studio', 'maisonette', 'bungalow', None)} AS property_type,
 CASE WHEN k%5=0 THEN NULL ELSE CAST(300+(k*7)%700 AS INT) END AS size_sqft,
 CASE WHEN k%6=0 THEN NULL ELSE substr('ABCDEFG',CAST(1+k%7 AS INT),1) END AS epc_rating,
 CASE WHEN k%19=0 THEN NULL ELSE CAST(1+c%5 AS INT) END AS tfl_zone,
 CASE WHEN k%23=0 THEN NULL ELSE CAST(514500+(c%1000)*2+k%3 AS DOUBLE)/10000 END AS latitude,
 CASE WHEN k%23=0 THEN NULL ELSE CAST((c%700)*4-2000 AS DOUBLE)/10000 END AS longitude,
 {seen} AS first_seen, {d.days(seen, 'k%40')} AS last_scraped,
 CASE WHEN k%59=0 THEN NULL ELSE CAST(1+k%4 AS INT) END AS scrape_count,
 k%8<>0 AS is_active,
 CASE WHEN k%8<>0 THEN 'active' ELSE 'inactive' END AS status,
 {region} AS region,
 CASE WHEN k%11=0 THEN NULL ELSE CAST(1+k%18 AS INT) END AS tube_distance,
 CASE WHEN k%11=0 THEN NULL ELSE 'Station '||CAST(c%50 AS STRING) END AS nearest_station,
 CASE WHEN k%9=0 THEN NULL ELSE CAST((c*3+k)%60 AS INT) END AS commute_primary,
 CASE WHEN k%10=0 THEN NULL ELSE CAST((c*5+k)%60 AS INT) END AS commute_secondary,
 CASE WHEN k%4=0 THEN NULL ELSE c%3=0 END AS garden,
 CASE WHEN k%4=1 THEN NULL ELSE c%5=0 END AS balcony,
 {pick('c%4', 'furnished', 'unfurnished', None, 'part_furnished')} AS furnished,
 CASE WHEN k%6=1 THEN NULL ELSE c%7=0 END AS bills_included,
 CASE WHEN k%3=0 THEN NULL ELSE c%2=0 END AS carpet_detected,
 CASE WHEN k%3=0 THEN NULL ELSE CAST(50+k%50 AS DOUBLE)/100 END AS carpet_confidence,
 CASE WHEN k%5=1 THEN NULL ELSE c%3=1 END AS carpet_in_bedroom,
 CASE WHEN k%5=2 THEN NULL ELSE c%4=1 END AS carpet_other_areas,
 CASE WHEN k%7=0 THEN NULL ELSE CAST(k%4 AS INT) END AS bedrooms_with_carpet,
 CASE WHEN k%7=0 OR k%7=3 THEN NULL ELSE k%5=0 END AS has_living_area_carpet,
 {pick('c%4', 'Fully double glazed', 'Single glazed', None, 'Some double glazing')} AS windows_description,
 {pick('c%5', 'Mid-Terrace', 'Detached', None, '', 'Semi-Detached')} AS built_form,
 {pick('c%3', 'Cavity wall', None, 'Solid brick')} AS walls_description,
 CASE WHEN k%4=2 THEN NULL ELSE CAST(300+(c*7)%900 AS DOUBLE)/10 END AS total_floor_area_sqm,
 CASE WHEN k%4=2 THEN NULL ELSE CAST(1+c%100 AS INT) END AS current_energy_efficiency,
 {pick('k%9', 'Ground', '01', '2nd', 'mid floor', '-1', None, '12', 'ground floor ', '')} AS floor_level,
 CASE WHEN k%13=0 THEN NULL ELSE CAST((k*31+c)%101 AS INT) END AS score,
 {pick('k%12', 'new', 'contact_queued', None, 'contacted', 'new', 'shortlisted', 'triage_reject', 'new', 'not_contacted', None, 'final_reject', 'new')} AS current_status,
 CASE WHEN k%12 IN (1,3,5,6,8,10) THEN {d.days('d', 'k%5')} END AS last_transition_at,
 CASE WHEN k%14=0 THEN NULL WHEN k%14=1 THEN '' ELSE '2001-0'||CAST(1+k%9 AS STRING)||'-1'||CAST(c%10 AS STRING) END AS let_available_iso,
 CASE k%10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '[]' WHEN 3 THEN '[bad'
      WHEN 4 THEN '{{"urls":["u'||CAST(k AS STRING)||'","v"]}}'
      WHEN 5 THEN '["",null,"https://i.test/'||CAST(k AS STRING)||'.jpg"]'
      ELSE '["https://i.test/'||CAST(k AS STRING)||'.jpg","https://i.test/b.jpg","https://i.test/c'||CAST(c AS STRING)||'.jpg"]' END AS images,
 CASE k%8 WHEN 0 THEN NULL WHEN 1 THEN 'oops'
      ELSE '{{"price":'||CAST(c%101 AS STRING)||',"size":'||CAST(k%100 AS STRING)||'.5,"note":"n/a","transport":"'||CAST(k%60 AS STRING)||'"}}' END AS score_breakdown,
 CASE k%7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '{{"error":"timeout"}}' WHEN 3 THEN '{{broken'
      WHEN 4 THEN '{{"total_size_sqft":'||CAST(300+(k*7)%700+k%90 AS STRING)||',"rooms":[]}}'
      WHEN 5 THEN '{{"rooms":[{{"name":"Master Bedroom","size_sqft":'||CAST(100+c%300 AS STRING)||'}},{{"name":"Kitchen/Living","size_sqft":'||CAST(120+k%200 AS STRING)||'}},{{"name":"Shower Room","size_sqft":null}}]}}'
      ELSE '{{"total_size_sqft":null,"total_area_sqft":'||CAST(350+k%400 AS STRING)||',"rooms":[{{"name":"Lounge"}},{{"name":"Kitchen"}},{{"name":"Hall"}},{{"name":"WC"}}]}}' END AS floorplan_data,
 {tags},
 CASE WHEN k%5=3 THEN d END AS tags_extracted_at,
 CASE WHEN k%21=0 THEN NULL ELSE c END AS cluster_id
FROM (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS p, o_orderdate AS d,
      CASE o_orderkey%3 WHEN 0 THEN 'portal_a' WHEN 1 THEN 'portal_b' ELSE 'portal_c' END AS portal FROM orders) t"""


@_view("sightings", "events")
def _sightings(d: Any) -> str:
    return """
SELECT CAST(user_id AS STRING) AS uid, event_id, ts, CAST(floor(value*100) AS BIGINT) AS price_numeric,
 CASE WHEN event_id%9=0 THEN NULL ELSE CAST(floor(value) AS BIGINT)%5*100 END AS price_step
FROM events"""


@_view("latest_sightings", "events")
def _latest_sightings(d: Any) -> str:
    """The store's state. A fifth of the listings stand under another uid, so that some sightings are of unknown ones."""
    return """
SELECT CAST(user_id AS STRING) AS uid, max(ts) AS last_scraped, CAST(count(*) AS INT) AS scrape_count
FROM (SELECT CASE WHEN user_id%5=0 THEN user_id+9000000000 ELSE user_id END AS user_id, ts FROM events) e GROUP BY user_id"""


@_view("transitions", "events")
def _transitions(d: Any) -> str:
    states = pick("(event_id*7+user_id)%8", "contact_queued", "contacted", "shortlisted", "triage_reject",
                  "not_contacted", "final_reject", "new", "archived")
    return f"""
SELECT CAST(user_id AS STRING) AS uid, event_id AS id, ts, {states} AS to_status, event_type AS reason
FROM events"""


@_view("texts", "documents")
def _texts(d: Any) -> str:
    phrase = pick(
        "doc_id%23", " private garden", " no balcony", " south-facing terrace", " bills included", " bills are not included",
        " part-furnished", " unfurnished", " fully furnished", " Council Tax Band: D", " CTB e", " EPC rating C",
        " energy efficiency rating: d", " 720 sq ft", " 65 sq m", " 1,200 sqft", " available from 1st June 2026",
        " Available now", " available for viewings from 3 July", " benefits from a lovely little garden",
        " no outdoor space", " Energy Performance Certificate: B", " 54 square metres", "",
    )
    bullet = pick(
        "doc_id%11", None, "Garden", "No garden", "Balcony", "Bills inc", "Part furnished", "Unfurnished",
        "Council tax band: B", "Available From: 15th May 2026", "EPC: E 650 sq. ft.", "Parking",
    )
    title = pick("doc_id%7", "Flat with garden access", "Let Agreed flat", "EPC band F", None, "two bed with a terrace",
                 "Now let studio", "tax band: C")
    return f"""
SELECT doc_id, lang, n_chars, text||{phrase} AS description, {bullet} AS bullet_1,
 CASE WHEN doc_id%5=0 THEN 'Near station' END AS bullet_2, {title} AS title,
 CASE WHEN doc_id%4=0 THEN CAST(514500+doc_id%1000 AS DOUBLE)/10000 END AS latitude,
 CASE WHEN doc_id%4=0 THEN CAST((doc_id%700)*4-2000 AS DOUBLE)/10000 END AS longitude
FROM documents"""


@_view("available_raws", "documents")
def _available_raws(d: Any) -> str:
    raw = pick(
        "doc_id%26", "Available from: 15th May 2026", "now", "Available From ASAP", "tbc", "2026-05-07", "2026/13/40",
        "7/5/2026", "07-05-2026", "31/02/2026", "1st of June 2026", "June 3 2026", "june 2027", "3 jan", "12 dec",
        "30 feb 2026", "sept 2026", "available soon", "", None, "  Available   from  :  2nd   of  August  ", "ask agent",
        "29 feb", "5 May 2026.", "immediately", "available  now", "01 sep",
    )
    return f"SELECT doc_id, {raw} AS raw FROM documents"


@_view("labelled", "labels", "documents")
def _labelled(d: Any) -> str:
    return f"""
SELECT CAST(l.doc_id AS STRING) AS uid, {pick('l.quality*2+l.toxic', 'worse', 'bad', 'best', 'good')} AS tier,
 CASE WHEN l.doc_id%10=0 THEN NULL WHEN l.doc_id%10=1 THEN '   ' ELSE x.text||{pick('l.doc_id%13', ' basement', ' too dark',
 ' carpets in both', ' small ceiling', ' no privacy', ' kitchen small', ' bad layout', ' high floor', ' let agreed',
 ' not enough photos', ' studio', ' carpet everywhere', '')} END AS reasoning,
 CAST(l.doc_id%17 AS INT) AS position, CAST(1+l.doc_id%3 AS INT) AS session_id,
 CASE WHEN l.doc_id%37=0 THEN NULL ELSE CAST(x.n_chars%101 AS INT) END AS score, l.quality AS quality, l.toxic AS toxic,
 CASE l.doc_id%7 WHEN 0 THEN NULL WHEN 1 THEN 'already' ELSE 'new' END AS listing_state, x.n_chars AS n_chars
FROM labels l JOIN documents x ON x.doc_id=l.doc_id"""


@_view("scored_pairs", "labels")
def _scored_pairs(d: Any) -> str:
    return """
SELECT doc_id, CASE WHEN doc_id%2=0 THEN CAST((doc_id*37)%101 AS DOUBLE) ELSE CAST((doc_id*37)%101 AS DOUBLE)/100 END AS score,
 quality AS label FROM labels"""


@_view("photo_predictions", "lineitem")
def _photo_predictions(d: Any) -> str:
    room = pick("min(l_partkey)%8", "bedroom", "living-room", "kitchen", "bathroom", "hallway", "dining-room", "other", None)
    return f"""
SELECT CAST(l_orderkey AS STRING) AS uid, CAST(l_linenumber AS INT) AS photo_idx, {room} AS room_type,
 CASE WHEN min(l_suppkey)%11=0 THEN NULL ELSE min(l_suppkey)%2=0 END AS carpet,
 CASE WHEN min(l_suppkey)%11=0 THEN NULL ELSE CAST(floor(min(l_discount)*1000) AS BIGINT) END AS confidence_milli,
 CAST(min(l_quantity) AS INT)%3=0 AS has_carpet_truth,
 {pick("min(l_partkey+l_suppkey)%7", "bedroom", "living-room", "kitchen", "bedroom", "hallway", "dining-room", "other")} AS room_truth,
 CASE WHEN min(l_suppkey)%3=0 THEN 'b'||CAST(min(l_partkey)%2 AS STRING) END AS bedroom_slug,
 CASE WHEN l_orderkey%5=0 THEN NULL ELSE CAST(l_orderkey%4 AS INT) END AS bedrooms_declared
FROM lineitem GROUP BY l_orderkey, l_linenumber"""


@_view("calls", "lineitem")
def _calls(d: Any) -> str:
    return f"""
SELECT {pick('l_suppkey%3', 'baseline', 'small_image', 'short_prompt')} AS variant,
 {pick('l_suppkey%2', 'model_x', 'model_y')} AS model,
 CAST(l_orderkey AS STRING) AS uid, CAST(l_linenumber AS INT) AS photo_idx, CAST(l_partkey%3 AS INT) AS repeat_idx,
 CASE WHEN l_partkey%31=0 THEN NULL ELSE CAST(l_quantity AS BIGINT)*100+l_partkey%100 END AS latency_ms,
 l_partkey%29<>0 AS parse_success, l_partkey%23=0 AS missing_keys, l_partkey%19=0 AS wrong_types,
 {pick('l_partkey%5', 'bedroom', 'living-room', 'kitchen', 'hallway', 'other')} AS room_type,
 CASE WHEN l_partkey%37=0 THEN NULL ELSE (l_partkey+l_orderkey)%3=0 END AS carpet,
 CASE WHEN l_partkey%29=0 THEN CASE l_suppkey%3 WHEN 0 THEN 'http_error:500' WHEN 1 THEN 'timeout' ELSE 'http_error:503' END END AS failure_class
FROM lineitem"""


@_view("centroids", "nation")
def _centroids(d: Any) -> str:
    return """
SELECT n_name AS name, CAST(514500+n_nationkey*80 AS DOUBLE)/10000 AS lat, CAST(n_nationkey*110-2000 AS DOUBLE)/10000 AS lng,
 CAST(n_nationkey AS INT) AS ord FROM nation"""


@_view("stations", "supplier")
def _stations(d: Any) -> str:
    return f"""
SELECT s_name AS station, CAST(514500+((s_suppkey*37)%1000)*2 AS DOUBLE)/10000 AS lat,
 CAST(((s_suppkey*53)%700)*4-2000 AS DOUBLE)/10000 AS lng,
 {pick('s_suppkey%5', '2', '2+3', 'Zone 4/5', '', None)} AS zone_text
FROM supplier"""


@_view("postcode_lookup", "customer")
def _postcode_lookup(d: Any) -> str:
    return f"""
SELECT 'N'||CAST(1+c%20 AS STRING)||CAST({d.idiv('c', 20)}%10 AS STRING)||substr('ABDEFGHJLN',CAST(1+{d.idiv('c', 200)}%10 AS INT),1)||'B' AS postcode_key,
 min(CASE WHEN c%4=0 OR c%3=1 THEN NULL ELSE CAST(514500+c%2000 AS DOUBLE)/10000 END) AS lat,
 min(CASE WHEN c%4=0 OR c%3=1 THEN NULL ELSE CAST(c%700-200 AS DOUBLE)/10000 END) AS lng,
 min(CASE WHEN c%8=0 THEN CAST(514000+c%2000 AS DOUBLE)/10000 END) AS hist_lat,
 min(CASE WHEN c%8=0 THEN CAST(c%700-100 AS DOUBLE)/10000 END) AS hist_lng
FROM (SELECT c_custkey AS c FROM customer) t GROUP BY 1"""


@_view("travel_times", "lineitem")
def _travel_times(d: Any) -> str:
    return f"""
SELECT CAST(l_orderkey AS STRING) AS origin, {pick('l_linenumber%3', 'hub_one', 'hub_two', 'hub_three')} AS destination,
 CASE WHEN l_partkey%5=0 THEN 'cycle' ELSE 'public' END AS mode,
 CASE WHEN l_suppkey%13=0 THEN NULL ELSE CAST(5+(l_partkey+l_suppkey)%70 AS INT) END AS minutes
FROM lineitem"""


@_view("certificates", "customer")
def _certificates(d: Any) -> str:
    return f"""
SELECT CAST(c*3+j AS BIGINT) AS cert_id,
 'N'||CAST(1+c%20 AS STRING)||' '||CAST({d.idiv('c', 20)}%10 AS STRING)||substr('ABDEFGHJLN',CAST(1+{d.idiv('c', 200)}%10 AS INT),1)||'B' AS postcode,
 CASE j WHEN 0 THEN CAST(1+c%40 AS STRING)||' '||{pick('c%4', 'Mill Lane', 'Old Street', 'Park Road', 'High Road')}
        WHEN 1 THEN 'Flat '||CAST(1+c%9 AS STRING)||', '||CAST(1+c%40 AS STRING)||'a '||{pick('c%4', 'Mill Lane', 'Old Street', 'Park Road', 'High Road')}
        ELSE CAST(2+c%40 AS STRING)||' '||{pick('c%4', 'Mill Lane', 'Old Road', 'Park Street', 'High Road')} END AS address1,
 CASE WHEN j=1 THEN '' ELSE {pick('c%3', 'Islington', None, 'Camden')} END AS address2,
 CASE WHEN c%2=0 THEN 'London' END AS address3,
 substr('ABCDEFG',CAST(1+(c+j)%7 AS INT),1) AS rating,
 CASE WHEN (c+j)%9=0 THEN 'n/a' WHEN (c+j)%9=1 THEN NULL ELSE CAST(30+(c*7+j)%90 AS STRING)||'.5' END AS floor_area_text,
 CASE WHEN (c+j)%8=0 THEN 'x' ELSE CAST(1+(c*3+j)%100 AS STRING) END AS efficiency_text,
 CASE WHEN (c+j)%6=0 THEN NULL ELSE CAST(1+(c*5+j)%100 AS STRING) END AS potential_text,
 {pick('c%5', 'Mid-Terrace', 'Detached', None, '', 'Semi-Detached')} AS built_form,
 '20'||CAST(10+(c+j*5)%15 AS STRING)||'-0'||CAST(1+(c+j)%9 AS STRING)||'-15' AS lodgement_date
FROM (SELECT c_custkey AS c, 0 AS j FROM customer UNION ALL SELECT c_custkey, 1 FROM customer
      UNION ALL SELECT c_custkey, 2 FROM customer) a"""


@_view("size_sources", "orders")
def _size_sources(d: Any) -> str:
    return """
SELECT CAST(o_orderkey AS STRING) AS uid,
 CASE WHEN o_orderkey%3=0 THEN CAST(60+(o_orderkey*11)%1200 AS INT) END AS structured,
 CASE WHEN o_orderkey%4=0 THEN CAST(80+(o_orderkey*13)%1500 AS INT) END AS nlp,
 CASE WHEN o_orderkey%2=0 THEN CAST(50+(o_orderkey*7)%900 AS INT) END AS floorplan_vision,
 CASE WHEN o_orderkey%5=0 THEN CAST(50+(o_orderkey*17)%900 AS INT) END AS epc_interpolated,
 CASE WHEN o_orderkey%7<>0 THEN CAST(50+(o_orderkey*19)%900 AS INT) END AS epc_direct,
 CASE WHEN o_custkey%9=0 THEN NULL ELSE CAST(o_custkey%4 AS INT) END AS bedrooms,
 CASE WHEN o_orderkey%6=0 THEN NULL ELSE substr('ABCDEFGX',CAST(1+o_custkey%8 AS INT),1) END AS read_rating,
 CASE WHEN o_orderkey%9=0 THEN NULL ELSE CAST((o_custkey*7)%112-4 AS INT) END AS read_sap,
 CASE WHEN o_orderkey%4=1 THEN NULL ELSE CAST((o_custkey*7)%112+o_orderkey%11-6 AS INT) END AS read_potential_sap,
 CASE WHEN o_orderkey%5=1 THEN NULL ELSE substr('ABCDEFG',CAST(1+o_orderkey%7 AS INT),1) END AS read_potential_rating,
 CASE WHEN o_orderkey%3=1 THEN substr('ABCDEFG',CAST(1+o_orderkey%7 AS INT),1) WHEN o_orderkey%9=2 THEN '' END AS scraper_rating,
 CASE WHEN o_orderkey%4=1 THEN substr('ABCDEFG',CAST(1+o_custkey%7 AS INT),1) END AS text_rating,
 CASE WHEN o_orderkey%5<2 THEN substr('ABCDEFG',CAST(1+(o_custkey+1)%7 AS INT),1) END AS cert_rating
FROM orders"""


@_view("weights_log", "supplier")
def _weights_log(d: Any) -> str:
    return """
SELECT CAST(s_suppkey AS BIGINT) AS id,
 '{"price":0.'||CAST(20+s_suppkey%5 AS STRING)||',"carpet":0.25,"size":0.20,"bedrooms":0.10,"epc":0.05,"transport":0.10,"outside":0.0,"region_pref":0.05}' AS weights_json
FROM supplier"""


@_view("incoming", "orders")
def _incoming(d: Any) -> str:
    """A later crawl: some known listings with new values (and NULLs), some listings never seen before."""
    return f"""
SELECT CASE o_orderkey%3 WHEN 0 THEN 'portal_a' WHEN 1 THEN 'portal_b' ELSE 'portal_c' END||':'
        ||CAST(CASE WHEN o_orderkey%7=0 OR o_orderkey%4=3 THEN o_orderkey+9000000000 ELSE o_orderkey END AS STRING) AS uid,
 CASE o_orderkey%3 WHEN 0 THEN 'portal_a' WHEN 1 THEN 'portal_b' ELSE 'portal_c' END AS portal,
 CASE WHEN o_orderkey%5=0 THEN '' ELSE 'Crawl title '||CAST(o_orderkey AS STRING) END AS title,
 CASE WHEN o_orderkey%6=0 THEN NULL ELSE 'N1, crawl' END AS address,
 CASE WHEN o_orderkey%4=0 THEN NULL ELSE CAST(160000+(o_custkey*100)%90000 AS BIGINT) END AS price_numeric,
 CASE WHEN o_orderkey%9=0 THEN 0 WHEN o_orderkey%9=1 THEN NULL ELSE CAST(1+o_custkey%3 AS INT) END AS bedrooms,
 CASE WHEN o_orderkey%8=0 THEN NULL ELSE CAST(400+o_custkey%300 AS INT) END AS size_sqft,
 CASE WHEN o_orderkey%10=0 THEN NULL ELSE substr('ABCDEFG',CAST(1+o_custkey%7 AS INT),1) END AS epc_rating,
 CASE WHEN o_orderkey%3=0 THEN NULL ELSE o_custkey%2=0 END AS garden,
 CASE WHEN o_orderkey%11=0 THEN NULL ELSE CAST(o_custkey%101 AS INT) END AS score,
 CASE WHEN o_orderkey%13=0 THEN '' ELSE '["https://i.test/new.jpg"]' END AS images,
 CASE WHEN o_orderkey%12=0 THEN NULL ELSE CAST(o_custkey%5 AS INT) END AS tfl_zone
FROM orders"""


@_view("discoveries", "lineitem")
def _discoveries(d: Any) -> str:
    """Search results: one row per (profile, position); the same listing turns up in several profiles."""
    return f"""
SELECT {pick('l_suppkey%4', 'north', 'east', 'south', 'west')} AS profile, CAST(l_orderkey AS STRING) AS property_id,
 CAST(l_orderkey*10+l_linenumber AS BIGINT) AS pos, min(l_partkey) AS tie
FROM lineitem GROUP BY 1, 2, 3"""


@_view("outcomes", "orders")
def _outcomes(d: Any) -> str:
    return f"""
SELECT CAST(o_orderkey AS STRING) AS uid, CASE o_orderkey%3 WHEN 0 THEN 'portal_a' WHEN 1 THEN 'portal_b' ELSE 'portal_c' END AS portal,
 o_orderkey%6<>0 AS success,
 CASE WHEN o_orderkey%6=0 THEN {pick('o_custkey%4', 'timeout: 30s', 'http_error:503', 'parse_error: no block', None)} END AS error,
 {pick('o_custkey%6', 'saved', 'touched', 'failed', 'filtered1', 'filtered2', 'saved')} AS outcome,
 CASE o_custkey%6 WHEN 3 THEN {pick('o_orderkey%3', 'price', 'epc', 'bedrooms')} WHEN 4 THEN {pick('o_orderkey%2', 'size_sqft', 'let_agreed')} END AS drop_rule
FROM orders"""


@_view("labelled_pairs", "listings")
def _labelled_pairs(d: Any) -> str:
    """Labelled pairs of neighbours on the price line of one block, so both verdicts occur."""
    return """
SELECT uid_a, uid_b, CASE WHEN (price_numeric - price_before) * 30 <= price_before OR CAST(property_id AS BIGINT)%7=0 THEN 'duplicate' ELSE 'distinct' END AS label
FROM (SELECT uid AS uid_b, property_id, price_numeric, lag(uid) OVER (PARTITION BY bedrooms, postcode ORDER BY price_numeric, uid) AS uid_a,
       lag(price_numeric) OVER (PARTITION BY bedrooms, postcode ORDER BY price_numeric, uid) AS price_before
      FROM listings WHERE bedrooms IS NOT NULL AND postcode IS NOT NULL AND price_numeric IS NOT NULL) t
WHERE uid_a IS NOT NULL"""


@_view("arrivals", "listings")
def _arrivals(d: Any) -> str:
    """One newly crawled advert per known listing, with a slightly drifted price."""
    return """
SELECT 'new:'||uid AS uid, portal, postcode, bedrooms, price_numeric + (CAST(property_id AS BIGINT)%5)*1500 AS price_numeric, latitude, longitude,
 first_seen, last_scraped FROM listings"""


@_view("listing_labels", "orders")
def _listing_labels(d: Any) -> str:
    return f"""
SELECT CASE o_orderkey%3 WHEN 0 THEN 'portal_a' WHEN 1 THEN 'portal_b' ELSE 'portal_c' END||':'||CAST(CASE WHEN o_orderkey%31=0 THEN o_orderkey+9000000000 ELSE o_orderkey END AS STRING) AS uid,
 CAST(1+o_custkey%3 AS INT) AS session_id, CAST(o_orderkey%50 AS INT) AS position,
 {pick('(o_orderkey*7+o_custkey)%9', 'best', 'good', 'bad', 'worse', 'best', 'good', 'bad', 'worse', 'unsure')} AS tier,
 {pick('o_orderkey%8', 'Nice but basement', 'too dark', None, '', 'carpets in both rooms', 'bad layout, no door', 'lovely', '  let agreed already ')} AS reasoning
FROM orders"""


def _page_text(template: str) -> str:
    """SQL text from a template: ``<<expr>>`` inserts a whole-number expression, a backslash is spelled chr(92)."""
    out = template.replace("'", "''").replace("\\", "'||chr(92)||'")
    return "'" + out.replace("<<", "'||CAST(").replace(">>", " AS STRING)||'") + "'"


PAGE_PARTS = [  # (condition on p = page_id, or None for every page; text)
    ("p%3=0 AND p%33<>0", '<script id="__ZAD_TARGETING__" type="application/json">{"listing_id":"<<p>>","display_address":"<<p%90+1>> Foo Road, Hackney",'
     '"outcode":"n7","incode":"<<p%9>>ab","num_beds":"<<p%4>>","num_baths":1,"price_actual":<<1500+p>>,"property_type":"flat",'
     '"furnished_state":"part_furnished","size_sq_feet":"<<400+p>>"}</script>'),
    ("p%33=0", '<script id="__ZAD_TARGETING__" type="application/json">{broken</script>'),
    ("p%8=1", '<script type="application/ld+json">{"@type":"BreadcrumbList","name":"crumbs"}</script>'),
    ("p%4<>0", '<script data-x="1" type="application/ld+json">{"@type":"RealEstateListing","name":"Ld name <<p>>, N1","description":"<b>Bright</b> flat &amp; &quot;roomy  home&quot; <i><<p%3>></i> bathroom",'
     '"offers":{"price":"<<1900+p>>","availability":"https://schema.org/InStock"}}</script>'),
    ("p%20=4", '<script type="application/ld+json">{"@type":"RealEstateListing","offers":{"availability":"https://schema.org/SoldOut"}}</script>'),
    ("p%2=0", '<script>push("{\\"displayAddress\\":\\"<<p%50+1>> Hyd Street, Camden\\",\\"outcode\\":\\"e8\\",\\"numBedrooms\\":<<1+p%3>>,\\"numBathrooms\\":<<1+p%2>>,'
     '\\"latitude\\":51.<<5000+p>>,\\"longitude\\":-0.<<1000+p>>,\\"furnished_state\\":\\"unfurnished\\",\\"label\\":\\"£<<1+p%3>>,<<100+p%800>> pcm\\"}")</script>'),
    ("p%2=1 AND p%5<>0", '<script>{"displayAddress":"<<p%50+1>> Plain Row","outcode":"w1","incode":"1aa","numBeds":<<p%5>>,"numBaths":1,"latitude":51.<<4000+p>>,"longitude":0.<<1000+p>>}</script>'),
    ("p%6=0", '<script>"\\"bullets\\":[\\"Private garden\\",\\"EPC rating C\\",\\"<<500+p>> sq ft\\",\\"Gas \\u0026 water\\"]"</script>'),
    ("p%3<>1", '<script>\\"filename\\":\\"<<h>>aaaaaaaa.jpg\\",\\"filename\\":\\"<<h>>bbbbbbbb.png\\",\\"filename\\":\\"<<h>>aaaaaaaa.jpg\\"</script>'),
    ("p%3=1", '<img src="/u/480/360/<<h>>cccccccc.jpeg"><img src="/u/1024/768/<<h>>dddddddd.webp"><img src="/u/480/360/<<h>>cccccccc.jpeg">'),
    ("p%9=0", '<script>\\"epc\\":{\\"image\\":[{\\"caption\\":\\"EPC\\",\\"filename\\":\\"<<h>>bbbbbbbb.png\\"}]},\\"epcRating\\":\\"C\\"</script>'),
    ("p%9=1", '<script>"epc":{"image":[{"caption":"EPC","filename":"<<h>>eeeeeeee.jpg"}]},"epcRating":"E"</script>'),
    ("p%9=2", '<script>"epc":{"image":null}</script><img src="https://media2.rightmove.co.uk/dir/<<p>>_EPCGRAPH_00.png">'),
    ("p%7=0", '<script>\\"floorPlan\\":[{\\"original\\":\\"https://lc.zoocdn.com/<<p>>.pdf\\"}]</script>'),
    ("p%7=1", '<script>\\"floorPlan\\":{\\"image\\":[{\\"x\\":1,\\"filename\\":\\"<<h>>ffffffff.jpg\\"}]}</script>'),
    ("p%7=2", '<script>\\"floorPlan\\":[{\\"original\\":\\"https://www.foxtons.co.uk/<<p>>/large_floorplan.jpg\\"}]</script>'),
    ("p%7=3", '<a href="https://media.rightmove.co.uk/property-floorplan/<<p>>.gif">plan</a><a href="https://media.rightmove.co.uk/property-floorplan/<<p>>.gif">plan</a>'),
    ("p%4=1", '<script>var PROPERTYIDS = [<<p>>, x, <<p+1000>>, -4];\nvar PROPERTYLISTLATITUDES = [51.<<5000+p>>, bad, 51.6, 51.7];\nvar PROPERTYLISTLONGITUDES = [-0.1, -0.<<1000+p>>];'
     'var NUMBEROFPROPERTIES = <<p*3>>; var PROPERTYBYID = {<<p>> : 0, <<p+1000>> : 1, oops : 2, 7 : z};</script>'),
    (None, '<a href="/to-rent/details/<<p+100>>/">a</a><a href="/to-rent/details/<<p%7>>">b</a><a href="/to-rent/details/<<p+100>>/">a</a>'),
    ("p%2=0", '<a href="/properties/<<p+5>>#/">c</a><a href="/properties/<<p%3>>">d</a>'),
    ("p%2=1", '<table><tr><td>Rent PCM</td><td>£<<1+p%2>>,<<100+p>>.50</td></tr><tr><td>Deposit</td><td>£<<500+p>></td></tr><tr class="r"><td>Garden</td><td><svg class="icon text-success"></svg></td></tr>'
     '<tr><td>Parking</td><td><svg class="icon text-danger"></svg></td></tr><tr><td>Fireplace</td><td><svg class="icon"></svg></td></tr><tr><td>EPC Rating</td><td>D</td></tr><tr><td>EPC Rating</td><td>B</td></tr>'
     '<tr><td>Furnishing</td><td> Furnished </td></tr><tr><td>Available From</td><td>0<<1+p%9>> June, 2026</td></tr><tr><td>Bills Included</td><td><svg class="text-danger"></svg></td></tr>'
     '<tr><td>Pets Allowed</td><td><svg class="text-success"></svg></td></tr><tr><td>one</td><td>two</td><td>three</td></tr></table>'),
    ("p%5=0", '<span data-testid="price">£<<1+p%4>>,<<100+p>> pcm</span>'),
    ("p%5=1", '<div data-testid="property-details">A <<p%4>> bedroom home, <<1+p%2>> bathroom, part furnished</div>'),
    ("p%5=2", '<div data-testid="property-details">Unfurnished, <<p%4>> bedroom</div>'),
    ("p%5=3", '<ul data-testid="property-features"><li>Garden <<p>></li><li>ok</li><li> Lift </li><li>Lift</li></ul>'),
    ("p%5=4", '<div data-testid="property-description">Lovely   flat number <<p>> close to shops</div><a data-testid="agent-phone" href="x">Tel: +44 (20) 7946-<<1000+p>></a>'),
    ("p%6=1", '<script>window.__PAGE_MODEL = {"data":"[{\\"propertyData\\":1},{\\"status\\":2,\\"displayStatus\\":5,\\"lettings\\":6,\\"bedrooms\\":7},{\\"published\\":3,\\"archived\\":4},true,false,\\"For rent\\",{\\"letAgreed\\":3},<<p%5>>]","encoding":"on"};</script>'),
    ("p%6=3", '<script>window.__PAGE_MODEL = {"data":"[{\\"propertyData\\":1},{\\"status\\":2,\\"displayStatus\\":5},{\\"published\\":4,\\"archived\\":4},true,false,\\"Let Agreed\\"]","encoding":"on"};</script>'),
    ("p%6=5", '<script>window.PAGE_MODEL = {"propertyData":{"status":{"published":true,"archived":<<p%1>>},"bedrooms":<<p%5>>}};</script>'),
    ("p%17=0", "<p>Sorry, this listing has been Removed.</p>"),
    ("p%19=0", '<div class="galleryBadge x"> Now  let </div>'),
    ("p%23=0", '<div class="alert alert-warning"><b>Let Agreed</b></div>'),
    ("p%3=2", '<section><h2>London, N<<p%20>></h2><span>Angel</span><span>7 min walk</span><span>Bank</span><span>Oval</span><span><<p%30>> mins</span><span>9 mins</span></section>'),
    ("p%3=2", '<div class="swiper-slide"><img alt="" src="//imagescdn.openrent.co.uk/listings/<<p>>/1.jpg"></div><div class="swiper-slide"><img src="https://cdn.test/x.jpg"></div>'),
    ("p%12=0", '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"searchResults":{"properties":[{"id":<<p+1>>,"propertyUrl":"/properties/<<p+1>>#x"},{"propertyId":"<<p+2>>"},{"other":1}],"resultCount":"1,234"}}}}</script>'),
    ("p%3=2", '<section><h2>About This Property</h2><p>Quiet  <<1+p%3>>-bathroom flat <<p>>, private garden</p></section>'),
    ("p%4=2", '<img src="https://media.rightmove.co.uk/property-photo/<<p>>/1.jpg"><img src="https://media.rightmove.co.uk/logo.png"><img data-src="https://media.rightmove.co.uk/property-photo/<<p>>/1.jpg">'),
    ("p%10=3", '<iframe src="https://maps.test/embed?zoom=3&q=51.<<5000+p>>,-0.12"></iframe>'),
    ("p%10=7", "<p>at 48.8566,2.3522 or 51.<<50000+p>> , -0.<<10000+p>></p>"),
]


@_view("listing_pages", "pages")
def _listing_pages(d: Any) -> str:
    """The given pages, whole, with listing markup of three portals added before and after."""
    title = pick("p%5", "3 bedroom flat to rent in Foo Road, N7 | Site", "Studio apartment for rent in Bar Street",
                 "2 bed maisonette let agreed in Quux Lane, E8 6AB", "Office unit", "1 Bedroom House To Rent in  Baz Way,  n19 3jq , | Site")
    h1 = pick("p%4", "2 Bed Flat, Camden Road, NW1", "Studio, Old Street, EC1V", "1 Bed Flat, Somewhere", "Room in a Shared House, SW1A")
    tail = "||".join(f"CASE WHEN {cond} THEN {_page_text(text)} ELSE '' END" if cond else _page_text(text) for cond, text in PAGE_PARTS)
    tail = tail.replace("CAST(h AS STRING)", "h")
    return f"""
SELECT p AS page_id, {pick('p%3', 'portal_b', 'portal_a', 'portal_c')} AS portal, url,
 'https://b.test/to-rent/details/'||CAST(p AS STRING)||'/' AS requested_url,
 CASE WHEN p%13=0 THEN 'https://b.test/to-rent/search' WHEN p%13=1 THEN 'https://b.test/to-rent/details/'||CAST(p+1 AS STRING)||'/'
  WHEN p%13=2 THEN NULL ELSE 'https://b.test/to-rent/details/'||CAST(p AS STRING)||'/?x=1' END AS final_url,
 {title} AS listing_title, '<title>'||{title}||'</title><h1>'||{h1}||'</h1>'||html||{tail} AS html
FROM (SELECT page_id AS p, url, html, md5(CAST(page_id AS STRING)) AS h FROM pages) t"""


def view_names() -> list[str]:
    return list(_VIEWS)


def _ordered(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(name: str) -> None:
        if name in out or name in BASE_TABLES:
            return
        for dep in _VIEWS[name][0]:
            visit(dep)
        out.append(name)

    for n in names:
        visit(n)
    return out


def oracle(body: str, *views: str, ctes: str = "", recursive: bool = False) -> str:
    """Prefix ``body`` with the CTEs of the named views (and extra ``ctes``) for the checking engine."""
    parts = [f"{n} AS ({_VIEWS[n][1](Duck)})" for n in _ordered(list(views))]
    if ctes:
        parts.append(ctes.strip().rstrip(","))
    if not parts:
        return body
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + body


class Tables:
    """Attribute access to base tables and adapter views of one data folder, all lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in _VIEWS:
            deps, build = _VIEWS[name]
            for dep in deps:
                getattr(self, dep).createOrReplaceTempView(dep)
            return self.spark.sql(build(Spark))
        raise AttributeError(name)
