"""Page extraction, checked column group by column group."""

from __future__ import annotations

from pyspark.sql import functions as F

from proplake.functions import text as X
from proplake.operators import extract as P
from proplake.plans.registry import query


def q(pattern: str) -> str:
    return pattern.replace("'", "''")


def x(pattern: str, group: int = 1, source: str = "html") -> str:
    return f"nullif(regexp_extract({source},'{q(pattern)}',{group}),'')"


def every(pattern: str, source: str = "html", group: int = 1) -> str:
    return f"regexp_extract_all({source},'{q(pattern)}',{group})"


def distinct(items: str) -> str:
    """Distinct list in first-seen order."""
    return f"list_filter({items}, lambda v, i: list_position({items}, v)=i)"


def joined(c) -> F:
    return F.array_join(c, ",")


TARGET = f"trim({x(P.TARGETING_SCRIPT)})"
LD = f"list_filter({every(P.LD_SCRIPT)}, lambda v: json_valid(v) AND json_extract_string(v,'$.\"@type\"')='RealEstateListing')[1]"
SCRIPTS = f"""
scripts AS (SELECT *, CASE WHEN json_valid({TARGET}) THEN {TARGET} END AS target, {LD} AS ld, {x(P.MODEL_SCRIPT)} AS model FROM listing_pages)"""


@query("page_ids", f"""
SELECT page_id, source, pos, property_id FROM (SELECT page_id, 'portal_b' AS source, unnest(ids) AS property_id, generate_subscripts(ids,1)-1 AS pos FROM (SELECT page_id, {distinct(every(P.DETAIL_ID))} AS ids FROM listing_pages)
 UNION ALL SELECT page_id, 'portal_a', unnest(ids), generate_subscripts(ids,1)-1 FROM (SELECT page_id, CASE WHEN page_id%12=0 THEN [CAST(page_id+1 AS STRING), CAST(page_id+2 AS STRING)] ELSE {distinct(every(P.PROPERTY_ID))} END AS ids FROM listing_pages))""", "listing_pages")
def page_ids(t):
    return P.page_ids(t.listing_pages)


@query("listing_uid", """
SELECT uid, CASE WHEN url LIKE 'https://a.%' THEN 'portal_a:'||property_id WHEN url LIKE 'https://b.%' THEN 'portal_b:'||property_id END AS url_uid FROM listings""", "listings")
def listing_uid(t):
    return t.listings.select("uid", P.listing_uid(F.col("url")).alias("url_uid"))


@query("first_discovery", """
SELECT property_id, profile, pos FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY profile, pos) AS rn FROM discoveries) WHERE rn=1""", "discoveries")
def first_discovery(t):
    return P.first_discovery(t.discoveries)


TITLE = f"nullif(trim({x('<title>([^<]+)</title>')}),'')"


def kind(t: str) -> str:
    return f"lower(coalesce({x('(?i)bedroom\\s+(' + P.TITLE_TYPES + ')', 1, t)},{x('(?i)(\\d+)\\s*bed\\s+(' + P.TITLE_TYPES + ')', 2, t)},{x('(?i)(' + P.TITLE_TYPES + ')', 1, t)}))"


HEAD = f"nullif(trim(regexp_replace({x('<h1[^>]*>([\\s\\S]*?)</h1>')},'<[^>]+>','','g')),'')"


@query("page_title_fields", f"""
SELECT page_id, title, TRY_CAST({x('(?i)(\\d+)\\s*bedroom', 1, 'title')} AS INT) AS title_bedrooms, {kind('title')} AS title_type, nullif(trim({x('(?i)' + P.TITLE_PLACE, 1, 'title')}),'') AS title_address,
 head AS heading, coalesce(TRY_CAST({x('(?i)\\b(\\d+)\\s*Bed\\b', 1, 'head')} AS INT), CASE WHEN regexp_matches(head,'(?i)\\bStudio\\b') THEN 0 END) AS heading_bedrooms, {x(P.OUTCODE_AT_END, 1, 'head')} AS outcode
FROM (SELECT page_id, {TITLE} AS title, {HEAD} AS head FROM listing_pages)""", "listing_pages")
def page_title_fields(t):
    html = F.col("html")
    titled = t.listing_pages.withColumn("title", P.page_title(html))
    columns = {**P.title_fields(F.col("title")), **P.heading_fields(html)}
    return titled.select("page_id", "title", *[c.alias(n) for n, c in columns.items()])


@query("page_embedded_json", """
SELECT page_id, json_extract_string(target,'$.display_address') AS display_address, json_extract_string(target,'$.num_beds') AS num_beds, json_extract_string(target,'$.price_actual') AS price_actual,
 json_extract_string(ld,'$.name') AS ld_name, json_extract_string(ld,'$.offers.price') AS offer_price, json_extract_string(model,'$.propertyData.bedrooms') AS model_bedrooms FROM scripts""", "listing_pages", ctes=SCRIPTS)
def page_embedded_json(t):
    return P.with_scripts(t.listing_pages).select(
        "page_id", "targeting.display_address", "targeting.num_beds", "targeting.price_actual", F.get_json_object("ld", "$.name").alias("ld_name"),
        F.get_json_object("ld", "$.offers.price").alias("offer_price"), F.get_json_object("model", "$.propertyData.bedrooms").alias("model_bedrooms"))


@query("page_dehydrated_json", """
SELECT page_id, CASE WHEN page_id%6=1 THEN 'true' WHEN page_id%6=3 THEN 'false' END AS published, CASE WHEN page_id%6 IN (1,3) THEN 'false' END AS archived,
 CASE WHEN page_id%6=1 THEN 'For rent' WHEN page_id%6=3 THEN 'Let Agreed' END AS display_status, CASE WHEN page_id%6=1 THEN 'true' END AS let_agreed FROM listing_pages""", "listing_pages")
def page_dehydrated_json(t):
    fields = P.dry_fields(F.col("dry"))
    return P.with_scripts(t.listing_pages).select("page_id", *[c.alias(n) for n, c in fields.items()])


def sql_list(name: str, kind: str, shape: str) -> str:
    body = f"string_split(regexp_extract(html,'var\\s+{name}\\s*=\\s*\\[([^\\]]*)\\]',1),',')"
    return f"list_transform(list_filter(list_transform({body}, lambda v: trim(v)), lambda v: regexp_full_match(v,'{shape}')), lambda v: CAST(v AS {kind}))"


@query("page_parallel_arrays", f"""
SELECT page_id, i AS pos, ids[i] AS property_id, lats[i] AS latitude, lngs[i] AS longitude FROM (SELECT page_id, ids, lats, lngs, unnest(range(1, least(len(ids),len(lats),len(lngs))+1)) AS i FROM (
 SELECT page_id, {sql_list('PROPERTYIDS', 'BIGINT', '-?\\d+')} AS ids, {sql_list('PROPERTYLISTLATITUDES', 'DOUBLE', '-?[\\d.]+')} AS lats, {sql_list('PROPERTYLISTLONGITUDES', 'DOUBLE', '-?[\\d.]+')} AS lngs FROM listing_pages))""", "listing_pages")
def page_parallel_arrays(t):
    rows = t.listing_pages.select("page_id", F.posexplode(P.script_points(F.col("html"))).alias("i", "p"))
    return rows.select("page_id", (F.col("i") + 1).cast("long").alias("pos"), "p.property_id", "p.latitude", "p.longitude")


@query("page_index_map", """
SELECT page_id, CASE WHEN page_id%4=1 THEN page_id*3 ELSE 0 END AS n_declared, CASE WHEN page_id%4=1 THEN CAST(page_id AS STRING)||'=0,'||CAST(page_id+1000 AS STRING)||'=1' ELSE '' END AS positions FROM listing_pages""", "listing_pages")
def page_index_map(t):
    pairs = F.transform(P.script_index(F.col("html")), lambda e: F.concat_ws("=", e["id"].cast("string"), e["position"].cast("string")))
    return t.listing_pages.select("page_id", P.script_count(F.col("html")).cast("long").alias("n_declared"),
                                  F.coalesce(joined(pairs), F.lit("")).alias("positions"))


def cell_text(cell: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({cell},'<[^>]+>'), lambda s: trim(s)), lambda s: s<>'')[1]"


GRID = f"""
cells AS (SELECT page_id, tds, n FROM (SELECT page_id, n, {every('<td[^>]*>([\\s\\S]*?)</td>', 'tr')} AS tds FROM (SELECT page_id, unnest(trs) AS tr, generate_subscripts(trs,1) AS n FROM (SELECT page_id, {every('<tr[^>]*>([\\s\\S]*?)</tr>')} AS trs FROM listing_pages))) WHERE len(tds)=2),
grid AS (SELECT page_id, n, {cell_text('tds[1]')} AS label, CASE WHEN contains(tds[2],'<svg') THEN CASE WHEN contains(tds[2],'text-success') THEN 'true' WHEN contains(tds[2],'text-danger') THEN 'false' END ELSE {cell_text('tds[2]')} END AS value FROM cells),
labels AS (SELECT page_id, label, arg_max(coalesce(value,'-'), n) AS value FROM grid GROUP BY page_id, label)"""


@query("page_label_grid", "SELECT page_id, label, value FROM labels", "listing_pages", ctes=GRID)
def page_label_grid(t):
    grid = P.label_grid(F.col("html"))
    rows = t.listing_pages.select("page_id", F.posexplode(grid).alias("i", "e"))
    return rows.groupBy("page_id", F.col("e.label").alias("label")).agg(F.max_by(F.coalesce("e.value", F.lit("-")), "i").alias("value"))


CHART = f"coalesce('{P.PHOTO_BASE}'||{x(P.CERT_NAME[0])},'{P.PHOTO_BASE}'||{x(P.CERT_NAME[1])},{x(P.CERT_MEDIA)})"
NAMES = f"CASE WHEN len({every(P.PHOTO_NAME)})>0 THEN {distinct(every(P.PHOTO_NAME))} ELSE {distinct(every(P.PHOTO_PATH))} END"
IMG = r'<img[^>]*?(?:data-)?src="([^"]*)"'
GALLERY = f"list_filter({every(IMG)}, lambda u: contains(u,'property-photo') AND contains(u,'rightmove.co.uk'))"


@query("page_bullets_photos", f"""
SELECT page_id, coalesce(array_to_string(list_transform({every(P.BULLET, f"regexp_extract(html,'{P.BULLETS}',1)")}, lambda b: replace(replace(b,'\\u0026','&'),chr(92)||'"','"')),'|'),'') AS bullets,
 array_to_string(list_filter(list_transform({NAMES}, lambda n: '{P.PHOTO_BASE}'||n), lambda u: u<>coalesce({CHART},'')),',') AS photos, array_to_string({distinct(GALLERY)},',') AS gallery,
 coalesce(array_to_string(list_filter(list_transform({every('<div class="swiper-slide"><img[^>]*?src="([^"]*)"')}, lambda u: CASE WHEN starts_with(u,'//') THEN 'https:'||u ELSE u END), lambda u: contains(u,'{P.LISTING_IMAGE}')),','),'') AS slides FROM listing_pages""", "listing_pages")
def page_bullets_photos(t):
    html = F.col("html")
    return t.listing_pages.select(
        "page_id", F.coalesce(F.array_join(P.bullets(html), "|"), F.lit("")).alias("bullets"), joined(P.photo_urls(html)).alias("photos"),
        joined(P.gallery_urls(html)).alias("gallery"), joined(P.slide_urls(html)).alias("slides"))


@query("page_floorplans", f"""
SELECT page_id, array_to_string(list_filter({distinct(f"list_concat(list_concat({every(P.PLAN_URL)},list_transform({every(P.PLAN_NAME)}, lambda n: '{P.PLAN_BASE}'||n)),{every(P.PLAN_MEDIA)})")},
  lambda u: regexp_matches(u,'^https?://(media2?\\.rightmove\\.co\\.uk|[^/]*\\.zoocdn\\.com)/') AND NOT regexp_matches(u,'{P.PLAN_WRAPPER}')),',') AS plans FROM listing_pages""", "listing_pages")
def page_floorplans(t):
    return t.listing_pages.select("page_id", joined(P.floorplan_urls(F.col("html"))).alias("plans"))


@query("page_cert_image_letter", f"SELECT page_id, {CHART} AS cert_image, coalesce({x(P.CERT_LETTER[0])},{x(P.CERT_LETTER[1])}) AS letter FROM listing_pages", "listing_pages")
def page_cert_image_letter(t):
    return t.listing_pages.select("page_id", P.cert_image(F.col("html")).alias("cert_image"), P.cert_letter(F.col("html")).alias("letter"))


def box(test_id: str) -> str:
    return x(rf'<[^>]*data-testid="{test_id}"[^>]*>([\s\S]*?)</(?:div|ul|section|span|a|p)>')


FACTS = f"lower(regexp_replace({box('property-details')},'<[^>]+>','','g'))"
PROSE = f"trim(regexp_replace(regexp_replace({box('property-description')},'<[^>]+>','','g'),'\\s+',' ','g'))"
ITEMS = f"list_filter(list_transform({every('<li[^>]*>([\\s\\S]*?)</li>', box('property-features'))}, lambda v: trim(regexp_replace(v,'<[^>]+>','','g'))), lambda v: length(v)>2 AND length(v)<100)"
PHONE = f"regexp_replace(trim({box('agent-phone')}),'[^\\d\\s+\\-()]','','g')"


@query("page_html_text_details", f"""
SELECT page_id, TRY_CAST({x('(\\d+)\\s*bedroom', 1, 'facts')} AS INT) AS text_bedrooms, TRY_CAST({x('(\\d+)\\s*bathroom', 1, 'facts')} AS INT) AS text_bathrooms,
 CASE WHEN contains(facts,'unfurnished') THEN 'Unfurnished' WHEN contains(facts,'furnished') THEN 'Furnished' END AS text_furnished,
 coalesce(CASE WHEN contains(priced,'£') THEN priced END, '£'||json_extract_string(ld,'$.offers.price')||' pcm') AS text_price, CASE WHEN length(prose)>20 THEN prose END AS text_description,
 coalesce(array_to_string(list_filter(items, lambda v, i: list_position(items, v)=i),','),'') AS text_features, CASE WHEN length(phone)>8 THEN phone END AS agent_phone
FROM (SELECT *, {FACTS} AS facts, trim({box('price')}) AS priced, {PROSE} AS prose, {ITEMS} AS items, {PHONE} AS phone FROM scripts)""", "listing_pages", ctes=SCRIPTS)
def page_html_text_details(t):
    columns = P.text_details()
    columns["text_features"] = F.coalesce(joined(columns["text_features"]), F.lit(""))
    return P.with_scripts(t.listing_pages).select("page_id", *[c.alias(n) for n, c in columns.items()])


ABOUT_RE = r"About This Property([\s\S]*?)</section>"
ABOUT = f"trim(regexp_replace(replace(replace(regexp_replace({x(ABOUT_RE)},'<[^>]+>',' ','g'),'&amp;','&'),'&quot;','\"'),'\\s+',' ','g'))"


@query("page_stations_and_prefs", f"""
SELECT p.page_id, CASE WHEN p.page_id%3=2 THEN 'Angel~7 min walk,Oval~'||CAST(p.page_id%30 AS STRING)||' mins' ELSE '' END AS stations, CASE WHEN l.value='true' THEN TRUE WHEN l.value='false' THEN FALSE END AS pets_allowed,
 nullif({ABOUT},'') AS about, TRY_CAST({x('(?i)(\\d+)[\\-\\s]?bathroom', 1, ABOUT)} AS INT) AS bathrooms FROM listing_pages p LEFT JOIN labels l ON l.page_id=p.page_id AND l.label='Pets Allowed'""", "listing_pages", ctes=GRID)
def page_stations_and_prefs(t):
    html = F.col("html")
    pairs = F.transform(P.stations(html), lambda s: F.concat_ws("~", s["station"], s["duration"]))
    about = P.about_text(html)
    return t.listing_pages.select("page_id", joined(pairs).alias("stations"), P.flag(P.label_value(P.label_grid(html), "Pets Allowed")).alias("pets_allowed"),
                                  about.alias("about"), P.about_bathrooms(about).alias("bathrooms"))


@query("map_portal_c", f"""
SELECT page_id, head AS title, head AS address, {x(P.OUTCODE_AT_END, 1, 'head')} AS area, CAST(NULL AS STRING) AS postcode, '£'||format('{{:,}}',rent)||' pcm' AS price, rent*100 AS price_numeric,
 coalesce(TRY_CAST({x('(?i)\\b(\\d+)\\s*Bed\\b', 1, 'head')} AS INT), CASE WHEN regexp_matches(head,'(?i)\\bStudio\\b') THEN 0 END) AS bedrooms, furnishing AS furnished, garden, bills AS bills_included, avail AS let_available_date, rating AS epc_rating
FROM (SELECT p.page_id, {HEAD} AS head, CAST(floor(CAST(replace(max(regexp_extract(l.value,'£\\s*([\\d,]+(?:\\.\\d+)?)',1)) FILTER (WHERE label='Rent PCM'),',','') AS DOUBLE)) AS BIGINT) AS rent,
  max(l.value) FILTER (WHERE label='Furnishing') AS furnishing, bool_or(l.value='true') FILTER (WHERE label='Garden') AS garden, bool_or(l.value='true') FILTER (WHERE label='Bills Included') AS bills,
  max(l.value) FILTER (WHERE label='Available From') AS avail, max(l.value) FILTER (WHERE label='EPC Rating') AS rating
  FROM listing_pages p LEFT JOIN labels l ON l.page_id=p.page_id WHERE p.portal='portal_c' GROUP BY p.page_id, p.html)""", "listing_pages", ctes=GRID)
def map_portal_c(t):
    return P.map_portal_c(t.listing_pages.filter("portal = 'portal_c'")).drop("bathrooms")


def text_value(key: str) -> str:
    return f"""coalesce({x(rf'\\"{key}\\":\\"((?:[^\\"]|\\\\.)*?)\\"')},{x(rf'"{key}":"((?:[^"\\]|\\.)*?)"')})"""


def number(key: str) -> str:
    return f"""coalesce({x(rf'\\"{key}\\":(-?[\d.]+)')},{x(rf'"{key}":(-?[\d.]+)')})"""


def of_target(key: str) -> str:
    return f"nullif(json_extract_string(target,'$.{key}'),'')"


CASCADE = f"""
cascade AS (SELECT page_id, coalesce({of_target('display_address')},{text_value('displayAddress')},json_extract_string(ld,'$.name')) AS address,
 upper(coalesce(o||' '||i, o)) AS postcode, coalesce(TRY_CAST({of_target('num_beds')} AS INT),TRY_CAST({number('numBedrooms')} AS INT),TRY_CAST({number('numBeds')} AS INT)) AS bedrooms,
 coalesce(TRY_CAST({of_target('num_baths')} AS INT),TRY_CAST({number('numBathrooms')} AS INT),TRY_CAST({number('numBaths')} AS INT)) AS bathrooms,
 coalesce(TRY_CAST({of_target('price_actual')} AS INT),TRY_CAST(replace({x(P.LABEL_PRICE)},',','') AS INT),TRY_CAST(json_extract_string(ld,'$.offers.price') AS INT)) AS price_pcm, {of_target('property_type')} AS property_type,
 CASE coalesce({of_target('furnished_state')},{text_value('furnished_state')}) WHEN 'part_furnished' THEN 'Part Furnished' WHEN 'unfurnished' THEN 'Unfurnished' END AS furnished,
 TRY_CAST({number('latitude')} AS DOUBLE) AS latitude, TRY_CAST({number('longitude')} AS DOUBLE) AS longitude, TRY_CAST({of_target('size_sq_feet')} AS INT) AS size_sqft,
 CAST(round_even(TRY_CAST({of_target('size_sq_feet')} AS INT)*0.0929::DOUBLE,0) AS INT) AS size_sqm,
 trim(regexp_replace(replace(replace(regexp_replace(json_extract_string(ld,'$.description'),'<[^>]+>',' ','g'),'&amp;','&'),'&quot;','"'),'\\s+',' ','g')) AS description
 FROM (SELECT *, coalesce({of_target('outcode')},{text_value('outcode')}) AS o, coalesce({of_target('incode')},{text_value('incode')}) AS i FROM scripts))"""


@query("page_source_cascade", "SELECT * FROM cascade", "listing_pages", ctes=SCRIPTS + ",\n" + CASCADE)
def page_source_cascade(t):
    return P.with_scripts(t.listing_pages).select("page_id", *[c.alias(n) for n, c in P.source_cascade().items()])


@query("page_liveness", """
SELECT page_id, CASE WHEN (final_url IS NOT NULL AND (NOT contains(final_url,'/to-rent/details/') OR regexp_extract(final_url,'/to-rent/details/(\\d+)',1)<>regexp_extract(requested_url,'/to-rent/details/(\\d+)',1)))
 OR contains(lower(html),'this listing has been removed') OR contains(lower(html),'no longer available') OR contains(lower(html),'longer on zoopla') OR (NOT contains(html,'"listing_id"') AND NOT contains(html,'ZAD_TARGETING')) THEN 'property_removed' END AS error FROM listing_pages""".replace("\\\\", "\\"), "listing_pages")
def page_liveness(t):
    return t.listing_pages.select("page_id", P.liveness(F.col("html"), F.col("requested_url"), F.col("final_url")).alias("error"))


@query("let_agreed_flag", f"""
SELECT page_id, regexp_matches({TITLE},'(?i)\\blet\\s*agreed\\b|\\bunder\\s*offer\\b|\\blet\\s*by\\b|\\bnow\\s*let\\b|\\btenanted\\b') AS by_title, page_id%6 IN (1,3) AS by_model,
 len(list_filter({every(P.BADGE)}, lambda b: regexp_matches(b,'{P.BADGE_TEXT}')))>0 AS by_badge,
 len(list_filter({every(P.LD_SCRIPT)}, lambda v: coalesce(NOT regexp_matches(lower(json_extract_string(v,'$.offers.availability')),'instock|in_stock'),FALSE)))>0 AS by_stock,
 coalesce(contains({x('<div class="alert alert-warning">([\\s\\S]*?)</div>')},'Let Agreed'),FALSE) AS by_banner FROM listing_pages""", "listing_pages")
def let_agreed_flag(t):
    return P.with_scripts(t.listing_pages).select("page_id", *[c.alias(n) for n, c in P.page_let_agreed().items()])


@query("html_to_text", """
SELECT page_id, md5(plain) AS digest, length(plain) AS n_chars FROM (SELECT page_id, trim(regexp_replace(replace(replace(regexp_replace(html,'<[^>]+>',' ','g'),'&amp;','&'),'&quot;','"'),'\\s+',' ','g')) AS plain FROM listing_pages)""".replace("\\\\", "\\"), "listing_pages")
def html_to_text(t):
    plain = X.html_to_text(F.col("html"))
    return t.listing_pages.select("page_id", F.md5(plain).alias("digest"), F.length(plain).cast("long").alias("n_chars"))


PCRE = r"(?i)\b([A-Z]{1,2}[0-9][A-Z0-9]?\s*[0-9][A-Z]{2})\b"


@query("postcode_extract", f"SELECT page_id, upper({x(PCRE, 1, 'listing_title')}) AS postcode, upper({x(PCRE)}) AS page_postcode FROM listing_pages", "listing_pages")
def postcode_extract(t):
    return t.listing_pages.select("page_id", X.first_postcode(F.col("listing_title")).alias("postcode"), X.first_postcode(F.col("html")).alias("page_postcode"))


@query("address_clean", f"""
SELECT page_id, trim(trim(trim(regexp_replace(regexp_replace(listing_title,'{PCRE}','','g'),'\\s{{2,}}',' ','g')),',')) AS address FROM listing_pages""", "listing_pages")
def address_clean(t):
    return t.listing_pages.select("page_id", X.clean_address(F.col("listing_title")).alias("address"))


@query("area_from_address", r"""
SELECT uid, CASE WHEN len(parts)>=2 THEN parts[-1] END AS area FROM (SELECT uid, list_filter(list_transform(string_split(trim(regexp_replace(address||coalesce(', '||postcode,''),'([A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2})','','g')),','), lambda s: trim(s)), lambda s: s<>'') AS parts FROM listings)""", "listings")
def area_from_address(t):
    full = F.concat("address", F.coalesce(F.concat(F.lit(", "), "postcode"), F.lit("")))
    return t.listings.select("uid", X.area_of(full).alias("area"))


NUM = r"(-?\d{1,3}\.\d+)"
JSON_PAIR = rf'"latitude"\s*:\s*{NUM}[\s\S]*?"longitude"\s*:\s*{NUM}'
MAP_PAIR = rf"[?&](?:q|center|ll)={NUM},{NUM}"
LOOSE = r"(-?\d{1,3}\.\d{4,})\s*,\s*(-?\d{1,3}\.\d{4,})"


def good(lat: str, lng: str) -> str:
    return f"(CAST({lat} AS DOUBLE) BETWEEN 51.2 AND 51.8 AND CAST({lng} AS DOUBLE) BETWEEN -0.6 AND 0.4)"


BARE = f"list_filter({every(LOOSE, 'html', 0)}, lambda p: {good(f'regexp_extract(p,{chr(39)}{LOOSE}{chr(39)},1)', f'regexp_extract(p,{chr(39)}{LOOSE}{chr(39)},2)')})[1]"


@query("coords_extract", f"""
SELECT page_id, CAST(CASE WHEN coalesce({good('ja', 'jb')},FALSE) THEN ja WHEN coalesce({good('ma', 'mb')},FALSE) THEN ma ELSE regexp_extract(bare,'{LOOSE}',1) END AS DOUBLE) AS lat,
 CAST(CASE WHEN coalesce({good('ja', 'jb')},FALSE) THEN jb WHEN coalesce({good('ma', 'mb')},FALSE) THEN mb ELSE regexp_extract(bare,'{LOOSE}',2) END AS DOUBLE) AS lng
FROM (SELECT page_id, {x(JSON_PAIR)} AS ja, {x(JSON_PAIR, 2)} AS jb, {x(MAP_PAIR)} AS ma, {x(MAP_PAIR, 2)} AS mb, {BARE} AS bare FROM listing_pages)""", "listing_pages")
def coords_extract(t):
    return t.listing_pages.select("page_id", P.coords(F.col("html")).alias("c")).select("page_id", "c.lat", "c.lng")


@query("money_parse", r"""
SELECT uid, CAST(replace(nullif(regexp_extract(price,'£\s*([\d,]+(?:\.\d+)?)',1),''),',','') AS DOUBLE) AS pounds, CAST(replace(nullif(regexp_extract(price,'£([\d,]+)',1),''),',','') AS BIGINT)*100 AS pence,
 CAST(nullif(regexp_extract(replace(title,',',''),'(\d+)',1),'') AS BIGINT) AS title_digits FROM listings""", "listings")
def money_parse(t):
    return t.listings.select("uid", X.money(F.col("price")).alias("pounds"), X.price_text_to_pence(F.col("price")).alias("pence"),
                             X.first_digits(F.col("title")).alias("title_digits"))


TYPE_SQL = "CASE WHEN {0} IS NULL THEN NULL " + " ".join(f"WHEN contains(lower({{0}}),'{a}') THEN '{b}'" for a, b in X.PROPERTY_TYPE_RULES) + " ELSE 'unknown' END"


@query("property_type_norm", f"SELECT page_id, {TYPE_SQL.format('listing_title')} AS property_type FROM listing_pages", "listing_pages")
def property_type_norm(t):
    return t.listing_pages.select("page_id", X.property_type(F.col("listing_title")).alias("property_type"))


@query("extract_pages")
def extract_pages(t):
    return P.extract_pages(t.listing_pages).drop("features", "description")


@query("extract_yield", f"""
SELECT p.portal, 'size_sqft' AS field, count(c.size_sqft) AS filled, count(*) AS total FROM listing_pages p JOIN cascade c ON c.page_id=p.page_id GROUP BY p.portal
UNION ALL SELECT p.portal, 'bedrooms', count(c.bedrooms), count(*) FROM listing_pages p JOIN cascade c ON c.page_id=p.page_id GROUP BY p.portal
UNION ALL SELECT p.portal, 'price_pcm', count(c.price_pcm), count(*) FROM listing_pages p JOIN cascade c ON c.page_id=p.page_id GROUP BY p.portal
UNION ALL SELECT p.portal, 'latitude', count(c.latitude), count(*) FROM listing_pages p JOIN cascade c ON c.page_id=p.page_id GROUP BY p.portal""", "listing_pages", ctes=SCRIPTS + ",\n" + CASCADE)
def extract_yield(t):
    rows = P.with_scripts(t.listing_pages).select("portal", *[c.alias(n) for n, c in P.source_cascade().items()])
    return P.extract_yield(rows, ["size_sqft", "bedrooms", "price_pcm", "latitude"]).drop("share")


@query("extract_yield_all")
def extract_yield_all(t):
    return P.extract_yield(P.extract_pages(t.listing_pages))
