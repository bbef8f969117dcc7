"""Raw listing pages -> typed rows: native expressions over the whole html, one projection, no per-row Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proplake.functions.patterns import insensitive
from proplake.functions.text import (
    area_of, bind, clean_address, extract, extract_all, first_known, first_postcode, html_to_text, money,
    property_type, strip, to_int,
)
from proplake.operators import features as T
from proplake.operators.gate import is_let_agreed_title

# --- fixed values: page formats of the three portals ------------------------------------------------------
DETAIL_ID = r"/to-rent/details/(\d+)"
PROPERTY_ID = r"/properties/(\d+)"
TARGETING_SCRIPT = r'<script id="__ZAD_TARGETING__"[^>]*>([\s\S]*?)</script>'
LD_SCRIPT = r'<script[^>]*type="application/ld\+json"[^>]*>([\s\S]*?)</script>'
NEXT_SCRIPT = r'<script id="__NEXT_DATA__"[^>]*>([\s\S]*?)</script>'
MODEL_SCRIPT = r"window\.(?:__)?PAGE_MODEL\s*=\s*(\{[\s\S]*?\})\s*;?\s*</script>"
REMOVED_MARKERS = ["this listing has been removed", "no longer available", "longer on zoopla"]
PHOTO_NAME = r'\\"filename\\":\\"([a-f0-9]{40}\.(?:jpg|jpeg|png|webp))\\"'
PHOTO_PATH = r"/u/(?:\d+)/(?:\d+)/([a-f0-9]{40}\.(?:jpg|jpeg|png|webp))"
PHOTO_BASE = "https://lid.zoocdn.com/u/1024/768/"
PLAN_BASE = "https://lc.zoocdn.com/"
PLAN_URL = r'\\"floorPlan\\":\[\{\\"original\\":\\"(https?://[^\\"]+\.(?:jpg|jpeg|png|pdf))\\"'
PLAN_NAME = r'\\"floorPlan\\":\{\\"image\\":\[\{[^\]]*?\\"filename\\":\\"([a-f0-9]{40}\.(?:jpg|jpeg|png))\\"'
PLAN_MEDIA = r"""(?i)(https?://media[0-9]*\.rightmove\.co\.uk/[^"'\\<>\s]*property-floorplan[^"'\\<>\s]*\.(?:jpe?g|png|gif))"""
CERT_NAME = [
    r'\\"epc\\":\{\\"image\\":\[\{[^\]]*?\\"filename\\":\\"([a-f0-9]{40}\.(?:jpg|jpeg|png))\\"',
    r'"epc":\{"image":\[\{[^\]]*?"filename":"([a-f0-9]{40}\.(?:jpg|jpeg|png))"',
]
CERT_MEDIA = r"""(?i)(https?://media[0-9]*\.rightmove\.co\.uk/[^"'\\<>\s]*epc[^"'\\<>\s]*\.(?:jpe?g|png|gif))"""
CERT_LETTER = [r'\\"epcRating\\":\\"([A-G])\\"', r'"epcRating":"([A-G])"']
BULLETS = r'\\"bullets\\":\[([^\[\]]*)\]'
BULLET = r'\\"((?:[^\\"]|\\\\.)+)\\"'
LABEL_PRICE = r'\\"label\\":\\"£([\d,]+)\s*pcm\\"'
BADGE = r"(?i)galleryBadge[^>]*>\s*([^<]+?)\s*<"
BADGE_TEXT = r"(?i)\b(?:let\s+agreed|now\s+let|under\s+offer)\b"
TITLE_TYPES = "flat|apartment|house|studio|maisonette|bungalow"
TITLE_PLACE = r"(?:for rent in|to rent in|in)\s+(.+?)(?:\s*\||$)"
OUTCODE_AT_END = r"\b([A-Z]{1,2}[0-9R][0-9A-Z]?)\b\s*$"
PLAN_HOSTS = ["media.rightmove.co.uk", "media2.rightmove.co.uk"]
PLAN_HOST_SUFFIX = "zoocdn.com"
PLAN_WRAPPER = r"(?i)^https?://www\.foxtons\.co\.uk/.+/large_floorplan"
LISTING_IMAGE = "imagescdn.openrent.co.uk/listings/"
PREFERENCES = ["Student Friendly", "Families Allowed", "Pets Allowed", "Smokers Allowed", "DSS/LHA Covers Rent"]
# --- end of fixed values ----------------------------------------------------------------------------------

TARGETING = ("struct<listing_id:string,display_address:string,outcode:string,incode:string,num_beds:string,num_baths:string,"
             "price_actual:string,property_type:string,furnished_state:string,size_sq_feet:string>")
NEXT_PROPERTY = "array<struct<id:string,propertyId:string,property_id:string,propertyUrl:string>>"


def truthy(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def distinct_known(items: Column) -> Column:
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull()))


def with_scripts(pages: DataFrame) -> DataFrame:
    """Add the embedded JSON of a page: targeting struct, real-estate ld+json text, page model text, dehydrated array."""
    found = pages.withColumns({
        "targeting": F.from_json(strip(extract(F.col("html"), TARGETING_SCRIPT)), TARGETING),
        "ld_all": F.transform(extract_all(F.col("html"), LD_SCRIPT), strip),
        "model": extract(F.col("html"), MODEL_SCRIPT),
    })
    return found.withColumns({
        "ld": F.get(F.filter("ld_all", lambda x: F.get_json_object(x, "$['@type']") == "RealEstateListing"), F.lit(0)),
        "dry": F.from_json(F.get_json_object("model", "$.data"), "array<string>"),
    })


# --- ids --------------------------------------------------------------------------------------------------
def search_ids_b(html: Column) -> Column:
    return F.array_distinct(extract_all(html, DETAIL_ID))


def search_ids_a(html: Column) -> Column:
    """Ids of the embedded result list when the page has one, else every linked id; distinct, in page order."""
    listed = F.from_json(F.get_json_object(extract(html, NEXT_SCRIPT), "$.props.pageProps.searchResults.properties"), NEXT_PROPERTY)
    ids = F.transform(listed, lambda p: F.coalesce(extract(p["propertyUrl"], PROPERTY_ID), p["id"], p["propertyId"], p["property_id"]))
    return F.coalesce(distinct_known(ids), F.array_distinct(extract_all(html, PROPERTY_ID)))


def listing_uid(url: Column, portal_a: str = "portal_a", portal_b: str = "portal_b") -> Column:
    a, b = extract(url, PROPERTY_ID), extract(url, DETAIL_ID)
    return F.coalesce(F.concat(F.lit(f"{portal_a}:"), a), F.concat(F.lit(f"{portal_b}:"), b))


def page_ids(pages: DataFrame) -> DataFrame:
    """(page_id, source, pos, property_id), first-seen order kept."""
    both = pages.select("page_id", F.explode(F.array(
        F.struct(F.lit("portal_a").alias("source"), search_ids_a(F.col("html")).alias("ids")),
        F.struct(F.lit("portal_b").alias("source"), search_ids_b(F.col("html")).alias("ids")))).alias("s"))
    return both.select("page_id", "s.source", F.posexplode("s.ids").alias("pos", "property_id"))


def first_discovery(discoveries: DataFrame) -> DataFrame:
    """Listings found by several profiles, kept at their first (profile, position)."""
    return discoveries.groupBy("property_id").agg(F.min(F.struct("profile", "pos")).alias("first")).select("property_id", "first.*")


# --- titles -----------------------------------------------------------------------------------------------
def page_title(html: Column) -> Column:
    return truthy(strip(extract(html, r"<title>([^<]+)</title>")))


def title_fields(title: Column) -> dict[str, Column]:
    kind = F.coalesce(
        extract(title, insensitive(rf"bedroom\s+({TITLE_TYPES})")), extract(title, insensitive(rf"(\d+)\s*bed\s+({TITLE_TYPES})"), 2),
        extract(title, insensitive(rf"({TITLE_TYPES})")))
    return {"title_bedrooms": extract(title, insensitive(r"(\d+)\s*bedroom")).try_cast("int"), "title_type": F.lower(kind),
            "title_address": truthy(strip(extract(title, insensitive(TITLE_PLACE))))}


def heading_fields(html: Column) -> dict[str, Column]:
    heading = truthy(strip(F.regexp_replace(extract(html, r"<h1[^>]*>([\s\S]*?)</h1>"), "<[^>]+>", "")))
    beds = extract(heading, insensitive(r"\b(\d+)\s*Bed\b")).try_cast("int")
    return {"heading": heading, "heading_bedrooms": F.coalesce(beds, F.when(heading.rlike(insensitive(r"\bStudio\b")), 0)),
            "outcode": extract(heading, OUTCODE_AT_END)}


# --- scanned values ---------------------------------------------------------------------------------------
def scan_text(html: Column, key: str) -> Column:
    """String value of a JSON key anywhere in the page, escaped form first."""
    return F.coalesce(extract(html, rf'\\"{key}\\":\\"((?:[^\\"]|\\\\.)*?)\\"'), extract(html, rf'"{key}":"((?:[^"\\]|\\.)*?)"'))


def scan_number(html: Column, key: str) -> Column:
    return F.coalesce(extract(html, rf'\\"{key}\\":(-?[\d.]+)'), extract(html, rf'"{key}":(-?[\d.]+)'))


def source_cascade() -> dict[str, Column]:
    """Per field the first source that has it: targeting block, page payload, ld+json. Needs ``with_scripts``."""
    html, target, ld = F.col("html"), F.col("targeting"), F.col("ld")
    outcode = F.coalesce(truthy(target["outcode"]), scan_text(html, "outcode"))
    incode = F.coalesce(truthy(target["incode"]), scan_text(html, "incode"))
    whole = lambda c: c.try_cast("int")
    furnished = F.coalesce(truthy(target["furnished_state"]), scan_text(html, "furnished_state"))
    lat, lng = scan_number(html, "latitude").try_cast("double"), scan_number(html, "longitude").try_cast("double")
    sqft = whole(strip(target["size_sq_feet"]))
    return {
        "address": F.coalesce(truthy(target["display_address"]), scan_text(html, "displayAddress"), truthy(F.get_json_object(ld, "$.name"))),
        "postcode": F.upper(F.coalesce(F.concat(outcode, F.lit(" "), incode), outcode)),
        "bedrooms": F.coalesce(whole(target["num_beds"]), *[whole(scan_number(html, k)) for k in ("numBedrooms", "numBeds", "totalBedrooms")]),
        "bathrooms": F.coalesce(whole(target["num_baths"]), *[whole(scan_number(html, k)) for k in ("numBathrooms", "numBaths")]),
        "price_pcm": F.coalesce(F.nullif(whole(target["price_actual"]), F.lit(0)), to_int(extract(html, LABEL_PRICE)),
                                whole(F.get_json_object(ld, "$.offers.price"))),
        "property_type": truthy(target["property_type"]),
        "furnished": F.initcap(F.replace(furnished, F.lit("_"), F.lit(" "))),
        "latitude": F.when(lng.isNotNull(), lat), "longitude": F.when(lat.isNotNull(), lng),
        "size_sqft": F.when(sqft > 0, sqft), "size_sqm": F.when(sqft > 0, F.bround(sqft * F.lit(0.0929), 0).cast("int")),
        "description": truthy(html_to_text(F.get_json_object(ld, "$.description"))),
    }


# --- arrays and grids -------------------------------------------------------------------------------------
def script_list(html: Column, name: str, kind: str) -> Column:
    """Items of ``var name = [...]`` that read as numbers of the kind, others skipped."""
    shape = r"^-?\d+$" if kind == "long" else r"^[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?$"
    body = extract(html, rf"var\s+{name}\s*=\s*\[([^\]]*)\]")
    items = F.filter(F.transform(F.split(body, ","), strip), lambda x: x.rlike(shape))
    return F.coalesce(F.transform(items, lambda x: x.try_cast(kind)), F.array().cast(f"array<{kind}>"))


def script_points(html: Column) -> Column:
    """Parallel id, latitude and longitude lists zipped up to the shortest."""
    ids, lats, lngs = (script_list(html, "PROPERTYIDS", "long"), script_list(html, "PROPERTYLISTLATITUDES", "double"),
                       script_list(html, "PROPERTYLISTLONGITUDES", "double"))
    short = F.least(F.size(ids), F.size(lats), F.size(lngs))
    return F.arrays_zip(F.slice(ids, 1, short).alias("property_id"), F.slice(lats, 1, short).alias("latitude"),
                        F.slice(lngs, 1, short).alias("longitude"))


def script_count(html: Column, name: str = "NUMBEROFPROPERTIES") -> Column:
    return F.coalesce(extract(html, rf"var\s+{name}\s*=\s*([0-9]+)").try_cast("int"), F.lit(0))


def script_index(html: Column, name: str = "PROPERTYBYID") -> Column:
    """``{id : position}`` as an array of pairs; items that are not two whole numbers are skipped."""
    pairs = extract_all(extract(html, rf"var\s+{name}\s*=\s*\{{([^}}]*)\}}"), r"(?:^|,)\s*(-?\d+\s*:\s*-?\d+)\s*(?=,|$)")
    return F.transform(pairs, lambda p: F.struct(strip(F.split_part(p, F.lit(":"), F.lit(1))).try_cast("long").alias("id"),
                                                 strip(F.split_part(p, F.lit(":"), F.lit(2))).try_cast("int").alias("position")))


def first_words(cell: Column) -> Column:
    """First non-blank text of a table cell."""
    return F.get(F.filter(F.transform(F.split(cell, "<[^>]+>"), strip), lambda x: x != ""), F.lit(0))


def label_grid(html: Column) -> Column:
    """Two-cell table rows as an array of (label, value); tick and cross icons read ``true`` and ``false``."""
    rows = F.transform(extract_all(html, r"<tr[^>]*>([\s\S]*?)</tr>"), lambda r: extract_all(r, r"<td[^>]*>([\s\S]*?)</td>"))
    icon = lambda c: F.when(c.contains("text-success"), "true").when(c.contains("text-danger"), "false")
    return F.transform(F.filter(rows, lambda r: F.size(r) == 2), lambda r: F.struct(
        first_words(r[0]).alias("label"), F.when(r[1].contains("<svg"), icon(r[1])).otherwise(first_words(r[1])).alias("value")))


def label_value(grid: Column, label: str) -> Column:
    """Value of a label; of repeated labels the last."""
    return F.get(F.reverse(F.filter(grid, lambda e: e["label"] == label)), F.lit(0))["value"]


def flag(text: Column) -> Column:
    return F.when(text == "true", True).when(text == "false", False)


# --- media ------------------------------------------------------------------------------------------------
def cert_image(html: Column) -> Column:
    named = [F.concat(F.lit(PHOTO_BASE), extract(html, p)) for p in CERT_NAME]
    return F.coalesce(*named, extract(html, CERT_MEDIA))


def cert_letter(html: Column) -> Column:
    return F.coalesce(*[extract(html, p) for p in CERT_LETTER])


def photo_urls(html: Column) -> Column:
    """Photo urls without the certificate chart; the page payload first, image paths only when it names none."""
    named = F.array_distinct(extract_all(html, PHOTO_NAME))
    names = F.when(F.size(named) > 0, named).otherwise(F.array_distinct(extract_all(html, PHOTO_PATH)))
    chart = F.coalesce(cert_image(html), F.lit(""))
    return F.filter(F.transform(names, lambda n: F.concat(F.lit(PHOTO_BASE), n)), lambda u: u != chart)


def gallery_urls(html: Column, most: int | None = None) -> Column:
    """The distinct property photos among the image tags; the first ``most`` of them where a gallery form asks for that."""
    tags = extract_all(html, r'<img[^>]*?(?:data-)?src="([^"]*)"')
    photos = F.array_distinct(F.filter(tags, lambda u: u.contains("property-photo") & u.contains("rightmove.co.uk")))
    return photos if most is None else F.slice(photos, 1, most)


def slide_urls(html: Column) -> Column:
    """Carousel photos on the portal's own image host, with a scheme."""
    tags = extract_all(html, r'<div class="swiper-slide"><img[^>]*?src="([^"]*)"')
    full = F.transform(tags, lambda u: F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u))
    return F.filter(full, lambda u: u.contains(LISTING_IMAGE))


def bullets(html: Column) -> Column:
    items = extract_all(extract(html, BULLETS), BULLET)
    return F.transform(items, lambda i: F.replace(F.replace(i, F.lit("\\u0026"), F.lit("&")), F.lit('\\"'), F.lit('"')))


def plan_host_ok(url: Column) -> Column:
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return host.isin(PLAN_HOSTS) | (host == f"lc.{PLAN_HOST_SUFFIX}") | host.endswith(f".{PLAN_HOST_SUFFIX}")


def floorplan_urls(html: Column) -> Column:
    """Distinct floorplan urls of the three shapes that live on a host serving images."""
    named = F.transform(extract_all(html, PLAN_NAME), lambda n: F.concat(F.lit(PLAN_BASE), n))
    every = F.array_distinct(F.concat(extract_all(html, PLAN_URL), named, extract_all(html, PLAN_MEDIA)))
    return F.filter(every, lambda u: F.coalesce(plan_host_ok(u), F.lit(False)) & ~u.rlike(PLAN_WRAPPER))


# --- visible text -----------------------------------------------------------------------------------------
def container(html: Column, test_id: str) -> Column:
    """Inner html of the first block element carrying the test id."""
    return extract(html, rf'<[^>]*data-testid="{test_id}"[^>]*>([\s\S]*?)</(?:div|ul|section|span|a|p)>')


def text_details() -> dict[str, Column]:
    """Details written for readers: bedroom line, price, description, bullets, phone. Needs ``with_scripts``."""
    html = F.col("html")
    facts = F.lower(F.regexp_replace(container(html, "property-details"), "<[^>]+>", ""))
    priced = strip(F.regexp_replace(container(html, "price"), "<[^>]+>", ""))
    offer = F.concat(F.lit("£"), F.get_json_object("ld", "$.offers.price"), F.lit(" pcm"))
    prose = strip(F.regexp_replace(F.regexp_replace(container(html, "property-description"), "<[^>]+>", ""), r"(?U)\s+", " "))
    items = F.transform(extract_all(container(html, "property-features"), r"<li[^>]*>([\s\S]*?)</li>"),
                        lambda x: strip(F.regexp_replace(x, "<[^>]+>", "")))
    phone = F.regexp_replace(strip(container(html, "agent-phone")), r"[^\d\s+\-()]", "")
    return {
        "text_bedrooms": extract(facts, r"(\d+)\s*bedroom").try_cast("int"), "text_bathrooms": extract(facts, r"(\d+)\s*bathroom").try_cast("int"),
        "text_furnished": F.when(facts.contains("unfurnished"), "Unfurnished").when(facts.contains("furnished"), "Furnished"),
        "text_price": F.coalesce(F.when(priced.contains("£"), priced), offer),
        "text_description": F.when(F.length(prose) > 20, prose),
        "text_features": F.array_distinct(F.filter(items, lambda x: (F.length(x) > 2) & (F.length(x) < 100))),
        "agent_phone": F.when(F.length(phone) > 8, phone),
    }


def stations(html: Column) -> Column:
    """(station, duration) pairs from the place section: a token followed by one that mentions minutes."""
    body = extract(html, r"<section[^>]*>\s*<h2>London, [^<]*</h2>([\s\S]*?)</section>")
    tokens = F.filter(F.transform(F.split(body, "<[^>]+>"), strip), lambda x: x != "")
    start = F.struct(F.lit(None).cast("string").alias("held"), F.array().cast("array<struct<station:string,duration:string>>").alias("pairs"))

    def step(acc: Column, token: Column) -> Column:
        pair = F.struct(acc["held"].alias("station"), token.alias("duration"))
        return F.when(
            acc["held"].isNotNull() & token.contains("min"),
            F.struct(F.lit(None).cast("string").alias("held"), F.array_append(acc["pairs"], pair).alias("pairs")),
        ).otherwise(F.struct(token.alias("held"), acc["pairs"].alias("pairs")))

    return F.aggregate(F.coalesce(tokens, F.array().cast("array<string>")), start, step)["pairs"]


def about_text(html: Column) -> Column:
    """The whole description under the portal's heading."""
    body = extract(html, r"About This Property([\s\S]*?)</section>")
    return truthy(html_to_text(body))


def about_bathrooms(about: Column) -> Column:
    return extract(about, insensitive(r"(\d+)[\-\s]?bathroom")).try_cast("int")


# --- portal C, coordinates, liveness, let-agreed ----------------------------------------------------------
def map_portal_c(pages: DataFrame) -> DataFrame:
    """Grid labels of the third portal renamed and typed to listing columns; it never shows a full postcode."""
    html, grid = F.col("html"), F.col("grid")
    rent = F.floor(money(label_value(grid, "Rent PCM"))).cast("long")
    head = heading_fields(html)
    return pages.withColumn("grid", label_grid(html)).select(
        "page_id", head["heading"].alias("title"), head["heading"].alias("address"), head["outcode"].alias("area"),
        F.lit(None).cast("string").alias("postcode"), F.concat(F.lit("£"), F.format_number(F.nullif(rent, F.lit(0)), 0), F.lit(" pcm")).alias("price"),
        (F.nullif(rent, F.lit(0)) * 100).alias("price_numeric"), head["heading_bedrooms"].alias("bedrooms"),
        about_bathrooms(about_text(html)).alias("bathrooms"), label_value(grid, "Furnishing").alias("furnished"),
        flag(label_value(grid, "Garden")).alias("garden"), flag(label_value(grid, "Bills Included")).alias("bills_included"),
        label_value(grid, "Available From").alias("let_available_date"), label_value(grid, "EPC Rating").alias("epc_rating"))


def inside(lat: Column, lng: Column, box: tuple[float, float, float, float]) -> Column:
    south, north, west, east = box
    return lat.between(south, north) & lng.between(west, east)


def coords(html: Column, box: tuple[float, float, float, float] = (51.2, 51.8, -0.6, 0.4)) -> Column:
    """struct<lat, lng>: JSON pair, then map link, then first bare pair of at least four decimals; only inside the box."""
    number = r"(-?\d{1,3}\.\d+)"

    def pair(text: Column, pattern: str) -> Column:
        lat, lng = extract(text, pattern, 1).try_cast("double"), extract(text, pattern, 2).try_cast("double")
        return F.when(inside(lat, lng, box), F.struct(lat.alias("lat"), lng.alias("lng")))

    loose = r"(-?\d{1,3}\.\d{4,})\s*,\s*(-?\d{1,3}\.\d{4,})"
    bare = F.transform(extract_all(html, loose, 0), lambda x: pair(x, loose))
    return F.coalesce(
        pair(html, rf'"latitude"\s*:\s*{number}[\s\S]*?"longitude"\s*:\s*{number}'), pair(html, rf"[?&](?:q|center|ll)={number},{number}"),
        first_known(bare))


def liveness(html: Column, requested: Column, final: Column) -> Column:
    """NULL for a live page, ``property_removed`` otherwise."""
    asked, got = extract(requested, DETAIL_ID), extract(final, DETAIL_ID)
    low = F.lower(html)
    gone = reduce(lambda a, b: a | b, [low.contains(m) for m in REMOVED_MARKERS])
    moved = ~F.coalesce(F.try_parse_url(final, F.lit("PATH")), F.lit("")).contains("/to-rent/details/")
    blank = ~html.contains('"listing_id"') & ~html.contains("ZAD_TARGETING")
    dead = (final.isNotNull() & (moved | F.coalesce(asked != got, F.lit(False)))) | gone | blank
    return F.when(dead, "property_removed")


def resolve(items: Column, value: Column, hops: int = 5) -> Column:
    """Follow a dehydrated value: a whole number inside the array's range stands for that element."""
    def hop(v: Column, _: Column) -> Column:
        index = v.try_cast("int")
        return F.when((index >= 0) & (index < F.size(items)), F.get(items, index)).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.lit(hops)), value, hop)


def dry_fields(items: Column) -> dict[str, Column]:
    """Status fields of a dehydrated page model."""
    def of(record: Column, key: str) -> Column:
        return F.get_json_object(record, f"$.{key}")

    at = lambda ref: F.get(items, ref.try_cast("int"))
    listing = at(of(F.get(items, F.lit(0)), "propertyData"))
    status = at(of(listing, "status"))
    return {
        "published": resolve(items, of(status, "published")), "archived": resolve(items, of(status, "archived")),
        "display_status": resolve(items, of(listing, "displayStatus")),
        "let_agreed": resolve(items, of(resolve(items, of(listing, "lettings")), "letAgreed")),
    }


def model_let_agreed(model: Column, items: Column) -> Column:
    """Let-agreed verdict of a page model in either form."""
    dry = dry_fields(items)
    wet = {"published": "$.propertyData.status.published", "archived": "$.propertyData.status.archived",
           "display_status": "$.propertyData.displayStatus", "let_agreed": "$.propertyData.lettings.letAgreed"}
    got = {k: F.when(items.isNotNull(), dry[k]).otherwise(F.get_json_object(model, path)) for k, path in wet.items()}
    tests = [got["archived"] == "true", got["published"] == "false", F.lower(got["display_status"]).contains("let agreed"),
             got["let_agreed"] == "true"]
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


def page_let_agreed() -> dict[str, Column]:
    """The separate let-agreed signals of a page. Needs ``with_scripts``."""
    html = F.col("html")
    badge = F.exists(extract_all(html, BADGE), lambda b: b.rlike(BADGE_TEXT))
    stock = F.exists("ld_all", lambda x: F.coalesce(~F.lower(F.get_json_object(x, "$.offers.availability")).rlike("instock|in_stock"), F.lit(False)))
    banner = F.coalesce(extract(html, r'<div class="alert alert-warning">([\s\S]*?)</div>').contains("Let Agreed"), F.lit(False))
    return {"by_title": is_let_agreed_title(page_title(html)), "by_model": model_let_agreed(F.col("model"), F.col("dry")),
            "by_badge": badge, "by_stock": stock, "by_banner": banner}


# --- the whole job ----------------------------------------------------------------------------------------
def extract_pages(pages: DataFrame) -> DataFrame:
    """One typed row per page of any portal; structured values win over values read from text."""
    scanned = with_scripts(pages)
    html, c = F.col("html"), F.col("portal") == "portal_c"
    cascade, text, head = source_cascade(), text_details(), heading_fields(html)
    let = page_let_agreed()
    wide = scanned.withColumn("grid", F.when(c, label_grid(html))).withColumns({
        **{f"s_{k}": v for k, v in cascade.items()}, **text, **head, **title_fields(page_title(html)),
        "title": page_title(html), "place": coords(html), "bullet_items": bullets(html), "photos": photo_urls(html),
        "plans": floorplan_urls(html), "letter": cert_letter(html), "cert_image": cert_image(html), "about": F.when(c, about_text(html)),
        "is_let_agreed": reduce(lambda a, b: a | b, let.values()),
    })
    description = F.coalesce("about", "s_description", "text_description")
    points = F.concat(F.coalesce("text_features", F.array().cast("array<string>")), F.coalesce("bullet_items", F.array().cast("array<string>")))
    address = F.coalesce("s_address", "title_address", "heading")
    grid = F.col("grid")
    joined = wide.withColumns({"description": description, "features": points, "full_address": address})
    rent = F.coalesce(money(label_value(grid, "Rent PCM")), F.col("s_price_pcm").cast("double"), money(F.col("text_price")))
    return joined.select(
        "page_id", "portal", "title", clean_address(F.col("full_address")).alias("address"),
        F.when(~c, F.coalesce("s_postcode", first_postcode(F.col("full_address")))).alias("postcode"),
        F.coalesce(F.when(c, F.col("outcode")), area_of(F.col("full_address"))).alias("area"),
        (F.floor(rent) * 100).cast("long").alias("price_numeric"),
        F.coalesce("s_bedrooms", "title_bedrooms", "text_bedrooms", "heading_bedrooms").alias("bedrooms"),
        F.coalesce("s_bathrooms", "text_bathrooms", about_bathrooms(F.col("about"))).alias("bathrooms"),
        property_type(F.coalesce("s_property_type", "title_type")).alias("property_type"),
        F.coalesce(label_value(grid, "Furnishing"), F.col("s_furnished"), F.col("text_furnished")).alias("furnished"),
        F.coalesce("s_latitude", F.col("place.lat")).alias("latitude"), F.coalesce("s_longitude", F.col("place.lng")).alias("longitude"),
        F.coalesce(F.col("s_size_sqft"), T.size_sqft(F.col("description"), F.col("features"))).alias("size_sqft"),
        F.coalesce(label_value(grid, "EPC Rating"), F.col("letter"), T.rating_letter(F.col("description"), F.col("features"))).alias("epc_rating"),
        F.coalesce(flag(label_value(grid, "Garden")), T.garden(F.col("description"), F.col("features"), F.col("title"))).alias("garden"),
        F.size("photos").alias("n_photos"), F.size("plans").alias("n_floorplans"), "cert_image", "agent_phone", "is_let_agreed",
        "description", "features")


YIELD_FIELDS = ("title address postcode area price_numeric bedrooms bathrooms property_type furnished latitude longitude size_sqft "
                "epc_rating cert_image agent_phone description").split()


def extract_yield(listings: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(portal, field, filled, total, share) in one aggregation over the extracted rows."""
    fields = fields or YIELD_FIELDS
    counts = listings.groupBy("portal").agg(F.count("*").alias("total"), *[F.count(f).alias(f) for f in fields])
    return counts.unpivot(["portal", "total"], fields, "field", "filled").withColumn("share", F.round(F.col("filled") / F.col("total"), 4))
