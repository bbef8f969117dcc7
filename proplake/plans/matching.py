"""Duplicate matching and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from proplake.functions.text import normal_postcode
from proplake.operators import resolve as R
from proplake.plans.registry import query
from proplake.session import cut_lineage

PC = r"CASE WHEN regexp_matches(replace(upper(trim(postcode)),' ',''),'^[A-Z]{1,2}[0-9][A-Z0-9]?[0-9][A-Z]{2}$') THEN regexp_replace(replace(upper(trim(postcode)),' ',''),'^(.*)(...)$','\1 \2') END"
METRES = "2*6371000.0*asin(least(1.0,sqrt(power(sin(radians(b.latitude-a.latitude)/2),2)+cos(radians(a.latitude))*cos(radians(b.latitude))*power(sin(radians(b.longitude-a.longitude)/2),2))))"
KEYS = f"""
keyed AS (SELECT uid, bedrooms, price_numeric//100 AS pcm, latitude, longitude, {PC} AS pc, portal='portal_c' OR ({PC}) IS NULL AS g FROM listings WHERE bedrooms IS NOT NULL AND price_numeric//100>0)"""
PAIRS = KEYS + f""",
pairs AS (SELECT 'postcode' AS branch, a.uid AS u, b.uid AS v, a.bedrooms, least(a.pcm,b.pcm) AS lo, greatest(a.pcm,b.pcm) AS hi
  FROM keyed a JOIN keyed b ON a.bedrooms=b.bedrooms AND a.pc=b.pc AND NOT a.g AND NOT b.g AND a.uid<b.uid AND abs(a.pcm-b.pcm)/least(a.pcm,b.pcm)<=0.02::DOUBLE
 UNION ALL SELECT 'place', a.uid, b.uid, a.bedrooms, least(a.pcm,b.pcm), greatest(a.pcm,b.pcm)
  FROM keyed a JOIN keyed b ON a.bedrooms=b.bedrooms AND a.uid<b.uid AND (a.g OR b.g) AND abs(a.latitude-b.latitude)<0.001 AND abs(a.pcm-b.pcm)/least(a.pcm,b.pcm)<=0.02::DOUBLE
   AND {METRES}<=50)"""
CLOSURE = PAIRS + """,
links AS (SELECT u AS x, v AS y FROM pairs UNION SELECT v, u FROM pairs),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x=r.y),
clusters AS (SELECT l.uid, least(l.uid, coalesce(min(r.y), l.uid)) AS cluster_id FROM listings l LEFT JOIN reach r ON r.x=l.uid GROUP BY l.uid),
clustered AS (SELECT l.* EXCLUDE (cluster_id), c.cluster_id FROM listings l JOIN clusters c ON c.uid=l.uid)"""


RANKED = ("portal", "first_seen", "size_sqft", "epc_rating", "floorplan_data", "tube_distance", "commute_primary")
PLACED = ("latitude", "longitude")
KEYED = ("portal", "postcode", "bedrooms", "price_numeric", *PLACED)


def clustered(t, *columns):
    """(uid, cluster_id, columns) of the listings."""
    return cut_lineage(R.with_cluster_id(t.listings.drop("cluster_id"), columns))  # read several times by what follows


@query("postcode_norm", f"SELECT uid, {PC} AS postcode_norm FROM listings", "listings")
def postcode_norm(t):
    return t.listings.select("uid", normal_postcode(F.col("postcode")).alias("postcode_norm"))


@query("dup_pairs", "SELECT branch, bedrooms, lo AS pcm_low, hi AS pcm_high, count(*) AS n_pairs FROM pairs GROUP BY branch, bedrooms, lo, hi",
       "listings", ctes=PAIRS)
def dup_pairs(t):
    return R.dup_pairs(t.listings)


@query("dup_match_counts", "SELECT uid, count(*) AS n_matches FROM (SELECT u AS uid FROM pairs UNION ALL SELECT v FROM pairs) GROUP BY uid",
       "listings", ctes=PAIRS)
def dup_match_counts(t):
    return R.dup_match_counts(t.listings)


@query("dup_clusters", "SELECT uid, cluster_id FROM clusters", "listings", ctes=CLOSURE, recursive=True)
def dup_clusters(t):
    return R.dup_clusters(t.listings.drop("cluster_id"))


RANK = """-(CAST(size_sqft IS NOT NULL AS INT)+CAST(coalesce(epc_rating,'')<>'' AS INT)+CAST(coalesce(floorplan_data,'')<>'' AS INT)+CAST(tube_distance IS NOT NULL AS INT)+CAST(commute_primary IS NOT NULL AS INT)),
 -epoch_us(first_seen), CASE WHEN portal='portal_a' THEN 0 ELSE 1 END, uid"""
PRIMARY = f"primaries AS (SELECT cluster_id, uid AS primary_uid FROM (SELECT cluster_id, uid, row_number() OVER (PARTITION BY cluster_id ORDER BY {RANK}) AS rn FROM clustered) WHERE rn=1)"
CENTROID = f"""
far AS (SELECT DISTINCT a.cluster_id FROM clustered a JOIN clustered b ON a.cluster_id=b.cluster_id AND a.uid<b.uid AND a.latitude IS NOT NULL AND b.latitude IS NOT NULL AND {METRES}>50),
centres AS (SELECT cluster_id, CASE WHEN cluster_id NOT IN (SELECT cluster_id FROM far) THEN round(avg(latitude),6) END AS centroid_lat,
  CASE WHEN cluster_id NOT IN (SELECT cluster_id FROM far) THEN round(avg(longitude),6) END AS centroid_lng FROM clustered GROUP BY cluster_id)"""


@query("choose_primary", "SELECT cluster_id, primary_uid FROM primaries", "listings", ctes=CLOSURE + ",\n" + PRIMARY, recursive=True)
def choose_primary(t):
    return R.choose_primary(clustered(t, *RANKED))


def rounded_centres(df):
    return df.withColumns({"centroid_lat": F.round("centroid_lat", 6), "centroid_lng": F.round("centroid_lng", 6)})


@query("cluster_centroid", "SELECT cluster_id, centroid_lat, centroid_lng FROM centres", "listings", ctes=CLOSURE + ",\n" + CENTROID, recursive=True)
def cluster_centroid(t):
    return rounded_centres(R.cluster_centroid(clustered(t, *PLACED)))


@query("cluster_table", """
SELECT c.cluster_id, coalesce(max(c.bedrooms),0) AS bedrooms, coalesce(min(c.price_numeric//100),0) AS price_pcm_min, coalesce(max(c.price_numeric//100),0) AS price_pcm_max,
 count(*) AS member_count, any_value(p.primary_uid) AS primary_uid, min(c.first_seen) AS first_seen, max(c.last_scraped) AS last_seen,
 any_value(x.centroid_lat) AS centroid_lat, any_value(x.centroid_lng) AS centroid_lng
FROM clustered c JOIN primaries p ON p.cluster_id=c.cluster_id JOIN centres x ON x.cluster_id=c.cluster_id GROUP BY c.cluster_id""",
       "listings", ctes=CLOSURE + ",\n" + PRIMARY + ",\n" + CENTROID, recursive=True)
def cluster_table(t):
    return rounded_centres(R.cluster_table(clustered(t, *KEYED, *RANKED, "last_scraped")))


ARRIVALS = CLOSURE + f""",
asked AS (SELECT uid, bedrooms, price_numeric//100 AS pcm, latitude, longitude, {PC} AS pc, portal='portal_c' OR ({PC}) IS NULL AS g FROM arrivals WHERE bedrooms IS NOT NULL AND price_numeric//100>0),
hits AS (SELECT a.uid, c.cluster_id FROM asked a JOIN keyed b ON a.bedrooms=b.bedrooms AND a.pc=b.pc AND NOT a.g AND NOT b.g AND abs(a.pcm-b.pcm)/least(a.pcm,b.pcm)<=0.02::DOUBLE JOIN clusters c ON c.uid=b.uid
 UNION ALL SELECT a.uid, c.cluster_id FROM asked a JOIN keyed b ON a.bedrooms=b.bedrooms AND (a.g OR b.g) AND abs(a.latitude-b.latitude)<0.001 AND abs(a.pcm-b.pcm)/least(a.pcm,b.pcm)<=0.02::DOUBLE
   AND {METRES}<=50 JOIN clusters c ON c.uid=b.uid)"""


@query("cluster_assign_incremental", """
SELECT a.uid, min(h.cluster_id) AS joined_cluster, min(h.cluster_id) IS NULL AS is_new FROM arrivals a LEFT JOIN hits h ON h.uid=a.uid GROUP BY a.uid""",
       "listings", "arrivals", ctes=ARRIVALS, recursive=True)
def cluster_assign_incremental(t):
    done = R.cluster_assign_incremental(t.arrivals, clustered(t, *KEYED))
    return done.select("uid", F.when(~F.col("is_new"), F.col("cluster_id")).alias("joined_cluster"), "is_new")


FACTS = "uid, portal, bedrooms, price_numeric, latitude, longitude, first_seen, last_scraped, cluster_id"
EXTRA = ["size_sqft", "epc_rating", "floorplan_data", "tube_distance", "commute_primary"]
TOGETHER = f"""
joined AS (SELECT a.*, h.cluster_id FROM arrivals a JOIN (SELECT uid, min(cluster_id) AS cluster_id FROM hits GROUP BY uid) h ON h.uid=a.uid),
together AS (SELECT {FACTS}, {', '.join(EXTRA)} FROM clustered WHERE cluster_id IN (SELECT cluster_id FROM joined)
 UNION ALL SELECT {FACTS}, {', '.join('NULL' for _ in EXTRA)} FROM joined)"""


@query("cluster_assign_refresh", """
SELECT c.cluster_id, max(c.bedrooms) AS bedrooms, coalesce(min(c.price_numeric//100),0) AS price_pcm_min, coalesce(max(c.price_numeric//100),0) AS price_pcm_max,
 count(*) AS member_count, any_value(p.primary_uid) AS primary_uid, min(c.first_seen) AS first_seen, max(c.last_scraped) AS last_seen,
 any_value(x.centroid_lat) AS centroid_lat, any_value(x.centroid_lng) AS centroid_lng
FROM together c JOIN primaries p ON p.cluster_id=c.cluster_id JOIN centres x ON x.cluster_id=c.cluster_id GROUP BY c.cluster_id""",
       "listings", "arrivals", ctes=ARRIVALS + ",\n" + TOGETHER + ",\n" + (PRIMARY + ",\n" + CENTROID).replace("clustered", "together"), recursive=True)
def cluster_assign_refresh(t):
    """The cluster rows that a batch of arrivals changes."""
    stored = clustered(t, *KEYED, *RANKED, "last_scraped")
    joined = cut_lineage(t.arrivals.join(R.matching_cluster(t.arrivals, stored), "uid"))
    return rounded_centres(R.refreshed_clusters(joined, stored.select(*[c.strip() for c in FACTS.split(",")], *EXTRA)))


STORED = "stored AS (SELECT c_custkey AS cluster_id, CASE WHEN c_acctbal>2000 THEN CAST(1+c_nationkey AS BIGINT) END AS member_count FROM customer)"


def stored(t):
    return t.customer.select(
        F.col("c_custkey").alias("cluster_id"), F.when(F.col("c_acctbal") > 2000, F.col("c_nationkey") + 1).cast("long").alias("member_count"))


@query("cluster_member_counts", """
SELECT l.uid, CASE WHEN l.cluster_id IS NULL THEN 1 ELSE coalesce(s.member_count, a.n, 1) END AS cluster_member_count
FROM listings l LEFT JOIN stored s ON s.cluster_id=l.cluster_id LEFT JOIN (SELECT cluster_id, count(*) AS n FROM listings WHERE is_active GROUP BY cluster_id) a ON a.cluster_id=l.cluster_id""",
       "listings", ctes=STORED)
def cluster_member_counts(t):
    return R.cluster_member_counts(t.listings, stored(t)).select("uid", "cluster_member_count")


@query("cluster_other_members", """
SELECT p.uid, o.uid AS other_uid, o.portal AS other_portal FROM (SELECT uid, cluster_id FROM listings WHERE is_active AND score>=60 ORDER BY score DESC, uid LIMIT 20) p
JOIN listings o ON o.cluster_id=p.cluster_id AND o.uid<>p.uid AND o.is_active""", "listings")
def cluster_other_members(t):
    page = t.listings.filter("is_active AND score >= 60").orderBy(F.desc("score"), "uid").limit(20)
    return R.cluster_other_members(page, t.listings)


@query("pair_precision_recall", """
SELECT tp, fp, fn, tn, coalesce(tp/nullif(tp+fp,0),0.0) AS precision, coalesce(tp/nullif(tp+fn,0),0.0) AS recall FROM (
 SELECT count(*) FILTER (WHERE a.cluster_id=b.cluster_id AND label='duplicate') AS tp, count(*) FILTER (WHERE a.cluster_id=b.cluster_id AND label<>'duplicate') AS fp,
  count(*) FILTER (WHERE a.cluster_id<>b.cluster_id AND label='duplicate') AS fn, count(*) FILTER (WHERE a.cluster_id<>b.cluster_id AND label<>'duplicate') AS tn
 FROM labelled_pairs p JOIN clusters a ON a.uid=p.uid_a JOIN clusters b ON b.uid=p.uid_b)""", "listings", "labelled_pairs", ctes=CLOSURE, recursive=True)
def pair_precision_recall(t):
    return R.pair_precision_recall(t.labelled_pairs, R.cluster_labels(t.listings.drop("cluster_id")))


@query("cluster_numbers", "SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) AS cluster_number FROM (SELECT DISTINCT cluster_id FROM clusters)",
       "listings", ctes=CLOSURE, recursive=True)
def cluster_numbers(t):
    found = cut_lineage(R.dup_clusters(t.listings.drop("cluster_id")).select("cluster_id").distinct())  # the sort reads it twice
    return R.with_cluster_number(found)
