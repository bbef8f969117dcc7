"""Calibration, evaluation and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from proplake.config import STOP_WORDS
from proplake.functions.geo import haversine
from proplake.functions.ranks import spearman as rank_correlation
from proplake.operators import enrich, score
from proplake.operators import evaluate as V
from proplake.operators.gate import is_let_agreed_title
from proplake.plans.registry import query
from proplake.plans.scoring import LET, SCORED

NEWEST = "newest AS (SELECT * FROM listing_labels WHERE session_id=(SELECT max(session_id) FROM listing_labels))"
RANK = "CASE tier WHEN 'best' THEN 4 WHEN 'good' THEN 3 WHEN 'bad' THEN 2 WHEN 'worse' THEN 1 END"


@query("label_join_latest_session", f"SELECT n.uid, n.tier, n.position, {RANK} AS tier_rank, l.score, l.bedrooms FROM newest n JOIN listings l ON l.uid=n.uid",
       "listing_labels", "listings", ctes=NEWEST)
def label_join_latest_session(t):
    return V.label_join_latest_session(t.listing_labels, t.listings).select("uid", "tier", "position", "tier_rank", "score", "bedrooms")


KEYS = ["price", "size", "bedrooms", "epc", "transport", "outside", "carpet_bedroom", "carpet_other_areas", "region_pref"]
COLUMN = {"carpet_bedroom": "c_bed_carpet", "carpet_other_areas": "c_other_carpet", "region_pref": "c_region"}


@query("tier_component_means", f"""
SELECT n.tier, {', '.join(f"round(avg(s.{COLUMN.get(k, 'c_' + k)}),4) AS mean_{k}" for k in KEYS)}, count(*) AS n, round(avg(s.score),4) AS mean_score
FROM newest n JOIN scored s ON s.uid=n.uid WHERE n.tier<>'unsure' GROUP BY n.tier""", "listing_labels", "listings", ctes=NEWEST + ",\n" + SCORED)
def tier_component_means(t):
    scored = score.with_score(t.listings.drop("score", "score_breakdown"))
    return V.tier_component_means(V.label_join_latest_session(t.listing_labels, scored), KEYS)


@query("tier_distributions", """
SELECT n.tier, count(*) FILTER (WHERE l.bedrooms=0) AS "0", count(*) FILTER (WHERE l.bedrooms=1) AS "1", count(*) FILTER (WHERE l.bedrooms=2) AS "2", count(*) FILTER (WHERE l.bedrooms=3) AS "3"
FROM newest n JOIN listings l ON l.uid=n.uid GROUP BY n.tier""", "listing_labels", "listings", ctes=NEWEST)
def tier_distributions(t):
    return V.tier_distributions(V.label_join_latest_session(t.listing_labels, t.listings), "bedrooms", [0, 1, 2, 3])


@query("tier_size_summary", """
SELECT n.tier, round(avg(l.size_sqft),4) AS mean, min(l.size_sqft) AS min, max(l.size_sqft) AS max, count(l.size_sqft) AS count FROM newest n JOIN listings l ON l.uid=n.uid GROUP BY n.tier""",
       "listing_labels", "listings", ctes=NEWEST)
def tier_size_summary(t):
    return V.tier_summary(V.label_join_latest_session(t.listing_labels, t.listings), "size_sqft")


@query("spearman", f"""
SELECT n, round(rho,9) AS rho, round(rho*sqrt(n-2)/sqrt(1-rho*rho),6) AS t FROM (SELECT count(*) AS n, corr(rx,ry) AS rho FROM (
 SELECT rank() OVER (ORDER BY x)+(count(*) OVER (PARTITION BY x)-1)/2 AS rx, rank() OVER (ORDER BY y)+(count(*) OVER (PARTITION BY y)-1)/2 AS ry FROM (
  SELECT {RANK} AS x, l.score AS y FROM newest n JOIN listings l ON l.uid=n.uid) WHERE x IS NOT NULL AND y IS NOT NULL))""", "listing_labels", "listings", ctes=NEWEST)
def spearman(t):
    joined = V.label_join_latest_session(t.listing_labels, t.listings)
    return rank_correlation(joined, "tier_rank", "score").select("n", F.round("rho", 9).alias("rho"), F.round("t", 6).alias("t"))


@query("disagreement_topk", """
(SELECT n.uid, n.tier, l.score, 'overrated' AS side FROM newest n JOIN listings l ON l.uid=n.uid WHERE n.tier IN ('bad','worse') AND l.score IS NOT NULL ORDER BY l.score DESC, n.uid LIMIT 6)
UNION ALL (SELECT n.uid, n.tier, l.score, 'underrated' FROM newest n JOIN listings l ON l.uid=n.uid WHERE n.tier IN ('best','good') AND l.score IS NOT NULL ORDER BY l.score, n.uid LIMIT 6)""",
       "listing_labels", "listings", ctes=NEWEST)
def disagreement_topk(t):
    return V.disagreement_topk(V.label_join_latest_session(t.listing_labels, t.listings))


STOP = ",".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)


@query("token_frequency_per_group", rf"""
SELECT tier, token, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY n DESC, position, uid, i) AS rank FROM (
 SELECT tier, token, count(*) AS n, min((position, uid, i)) AS f, struct_extract(min(row(position, uid, i)),1) AS position, struct_extract(min(row(position, uid, i)),2) AS uid, struct_extract(min(row(position, uid, i)),3) AS i FROM (
  SELECT tier, position, uid, unnest(words) AS token, generate_subscripts(words,1) AS i FROM (SELECT tier, position, uid,
   regexp_split_to_array(trim(regexp_replace(translate(lower(reasoning),',.;:()!?/\','          '),'\s+',' ','g')),' ') AS words FROM labelled WHERE reasoning IS NOT NULL))
  WHERE length(token)>2 AND token NOT IN ({STOP}) GROUP BY tier, token)) WHERE rank<=15""", "labelled")
def token_frequency_per_group(t):
    return V.token_frequency_per_group(t.labelled)


@query("reasons_by_tier", """
SELECT tier, position, uid, trim(reasoning) AS reasoning FROM newest WHERE trim(reasoning)<>''""", "listing_labels", ctes=NEWEST)
def reasons_by_tier(t):
    return V.reasons_by_tier(t.listing_labels)


SWEEP = """sweep AS (SELECT threshold, tp, fp, fn, tp/nullif(tp+fp,0) AS precision, tp/nullif(tp+fn,0) AS recall FROM (
 SELECT h.threshold, count(*) FILTER (WHERE s>=h.threshold AND label=1) AS tp, count(*) FILTER (WHERE s>=h.threshold AND label<>1) AS fp, count(*) FILTER (WHERE s<h.threshold AND label=1) AS fn
 FROM (SELECT CASE WHEN score>1 THEN score/100 ELSE score END AS s, label FROM scored_pairs), (SELECT unnest([0.4,0.45,0.5,0.55,0.6,0.65,0.7,0.75,0.8]::DOUBLE[]) AS threshold) h GROUP BY h.threshold))"""


@query("threshold_sweep", "SELECT threshold, tp, fp, fn, round(precision,9) AS precision, round(recall,9) AS recall FROM sweep", "scored_pairs", ctes=SWEEP)
def threshold_sweep(t):
    return V.threshold_sweep(t.scored_pairs).withColumns({"precision": F.round("precision", 9), "recall": F.round("recall", 9)})


@query("best_threshold", "SELECT threshold, tp, fp, fn FROM sweep ORDER BY precision DESC NULLS LAST, threshold LIMIT 1", "scored_pairs", ctes=SWEEP)
def best_threshold(t):
    return V.best_threshold(V.threshold_sweep(t.scored_pairs)).select("threshold", "tp", "fp", "fn")


CLEAN = "parse_success AND NOT missing_keys AND NOT wrong_types"


def p95(source: str, value: str) -> str:
    return f"""(SELECT variant, round(avg(v),4) AS mean, max(v) AS top, count(*) AS n, round(CASE WHEN count(*)>=20 THEN
  (list_extract(list(v ORDER BY v), CAST((count(*)+1)*19//20 AS INT))*(20-(count(*)+1)*19%20) + list_extract(list(v ORDER BY v), CAST((count(*)+1)*19//20+1 AS INT))*((count(*)+1)*19%20))/20 ELSE max(v) END,4) AS p95
  FROM (SELECT variant, {value} AS v FROM {source}) WHERE v IS NOT NULL GROUP BY variant)"""


@query("variant_latency_stats", f"""
SELECT r.variant, n_calls, n_parsed, n_clean, round(n_parsed/n_calls,4) AS json_parse_rate, round(n_clean/n_calls,4) AS clean_rate, c.mean AS mean_latency_ms, c.p95 AS p95_latency_ms, c.top AS max_latency_ms,
 t.mean AS mean_total_ms, t.p95 AS p95_total_ms, t.top AS max_total_ms, t.n AS n_listings
FROM (SELECT variant, count(*) AS n_calls, count(*) FILTER (WHERE parse_success) AS n_parsed, count(*) FILTER (WHERE {CLEAN}) AS n_clean FROM calls GROUP BY variant) r
LEFT JOIN {p95('calls', 'latency_ms')} c ON c.variant=r.variant
LEFT JOIN {p95('(SELECT variant, uid, repeat_idx, CAST(sum(latency_ms) AS BIGINT) AS total FROM calls WHERE latency_ms IS NOT NULL GROUP BY variant, uid, repeat_idx)', 'total')} t ON t.variant=r.variant""", "calls")
def variant_latency_stats(t):
    return V.variant_latency_stats(t.calls)


@query("baseline_agreement", f"""
SELECT c.variant, count(*) AS agreement_total, count(*) FILTER (WHERE c.carpet=b.majority) AS agreement_n, round(count(*) FILTER (WHERE c.carpet=b.majority)/count(*),4) AS agreement_rate
FROM calls c JOIN (SELECT uid, photo_idx, count(*) FILTER (WHERE carpet)*2>=count(*) AS majority FROM calls WHERE variant='baseline' AND parse_success AND carpet IS NOT NULL GROUP BY uid, photo_idx) b
 ON b.uid=c.uid AND b.photo_idx=c.photo_idx WHERE c.parse_success AND NOT c.missing_keys AND NOT c.wrong_types AND c.carpet IS NOT NULL GROUP BY c.variant""", "calls")
def baseline_agreement(t):
    return V.baseline_agreement(t.calls)


@query("failure_buckets", "SELECT variant, split_part(failure_class,':',1) AS bucket, count(*) AS n FROM calls WHERE failure_class IS NOT NULL GROUP BY 1, 2", "calls")
def failure_buckets(t):
    return V.failure_buckets(t.calls)


LAST = """last_calls AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid, photo_idx, model ORDER BY repeat_idx DESC, latency_ms DESC NULLS LAST, parse_success DESC, missing_keys DESC, wrong_types DESC, room_type DESC, carpet DESC NULLS LAST) AS rn FROM calls) WHERE rn=1),
paired AS (SELECT a.uid, a.photo_idx, a.room_type AS ra, b.room_type AS rb, a.carpet AS ca, b.carpet AS cb FROM last_calls a JOIN last_calls b ON a.uid=b.uid AND a.photo_idx=b.photo_idx AND a.model='model_x' AND b.model='model_y'
 WHERE a.parse_success AND NOT a.missing_keys AND NOT a.wrong_types AND b.parse_success AND NOT b.missing_keys AND NOT b.wrong_types)"""


@query("inter_model_agreement", """
SELECT count(*) AS n_paired_clean, round(count(*) FILTER (WHERE ra=rb)/count(*),4) AS room_type_agree_rate, round(count(*) FILTER (WHERE ca IS NOT DISTINCT FROM cb)/count(*),4) AS carpet_agree_rate FROM paired""",
       "calls", ctes=LAST)
def inter_model_agreement(t):
    return V.inter_model_agreement(t.calls, "model_x", "model_y")


@query("model_disagreements", "SELECT uid, photo_idx, ra AS first_value, rb AS second_value FROM paired WHERE ra<>rb ORDER BY uid, photo_idx LIMIT 20", "calls", ctes=LAST)
def model_disagreements(t):
    return V.model_disagreements(t.calls, "model_x", "model_y")


@query("flip_matrix", """
SELECT flip, count(*) AS n FROM (SELECT CASE WHEN o IS NOT DISTINCT FROM w THEN 'unchanged' WHEN o IS NULL AND w THEN 'none_to_true' WHEN o IS NULL THEN 'none_to_false' WHEN w IS NULL AND o THEN 'to_none_from_True'
 WHEN w IS NULL THEN 'to_none_from_False' WHEN o THEN 'true_to_false' ELSE 'false_to_true' END AS flip FROM (SELECT carpet_in_bedroom AS o, carpet_other_areas AS w FROM listings)) GROUP BY flip""", "listings")
def flip_matrix(t):
    return V.flip_matrix(t.listings, "carpet_in_bedroom", "carpet_other_areas")


GROUPS = {"required": V.REQUIRED, "optional": V.OPTIONAL, "enrichment": V.ENRICHMENT}
TEXTUAL = set("uid portal property_id url title area address postcode furnished images epc_rating nearest_station region".split())
FLAGS = set("carpet_in_bedroom carpet_other_areas is_let_agreed commute_pass_40min".split())
ABSENT = {"let_available_date", "cycle_minutes", "commute_pass_40min"}


def coverage_sql(kind: str, f: str) -> str:
    if f in ABSENT:
        return "0"
    return f"count(*) FILTER (WHERE {f} IS NOT NULL" + (f" AND {f}<>''" if f in TEXTUAL else "") + (f" AND {f}" if f in FLAGS and kind == "enrichment" else "") + ")"


@query("field_coverage", " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, '{f}' AS field, {coverage_sql(kind, f)} AS present, count(*) AS total, {coverage_sql(kind, f)}=count(*) AS complete FROM flagged"
    for kind, fields in GROUPS.items() for f in fields), "listings",
       ctes=f"flagged AS (SELECT *, coalesce({LET},FALSE) AS is_let_agreed FROM listings WHERE portal='portal_c')")
def field_coverage(t):
    rows = t.listings.filter("portal = 'portal_c'").withColumn("is_let_agreed", is_let_agreed_title(F.col("title")))
    return V.field_coverage(rows)


EXPECTED = """slugged AS (SELECT *, CASE WHEN room_truth='bedroom' THEN coalesce(bedroom_slug,'bedroom_'||CAST(row_number() OVER (PARTITION BY uid, room_truth='bedroom' AND bedroom_slug IS NULL ORDER BY photo_idx) AS STRING)) END AS slug FROM photo_predictions),
expected AS (SELECT uid, least(count(DISTINCT slug), any_value(bedrooms_declared)) AS bedrooms_seen, least(count(DISTINCT slug) FILTER (WHERE has_carpet_truth), any_value(bedrooms_declared)) AS bedrooms_with_carpet,
 bool_or(room_truth IN ('living-room','hallway','dining-room') AND has_carpet_truth) AS has_living_area_carpet, count(*) FILTER (WHERE room_truth='bedroom') AS beds, nullif(any_value(bedrooms_declared),0) AS declared FROM slugged GROUP BY uid)"""


@query("label_expected_rollup", "SELECT uid, bedrooms_seen, bedrooms_with_carpet, has_living_area_carpet FROM expected", "photo_predictions", ctes=EXPECTED)
def label_expected_rollup(t):
    return V.label_expected_rollup(t.photo_predictions)


@query("photo_diff", """
SELECT count(*) AS n, count(*) FILTER (WHERE room_truth IS NOT DISTINCT FROM room_type) AS room_ok, count(carpet) AS judged, count(*) FILTER (WHERE carpet IS NOT NULL AND has_carpet_truth=carpet) AS carpet_ok FROM photo_predictions""", "photo_predictions")
def photo_diff(t):
    return V.photo_diff(t.photo_predictions).agg(
        F.count("*").alias("n"), F.count_if("room_match").alias("room_ok"), F.count("carpet_match").alias("judged"), F.count_if("carpet_match").alias("carpet_ok"))


@query("prediction_vs_truth", """
SELECT count(*) AS n_evaluated, count(*) FILTER (WHERE least(p.seen, e.declared)=e.bedrooms_seen) AS bedrooms_seen_ok, count(*) FILTER (WHERE least(p.with_carpet, e.declared)=e.bedrooms_with_carpet) AS bedrooms_with_carpet_ok,
 count(*) FILTER (WHERE (p.living2>=2 AND p.living2*2>p.living)=e.has_living_area_carpet) AS living_area_ok
FROM expected e JOIN (SELECT uid, count(*) FILTER (WHERE room_type='bedroom') AS seen, count(*) FILTER (WHERE room_type='bedroom' AND carpet) AS with_carpet,
 count(*) FILTER (WHERE room_type IN ('living-room','hallway','dining-room')) AS living, count(*) FILTER (WHERE room_type IN ('living-room','hallway','dining-room') AND carpet) AS living2 FROM photo_predictions GROUP BY uid) p ON p.uid=e.uid
WHERE e.beds>0""", "photo_predictions", ctes=EXPECTED)
def prediction_vs_truth(t):
    return V.prediction_vs_truth(t.photo_predictions, enrich.photo_rollup_two_step(t.photo_predictions))


@query("geo_delta_stats", """
SELECT count(*) AS n, list_extract(list(m ORDER BY m), CAST(count(*)//2+1 AS INT)) AS upper_median, round(avg(m),3) AS mean FROM (
 SELECT round(2*6371000.0*asin(sqrt(power(sin(radians(l.latitude-p.lat)/2),2)+cos(radians(p.lat))*cos(radians(l.latitude))*power(sin(radians(l.longitude-p.lng)/2),2))),3) AS m
 FROM (SELECT *, coalesce(lat,hist_lat) AS plat FROM postcode_lookup) q JOIN (SELECT postcode_key, coalesce(lat,hist_lat) AS lat, coalesce(lng,hist_lng) AS lng FROM postcode_lookup) p ON p.postcode_key=q.postcode_key
 JOIN listings l ON upper(replace(l.postcode,' ',''))=p.postcode_key WHERE p.lat IS NOT NULL AND p.lng IS NOT NULL AND l.latitude IS NOT NULL)""", "postcode_lookup", "listings")
def geo_delta_stats(t):
    placed = enrich.postcode_to_coords(t.listings, t.postcode_lookup).filter("pc_lat IS NOT NULL AND pc_lng IS NOT NULL AND latitude IS NOT NULL")
    metres = F.round(haversine(F.col("pc_lat"), F.col("pc_lng"), F.col("latitude"), F.col("longitude")), 3)
    return V.geo_delta_stats(placed.select(metres.alias("metres")))


@query("scrape_outcome_stats", """
SELECT portal, measure, count(*) AS n FROM (SELECT portal, CASE WHEN success THEN 'successful' ELSE 'failed' END AS measure FROM outcomes
 UNION ALL SELECT portal, 'error:'||split_part(error,':',1) FROM outcomes WHERE NOT success AND error IS NOT NULL) GROUP BY portal, measure""", "outcomes")
def scrape_outcome_stats(t):
    return V.scrape_outcome_stats(t.outcomes)
