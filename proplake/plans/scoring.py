"""Hard filters, freshness of rules, and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from proplake import config as C
from proplake.operators import gate, score
from proplake.plans.registry import query

HARD = C.DEFAULTS["hard_filters"]
LET = r"regexp_matches(title,'(?i)\blet\s*agreed\b|\bunder\s*offer\b|\blet\s*by\b|\bnow\s*let\b|\btenanted\b')"
FIRST_FAIL = f"""
gated AS (SELECT *, price_numeric // 100 AS pcm, coalesce({LET}, FALSE) AS is_let_agreed FROM listings),
failing AS (SELECT *, CASE
  WHEN pcm IS NULL OR pcm < 1600 OR pcm > 2800 THEN 'price'
  WHEN bedrooms IS NULL OR bedrooms < 1 OR bedrooms > 2 THEN 'bedrooms'
  WHEN upper(epc_rating) IN ('E','F','G') THEN 'epc'
  WHEN tfl_zone > 3 THEN 'tfl_zone'
  WHEN size_sqft < 400 THEN 'size_sqft'
  WHEN is_let_agreed THEN 'let_agreed' END AS first_fail FROM gated)"""


def gated(t):
    return t.listings.withColumn("is_let_agreed", gate.is_let_agreed_title(F.col("title")))


@query("hard_filter", "SELECT uid, pcm AS price_pcm, bedrooms, epc_rating, tfl_zone, size_sqft FROM failing WHERE first_fail IS NULL",
       "listings", ctes=FIRST_FAIL)
def hard_filter(t):
    return gate.hard_filter(gated(t), HARD).select(
        "uid", gate.price_pcm(F.col("price_numeric")).alias("price_pcm"), "bedrooms", "epc_rating", "tfl_zone", "size_sqft"
    )


@query("hard_filter_drops", """
SELECT r.rule, count(f.uid) AS dropped FROM (VALUES ('price'),('bedrooms'),('epc'),('tfl_zone'),('size_sqft'),('let_agreed'),('region')) r(rule)
LEFT JOIN failing f ON f.first_fail=r.rule GROUP BY r.rule""", "listings", ctes=FIRST_FAIL)
def hard_filter_drops(t):
    return gate.hard_filter_drops(gated(t), HARD)


STRICT = {**HARD, "epc_drop_null": True, "epc_min_rating": "C", "region_drop_unlisted": True, "drop_let_agreed": False,
          "size_sqft_min": None}


@query("hard_filter_regions", """
SELECT r.rule, count(f.rule) AS dropped FROM (VALUES ('price'),('bedrooms'),('epc'),('tfl_zone'),('region')) r(rule)
LEFT JOIN (SELECT CASE WHEN price_numeric IS NULL OR price_numeric//100 < 1600 OR price_numeric//100 > 2800 THEN 'price'
   WHEN bedrooms IS NULL OR bedrooms NOT BETWEEN 1 AND 2 THEN 'bedrooms'
   WHEN epc_rating IS NULL OR upper(epc_rating) NOT IN ('A','B','C') THEN 'epc'
   WHEN tfl_zone > 3 THEN 'tfl_zone'
   WHEN region IS NULL OR region = 'Other' THEN 'region' END AS rule FROM listings) f ON f.rule=r.rule GROUP BY r.rule""", "listings")
def hard_filter_regions(t):
    return gate.hard_filter_drops(t.listings, STRICT)


@query("skip_non_flat", """
SELECT portal, count(*) FILTER (WHERE bedrooms IS NOT NULL AND price_numeric IS NOT NULL) AS kept,
 count(*) FILTER (WHERE bedrooms IS NULL OR price_numeric IS NULL) AS failed FROM listings GROUP BY portal""", "listings")
def skip_non_flat(t):
    kept = gate.skip_non_flat(t.listings).groupBy("portal").agg(F.count("*").alias("kept"))
    total = t.listings.groupBy("portal").agg(F.count("*").alias("total"))
    return total.join(kept, "portal", "left").select(
        "portal", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("total") - F.coalesce("kept", F.lit(0))).alias("failed")
    )


@query("candidate_cap", """
SELECT profile, property_id, pos, rn AS rank_in_profile FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY pos) AS rn FROM discoveries)
WHERE rn <= 40""", "discoveries")
def candidate_cap(t):
    return gate.candidate_cap(t.discoveries, 40).select("profile", "property_id", "pos", "rank_in_profile")


@query("let_agreed_title", f"SELECT uid, coalesce({LET}, FALSE) AS is_let_agreed FROM listings", "listings")
def let_agreed_title(t):
    return gated(t).select("uid", "is_let_agreed")


STAGE2 = "stage2 AS (SELECT uid, size_sqft + 150 AS size_sqft, CASE WHEN bedrooms_with_carpet>1 THEN 'F' END AS epc_rating FROM listings WHERE size_sqft IS NOT NULL OR bedrooms_with_carpet IS NOT NULL)"


def stage2(t):
    return t.listings.filter(F.col("size_sqft").isNotNull() | F.col("bedrooms_with_carpet").isNotNull()).select(
        "uid", (F.col("size_sqft") + 150).alias("size_sqft"), F.when(F.col("bedrooms_with_carpet") > 1, "F").alias("epc_rating")
    )


@query("two_stage_gate", """
SELECT s.uid, coalesce(e.size_sqft, s.size_sqft) AS size_sqft, coalesce(e.epc_rating, s.epc_rating) AS epc_rating,
 CASE WHEN coalesce(e.epc_rating, s.epc_rating) IN ('E','F','G') THEN 'epc' WHEN coalesce(e.size_sqft, s.size_sqft) < 400 THEN 'size_sqft' END AS dropped_by
FROM failing s LEFT JOIN stage2 e ON e.uid=s.uid WHERE s.first_fail IS NULL""", "listings", ctes=FIRST_FAIL + ",\n" + STAGE2)
def two_stage_gate(t):
    return gate.two_stage_gate(gated(t), stage2(t), HARD).select(
        "uid", "size_sqft", "epc_rating", F.col("first_fail").alias("dropped_by"))


# --- score components -------------------------------------------------------------------------------------
PRICE = "CASE WHEN pcm IS NULL OR pcm<=0 THEN 0 WHEN pcm<=2800 THEN 100 WHEN pcm>=3200 THEN 0 ELSE CAST(round_even((3200-pcm)*100/400,0) AS INT) END"
SIZE = "CASE WHEN size_sqft IS NULL THEN 50 WHEN size_sqft>=650 THEN 100 WHEN size_sqft<=400 THEN 0 ELSE CAST(round_even((size_sqft-400)*100/250,0) AS INT) END"
BEDS = "CASE WHEN bedrooms IS NULL OR bedrooms=0 THEN 0 WHEN bedrooms=1 THEN 50 ELSE 100 END"
RATING = "CASE WHEN epc_rating IS NULL THEN 0 WHEN upper(epc_rating) IN ('A','B','C') THEN 100 WHEN upper(epc_rating)='D' THEN 40 WHEN upper(epc_rating) IN ('E','F','G') THEN 0 ELSE 50 END"
JOURNEY = "CASE WHEN mins<=15 THEN 100 WHEN mins<=25 THEN 80 WHEN mins<=35 THEN 60 WHEN mins<=45 THEN 30 ELSE 0 END"
ZONE = "CASE WHEN tfl_zone IS NULL THEN 50 WHEN tfl_zone<=2 THEN 100 WHEN tfl_zone=3 THEN 50 ELSE 0 END"
TRANSPORT = f"CASE WHEN mins IS NULL AND tfl_zone IS NULL THEN 50 WHEN mins IS NULL THEN {ZONE} ELSE CAST(round_even(({JOURNEY})*0.75::DOUBLE+({ZONE})*0.25::DOUBLE,0) AS INT) END"
OUTSIDE = "CASE WHEN garden THEN 100 WHEN balcony THEN 60 ELSE 0 END"
REGION = """CASE WHEN region IS NULL OR region='' THEN 0 WHEN region IN ('Highbury, North London','Hoxton, North London','Dalston, East London') THEN 100
 WHEN region IN ('Archway, London','Holborn, Central London') THEN 75 WHEN region IN ('Walthamstow','Hampstead, North West London') THEN 50 ELSE 75 END"""
PATH = """CASE WHEN carpet_detected IS NOT NULL OR (bedrooms_with_carpet IS NULL AND has_living_area_carpet IS NULL AND carpet_in_bedroom IS NULL AND carpet_other_areas IS NULL) THEN 'binary'
 WHEN (bedrooms_with_carpet IS NOT NULL OR has_living_area_carpet IS NOT NULL) AND ({w} OR (carpet_in_bedroom IS NULL AND carpet_other_areas IS NULL)) THEN 'count' ELSE 'split' END"""
BINARY = "CASE WHEN carpet_detected IS NULL THEN 50 WHEN carpet_detected THEN 20 ELSE 100 END"
COUNTED = "CASE WHEN bedrooms_with_carpet IS NULL AND has_living_area_carpet IS NULL THEN 50 WHEN has_living_area_carpet THEN 0 WHEN bedrooms_with_carpet IS NULL THEN 50 ELSE 50 END"
IN_BED = "CASE WHEN carpet_in_bedroom IS NULL THEN 50 WHEN carpet_in_bedroom THEN 30 ELSE 100 END"
IN_OTHER = "CASE WHEN carpet_other_areas IS NULL THEN 50 WHEN carpet_other_areas THEN 0 ELSE 100 END"


def scored_cte(name: str, weights: dict, minutes: str = "least(commute_primary, commute_secondary)") -> str:
    w = {k: f"{float(v)!r}::DOUBLE" for k, v in weights.items()}
    region_weight = w.get("region_pref", w.get("region_tier", "0.0::DOUBLE"))
    z = "0.0::DOUBLE"
    base = " + ".join(f"c_{n}*{w.get(n, z)}" for n in score.COMPONENTS)
    path = PATH.format(w="TRUE" if weights.get("carpet", 0) > 0 else "FALSE")
    return f"""
{name}_in AS (SELECT *, price_numeric//100 AS pcm, {minutes} AS mins FROM listings),
{name}_parts AS (SELECT *, {PRICE} AS c_price, {SIZE} AS c_size, {BEDS} AS c_bedrooms, {RATING} AS c_epc, {TRANSPORT} AS c_transport,
  {OUTSIDE} AS c_outside, {REGION} AS c_region, {path} AS path FROM {name}_in),
{name} AS (SELECT * EXCLUDE (score, score_breakdown), CAST(round_even((CASE path WHEN 'binary' THEN {base} + ({BINARY})*{w.get('carpet', z)}
  WHEN 'count' THEN {base} + ({COUNTED})*{w.get('carpet', z)}
  ELSE {base} + ({IN_BED})*{w.get('carpet_bedroom', z)} + ({IN_OTHER})*{w.get('carpet_other_areas', z)} END) + c_region*{region_weight}, 0) AS INT) AS score,
  CASE path WHEN 'binary' THEN {BINARY} WHEN 'count' THEN {COUNTED} END AS c_carpet,
  CASE path WHEN 'split' THEN {IN_BED} END AS c_bed_carpet, CASE path WHEN 'split' THEN {IN_OTHER} END AS c_other_carpet FROM {name}_parts)"""


SEED = C.seed_weights()
SCORED = scored_cte("scored", SEED)
PCM = "pcm_in AS (SELECT *, price_numeric//100 AS pcm, least(commute_primary, commute_secondary) AS mins FROM listings)"


def one_score(name: str, sql_expr: str, column):
    @query(name, f"SELECT uid, {sql_expr} AS {name} FROM pcm_in", "listings", ctes=PCM)
    def run(t):
        return t.listings.select("uid", column().cast("int").alias(name))


one_score("score_price", PRICE, lambda: score.price_score(gate.price_pcm(F.col("price_numeric"))))
one_score("score_size", SIZE, lambda: score.size_score(F.col("size_sqft")))
one_score("score_bedrooms", BEDS, lambda: score.bedrooms_score(F.col("bedrooms")))
one_score("score_rating", RATING, lambda: score.rating_score(F.col("epc_rating")))
one_score("score_rating_neutral", RATING.replace("IS NULL THEN 0", "IS NULL THEN 50"),
          lambda: score.rating_score(F.col("epc_rating"), null_score=50))
one_score("score_transport", TRANSPORT, lambda: score.transport_score(
    F.least("commute_primary", "commute_secondary"), F.col("tfl_zone")))
one_score("score_outside", OUTSIDE, lambda: score.outside_score(F.col("garden"), F.col("balcony")))
one_score("score_region", REGION, lambda: score.region_score(F.col("region")))

@query("score_band", """
SELECT CASE WHEN score IS NULL THEN 'unscored' WHEN score>=80 THEN 'high' WHEN score>=60 THEN 'alert' ELSE 'below' END AS band, count(*) AS n
FROM listings GROUP BY 1""", "listings")
def score_band(t):
    return t.listings.groupBy(score.score_band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))


COUNT_BLOCK = {"bedrooms_with_carpet_score": {0: 100, 1: 75, 2: 20}, "has_living_area_carpet_override": 0, "null_score": 50}


@query("score_carpet", f"""
SELECT uid, {BINARY} AS binary_score, {IN_BED} AS bedroom_score, {IN_OTHER} AS other_score,
 CASE WHEN bedrooms_with_carpet IS NULL AND has_living_area_carpet IS NULL THEN 50 WHEN has_living_area_carpet THEN 0
  WHEN bedrooms_with_carpet IS NULL THEN 50 WHEN bedrooms_with_carpet=0 THEN 100 WHEN bedrooms_with_carpet=1 THEN 75 ELSE 20 END AS count_score,
 CASE WHEN carpet_detected IS NULL THEN 50 WHEN carpet_detected THEN CAST(round_even(50+50*coalesce(carpet_confidence,0.0),0) AS INT)
  ELSE CAST(round_even(50-50*coalesce(carpet_confidence,0.0),0) AS INT) END AS legacy_score FROM listings""", "listings")
def score_carpet(t):
    blocks = C.DEFAULTS["scoring"]["components"]
    return t.listings.select(
        "uid", score.flag_score(F.col("carpet_detected"), blocks["carpet"]).alias("binary_score"),
        score.flag_score(F.col("carpet_in_bedroom"), blocks["carpet_bedroom"]).alias("bedroom_score"),
        score.flag_score(F.col("carpet_other_areas"), blocks["carpet_other_areas"]).alias("other_score"),
        score.carpet_count_score(F.col("bedrooms_with_carpet"), F.col("has_living_area_carpet"), COUNT_BLOCK).alias("count_score"),
        score.carpet_legacy_score(F.col("carpet_detected"), F.col("carpet_confidence")).alias("legacy_score"),
    )


@query("carpet_path_select", f"SELECT uid, {PATH.format(w='TRUE')} AS path, {PATH.format(w='FALSE')} AS path_unweighted FROM listings", "listings")
def carpet_path_select(t):
    return t.listings.select("uid", score.carpet_path({"carpet": 0.25}).alias("path"), score.carpet_path({}).alias("path_unweighted"))


@query("tier_curve", """
SELECT uid, CASE WHEN lvl IS NULL THEN 50 WHEN lvl<=3 THEN 100 WHEN lvl<=6 THEN 90 WHEN lvl<=10 THEN 70 ELSE 30 END AS floor_score,
 CASE WHEN tube_distance IS NULL THEN 50 WHEN tube_distance<=2 THEN 30 WHEN tube_distance<=4 THEN 70 ELSE 100 END AS photo_score
FROM (SELECT *, CASE WHEN lower(trim(floor_level)) IN ('ground','ground floor','gr','g') THEN 0
 ELSE TRY_CAST(nullif(regexp_extract(lower(trim(floor_level)),'^(-?\\d+)',1),'') AS INT) END AS lvl FROM listings)""", "listings")
def tier_curve(t):
    from proplake.functions.text import floor_level_int

    blocks = C.DEFAULTS["scoring"]["components"]
    return t.listings.select(
        "uid", score.tier_curve(floor_level_int(F.col("floor_level")), blocks["floor_level_high"]["tiers"]).alias("floor_score"),
        score.tier_curve(F.col("tube_distance"), blocks["photo_count"]["tiers"]).alias("photo_score"),
    )


@query("score_total", """
SELECT uid, score, c_price AS comp_price, c_size AS comp_size, c_bedrooms AS comp_bedrooms, c_epc AS comp_epc, c_transport AS comp_transport,
 c_outside AS comp_outside, c_carpet AS comp_carpet, c_region AS comp_region_pref FROM scored""", "listings", ctes=SCORED)
def score_total(t):
    return score.with_score(t.listings.drop("score", "score_breakdown")).select(
        "uid", "score", *[f"comp_{n}" for n in score.COMPONENTS], "comp_carpet", "comp_region_pref")


SPLIT_WEIGHTS = {"price": 0.25, "carpet_bedroom": 0.15, "carpet_other_areas": 0.1, "size": 0.2, "bedrooms": 0.1, "epc": 0.05,
                 "transport": 0.1, "outside": 0.05}


@query("score_total_no_region", "SELECT uid, score, c_bed_carpet AS comp_carpet_bedroom, c_other_carpet AS comp_carpet_other_areas FROM split_scored",
       "listings", ctes=scored_cte("split_scored", {**SPLIT_WEIGHTS, "region_pref": 0.0}))
def score_total_no_region(t):
    scored = score.with_score(t.listings.drop("score", "score_breakdown"), weights=SPLIT_WEIGHTS, with_region=False)
    return scored.select("uid", "score", "comp_carpet_bedroom", "comp_carpet_other_areas")


@query("latest_weights", """
SELECT key AS component, CAST(value AS DOUBLE) AS weight FROM (SELECT arg_max(weights_json, id) AS w FROM weights_log) t, json_each(t.w)""", "weights_log")
def latest_weights(t):
    return score.weights_table(t.weights_log)


NEWEST = {"price": 0.24, "carpet": 0.25, "size": 0.2, "bedrooms": 0.1, "epc": 0.05, "transport": 0.1, "outside": 0.0, "region_pref": 0.05}


@query("rescore_active", "SELECT uid, score FROM rescored WHERE is_active", "listings",
       ctes=scored_cte("rescored", NEWEST, "coalesce(nullif(commute_primary,0), commute_secondary)"))
def rescore_active(t):
    return score.rescore_active(t.listings, score.latest_weights(t.weights_log)).select("uid", "score")


@query("rescore_weights_row", """
SELECT (SELECT count(*) FROM grown) AS n_rows, max(id) AS id, arg_max(CAST(json_extract_string(weights_json,'$.price') AS DOUBLE), id) AS price FROM grown""", "weights_log", ctes="""
grown AS (SELECT id, weights_json FROM weights_log UNION ALL SELECT max(id)+1, '{"price": 0.5, "size": 0.5}' FROM weights_log)""")
def rescore_weights_row(t):
    """Rescoring appends its weights to the log, where the next run finds them as the newest."""
    from proplake.plans.scratch import scratch_folder
    from proplake.sources import sinks

    folder = scratch_folder(t.spark, "weights")
    sinks.append_events(t.weights_log, folder)
    sinks.append_events(score.weights_row(t.spark.read.parquet(folder), {"price": 0.5, "size": 0.5}), folder)
    log = t.spark.read.parquet(folder)
    newest = F.from_json(F.max_by("weights_json", "id"), "map<string,double>")
    return log.agg(F.count("*").alias("n_rows"), F.max("id").alias("id"), newest["price"].alias("price"))


EXPECTED_KEYS = score.COMPONENTS + ["carpet_bedroom", "carpet_other_areas", "region_pref"]


@query("breakdown_key_histogram", """
SELECT key, n AS n_rows, n=(SELECT count(*) FROM listings) AS on_every_row, key<>'carpet' AS expected FROM (
 SELECT unnest(['price','size','bedrooms','epc','transport','outside','region_pref']) AS key, count(*) AS n FROM scored GROUP BY 1
 UNION ALL SELECT 'carpet', count(*) FROM scored WHERE c_carpet IS NOT NULL
 UNION ALL SELECT unnest(['carpet_bedroom','carpet_other_areas']), count(*) FROM scored WHERE c_bed_carpet IS NOT NULL GROUP BY 1) WHERE n>0""",
       "listings", ctes=SCORED)
def breakdown_key_histogram(t):
    return score.breakdown_key_histogram(score.with_score(t.listings.drop("score", "score_breakdown")), EXPECTED_KEYS)


@query("primary_commute", """
SELECT uid, least(commute_primary, commute_secondary) AS commute_min, coalesce(nullif(commute_primary,0), commute_secondary) AS commute_first
FROM listings""", "listings")
def primary_commute(t):
    a, b = F.col("commute_primary"), F.col("commute_secondary")
    return t.listings.select("uid", score.primary_commute(a, b).alias("commute_min"), score.primary_commute(a, b, "first").alias("commute_first"))


@query("count_above_threshold", "SELECT count(*) AS n_active, count(*) FILTER (WHERE score>=60) AS n_above FROM listings WHERE is_active", "listings")
def count_above_threshold(t):
    return score.count_above_threshold(t.listings)


@query("top_n_above_threshold", "SELECT uid, score FROM listings WHERE is_active AND score>=60 ORDER BY score DESC, uid LIMIT 25", "listings")
def top_n_above_threshold(t):
    return score.top_n_above_threshold(t.listings, 25).select("uid", "score")


@query("top_scored_survivors", """
SELECT s.uid, s.portal, s.pcm AS price_pcm, s.bedrooms, s.score FROM scored s JOIN failing f ON f.uid=s.uid WHERE f.first_fail IS NULL
ORDER BY s.score DESC, s.uid LIMIT 20""", "listings", ctes=SCORED + ",\n" + FIRST_FAIL)
def top_scored_survivors(t):
    """The flagship job: hard-filter the snapshot, score the survivors, serve the first page."""
    survivors = gate.hard_filter(gated(t).drop("score", "score_breakdown"), HARD)
    return score.with_score(survivors).orderBy(F.desc("score"), "uid").limit(20).select(
        "uid", "portal", gate.price_pcm(F.col("price_numeric")).alias("price_pcm"), "bedrooms", "score")


@query("config_as_tables", """
SELECT tier, count(*) AS n, count(*) FILTER (WHERE is_active) AS n_active FROM (SELECT is_active, CASE
 WHEN region IN ('Highbury, North London','Hoxton, North London','Dalston, East London') THEN 'tier_1'
 WHEN region IN ('Archway, London','Holborn, Central London') THEN 'tier_2' WHEN region IN ('Walthamstow','Hampstead, North West London') THEN 'tier_3'
 ELSE 'unlisted' END AS tier FROM listings) GROUP BY tier""", "listings")
def config_as_tables(t):
    from proplake.sources.readers import region_tiers_table

    return t.listings.join(F.broadcast(region_tiers_table(t.spark)), "region", "left").groupBy(
        F.coalesce("tier", F.lit("unlisted")).alias("tier")
    ).agg(F.count("*").alias("n"), F.count_if("is_active").alias("n_active"))


@query("config_curves", """
SELECT component, curve_score, count(*) AS n FROM (
 SELECT 'transport' AS component, CASE WHEN commute_primary IS NULL THEN 50 WHEN commute_primary<=15 THEN 100 WHEN commute_primary<=25 THEN 80 WHEN commute_primary<=35 THEN 60 WHEN commute_primary<=45 THEN 30 ELSE 0 END AS curve_score FROM listings
 UNION ALL SELECT 'photo_count', CASE WHEN tube_distance IS NULL THEN 50 WHEN tube_distance<=2 THEN 30 WHEN tube_distance<=4 THEN 70 ELSE 100 END FROM listings) GROUP BY component, curve_score""", "listings")
def config_curves(t):
    """Two values of every listing scored from the table of configured curves (the short distance stands for a count)."""
    from proplake.sources.readers import tier_curves_table

    pairs = F.array(*[F.struct(F.lit(name).alias("component"), F.col(column).cast("long").alias("value")) for name, column in (("transport", "commute_primary"), ("photo_count", "tube_distance"))])
    values = t.listings.select("uid", F.explode(pairs).alias("v")).select("uid", "v.*")
    return score.curve_scores(values, tier_curves_table(t.spark)).groupBy("component", "curve_score").agg(F.count("*").alias("n"))


SEARCH = {"defaults": {"min_price": 1500}, "profiles": [
    {"name": "near", "locations": [{"name": "Hoxton", "region_id": "REGION^1"}, {"name": "Dalston", "region_id": "REGION^2"}], "overrides": {"max_price": 2500}},
    {"name": "large", "locations": [{"name": "Archway", "region_id": "STATION^3"}], "overrides": {"min_bedrooms": 2, "max_bedrooms": 4, "max_price": 4000}}]}


@query("config_profiles", """
SELECT p.profile, p.location, count(*) AS n, count(*) FILTER (WHERE is_active) AS n_active FROM listings l
JOIN (VALUES ('near','Hoxton',1500,2500,1,2),('near','Dalston',1500,2500,1,2),('large','Archway',1500,4000,2,4)) p(profile, location, lo, hi, few, many)
ON l.price_numeric//100 BETWEEN p.lo AND p.hi AND l.bedrooms BETWEEN p.few AND p.many GROUP BY p.profile, p.location""", "listings")
def config_profiles(t):
    from proplake.sources.readers import profiles_table

    return score.in_profiles(t.listings, profiles_table(t.spark, SEARCH)).groupBy("profile", "location").agg(
        F.count("*").alias("n"), F.count_if("is_active").alias("n_active"))


@query("config_region_scores", "SELECT uid, c_region AS region_pref FROM region_scored", "listings", ctes="""region_scored AS (SELECT uid, CASE WHEN region IS NULL OR region='' THEN 0
 WHEN region IN ('Highbury, North London','Hoxton, North London','Dalston, East London') THEN 100 WHEN region IN ('Archway, London','Holborn, Central London') THEN 75
 WHEN region IN ('Walthamstow','Hampstead, North West London') THEN 50 ELSE 75 END AS c_region FROM listings)""")
def config_region_scores(t):
    from proplake.sources.readers import region_tiers_table

    return score.region_score_join(t.listings, region_tiers_table(t.spark).drop("tier")).select("uid", "region_pref")
