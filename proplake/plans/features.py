"""Text features over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from proplake.functions import patterns as P
from proplake.functions import text as X
from proplake.operators import features as T
from proplake.plans.registry import query
from proplake.sources.adapters import TODAY


def texts(t):
    return t.texts.withColumn("features", F.filter(F.array("bullet_1", "bullet_2"), lambda b: b.isNotNull()))


PROSE = "description||' '||coalesce(title,'')"
B = "lower(coalesce(bullet_1,'')||chr(10)||coalesce(bullet_2,''))"


def re2(patterns: list[str]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def verdict(bullet: str, no: list[str], yes: list[str]) -> str:
    return f"CASE WHEN {bullet} THEN TRUE WHEN regexp_matches({PROSE},'{re2(no)}') THEN FALSE ELSE regexp_matches({PROSE},'{re2(yes)}') END"


def first_of(source: str, patterns: list[str]) -> str:
    return "coalesce(" + ",".join(f"nullif(regexp_extract({source},'(?i){p}',1),'')" for p in patterns) + ")"


def by_source(patterns: list[str], *sources: str) -> str:
    return "coalesce(" + ",".join(first_of(f"coalesce({s},'')", patterns) for s in sources) + ")"


GARDEN = verdict(f"contains({B},'garden') AND NOT (contains({B},'no garden') OR contains({B},'without garden'))", P.GARDEN_NO, P.GARDEN_YES)
BALCONY = verdict(f"contains({B},'balcony') OR contains({B},'terrace') OR contains({B},'patio')", P.BALCONY_NO, P.BALCONY_YES)
BILLS = verdict(f"contains({B},'bills included') OR contains({B},'bills inc') OR contains({B},'all bills')", P.BILLS_NO, P.BILLS_YES)
STATE = "CASE " + " ".join(f"WHEN contains(lower({{0}}),'{n}') THEN '{v}'" for n, v in P.FURNISHED_BULLETS) + " END"
FURNISHED = f"coalesce({STATE.format('bullet_1')},{STATE.format('bullet_2')}," + ",".join(
    f"CASE WHEN regexp_matches({PROSE},'(?i){p}') THEN '{v}' END" for p, v in P.FURNISHED_TEXT) + ",'unknown')"
BAND = f"upper({by_source(P.COUNCIL_BAND, 'bullet_1', 'bullet_2', 'description', 'title')})"
AVAILABLE = f"trim({by_source(P.AVAILABLE, 'bullet_1', 'bullet_2', 'description', 'title')})"
RATING = f"upper({by_source(P.RATING, 'bullet_1', 'bullet_2', 'description')})"
SQM_RE2 = P.SQM.replace(r"(?!\w)", r"(?:\W|$)")


def size_of(source: str) -> str:
    s = f"coalesce({source},'')"
    return (f"CASE WHEN regexp_matches({s},'(?i){P.SQFT}') THEN TRY_CAST(replace(regexp_extract({s},'(?i){P.SQFT}',1),',','') AS INT)"
            f" ELSE CAST(round_even(TRY_CAST(replace(nullif(regexp_extract({s},'(?i){SQM_RE2}',1),''),',','') AS INT)*10.7639::DOUBLE,0) AS INT) END")


SIZE = f"coalesce({size_of('bullet_1')},{size_of('bullet_2')},{size_of('description')})"


def one_feature(name: str, sql: str, column):
    @query(name, f"SELECT doc_id, {sql} AS value FROM texts", "texts")
    def run(t):
        return texts(t).select("doc_id", column(F.col("description"), F.col("features"), F.col("title")).alias("value"))


one_feature("feat_garden", GARDEN, T.garden)
one_feature("feat_balcony", BALCONY, T.balcony)
one_feature("feat_bills", BILLS, T.bills_included)
one_feature("feat_furnished", FURNISHED, T.furnished)
one_feature("feat_council_band", BAND, T.council_band)
one_feature("feat_available_raw", AVAILABLE, T.available_raw)
one_feature("feat_size_sqft", SIZE, lambda d, f, t: T.size_sqft(d, f))
one_feature("feat_rating_letter", RATING, lambda d, f, t: T.rating_letter(d, f))

NEAREST = """(SELECT arg_min(name, dist*1000000+ord) FROM (SELECT c.name, c.ord, round(2*3958.8*asin(sqrt(power(sin(radians(texts.latitude-c.lat)/2),2)
 +cos(radians(c.lat))*cos(radians(texts.latitude))*power(sin(radians(texts.longitude-c.lng)/2),2))),9) AS dist FROM centroids c))"""


@query("extract_all_features", f"""
SELECT doc_id, {GARDEN} AS garden, {BALCONY} AS balcony, {BILLS} AS bills_included, {FURNISHED} AS furnished, {BAND} AS council_tax_band,
 {AVAILABLE} AS let_available_date, {SIZE} AS size_sqft, {RATING} AS epc_rating, CASE WHEN latitude IS NOT NULL THEN {NEAREST} END AS region FROM texts""",
       "texts", "centroids")
def extract_all_features(t):
    from proplake.operators.geojoin import nearest_region

    out = nearest_region(T.extract_text_features(texts(t)), t.centroids)
    return out.select("doc_id", "garden", "balcony", "bills_included", "furnished", "council_tax_band", "let_available_date",
                      "size_sqft", "epc_rating", "region")


@query("extraction_miss_report", f"""
SELECT missing, count(*) AS n FROM (SELECT CASE WHEN {SIZE} IS NULL AND {RATING} IS NULL THEN 'size+epc' WHEN {SIZE} IS NULL THEN 'size' WHEN {RATING} IS NULL THEN 'epc' END AS missing FROM texts)
WHERE missing IS NOT NULL GROUP BY missing""", "texts")
def extraction_miss_report(t):
    return T.extraction_miss_report(T.extract_text_features(texts(t)))


@query("extraction_misses", f"""
SELECT doc_id, missing FROM (SELECT doc_id, CASE WHEN {SIZE} IS NULL AND {RATING} IS NULL THEN 'size+epc' WHEN {SIZE} IS NULL THEN 'size' WHEN {RATING} IS NULL THEN 'epc' END AS missing FROM texts)
WHERE missing IS NOT NULL""", "texts")
def extraction_misses(t):
    return T.extraction_misses(T.extract_text_features(texts(t))).select("doc_id", "missing")


MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MNUM = "CASE substr({0},1,3) " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(MONTHS, 1)) + " END"
MRE = "(january|february|march|april|may|june|july|august|september|sept|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)"


def iso(y: str, m: str, d: str) -> str:
    return f"TRY_CAST(lpad(CAST({y} AS STRING),4,'0')||'-'||lpad(CAST({m} AS STRING),2,'0')||'-'||lpad(CAST({d} AS STRING),2,'0') AS DATE)"


def part(p: str, g: int) -> str:
    return f"regexp_extract(v,'{p}',{g})"


DMY, MDY = rf"^(\d{{1,2}})\s+{MRE}\s+(\d{{4}})$", rf"^{MRE}\s+(\d{{1,2}})\s+(\d{{4}})$"
MY, DM = rf"^{MRE}\s+(\d{{4}})$", rf"^(\d{{1,2}})\s+{MRE}$"
YMD, UK = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$"


@query("available_date_norm", f"""
SELECT doc_id, CAST(CASE WHEN a IN ('now','immediately','from now','asap') THEN DATE '{TODAY}' WHEN a IN ('','tbc','available soon') THEN NULL
 WHEN regexp_matches(v,'{YMD}') THEN {iso(part(YMD, 1), part(YMD, 2), part(YMD, 3))}
 WHEN regexp_matches(v,'{UK}') THEN {iso(part(UK, 3), part(UK, 2), part(UK, 1))}
 WHEN regexp_matches(v,'{DMY}') THEN {iso(part(DMY, 3), MNUM.format(part(DMY, 2)), part(DMY, 1))}
 WHEN regexp_matches(v,'{MDY}') THEN {iso(part(MDY, 3), MNUM.format(part(MDY, 1)), part(MDY, 2))}
 WHEN regexp_matches(v,'{MY}') THEN {iso(part(MY, 2), MNUM.format(part(MY, 1)), "1")}
 WHEN regexp_matches(v,'{DM}') THEN CASE WHEN {iso(str(TODAY[:4]), MNUM.format(part(DM, 2)), part(DM, 1))} < DATE '{TODAY}'
   THEN {iso(str(int(TODAY[:4]) + 1), MNUM.format(part(DM, 2)), part(DM, 1))} ELSE {iso(str(TODAY[:4]), MNUM.format(part(DM, 2)), part(DM, 1))} END
 END AS STRING) AS let_available_iso
FROM (SELECT doc_id, a, trim(regexp_replace(regexp_replace(a,'\\b(\\d{{1,2}})(?:st|nd|rd|th)\\b','\\1','g'),'\\bof\\s+','','g'),' ,.;:') AS v
 FROM (SELECT doc_id, trim(regexp_replace(trim(lower(regexp_replace(raw,'\\s+',' ','g'))),'^available(?:\\s+from)?(?:\\s*:\\s*|\\s+)','')) AS a FROM available_raws))""",
       "available_raws")
def available_date_norm(t):
    return t.available_raws.select("doc_id", T.available_iso(F.col("raw"), TODAY).alias("let_available_iso"))


@query("display_size_parse", r"""
SELECT doc_id, CASE WHEN regexp_matches(s,'(?i)([\d,]{2,7})\s*sq\.?\s*ft') THEN TRY_CAST(replace(regexp_extract(s,'(?i)([\d,]{2,7})\s*sq\.?\s*ft',1),',','') AS INT)
 ELSE CAST(round_even(TRY_CAST(replace(nullif(regexp_extract(s,'(?i)([\d,]{2,5})\s*sq\.?\s*m(?:\W|$)',1),''),',','') AS INT)*10.764::DOUBLE,0) AS INT) END AS size_sqft
FROM (SELECT doc_id, CASE doc_id%5 WHEN 0 THEN CAST(n_chars AS STRING)||' sq ft / '||CAST(n_chars//10 AS STRING)||' sq m' WHEN 1 THEN CAST(10+n_chars%990 AS STRING)||' sq. m'
 WHEN 2 THEN description WHEN 3 THEN 'Ask agent' END AS s FROM texts)""", "texts")
def display_size_parse(t):
    n = F.col("n_chars")
    k = F.col("doc_id") % 5
    shown = (F.when(k == 0, F.concat(n.cast("string"), F.lit(" sq ft / "), F.floor(n / 10).cast("string"), F.lit(" sq m")))
             .when(k == 1, F.concat((n % 990 + 10).cast("string"), F.lit(" sq. m"))).when(k == 2, F.col("description"))
             .when(k == 3, "Ask agent"))
    return t.texts.select("doc_id", X.display_size(shown).alias("size_sqft"))
