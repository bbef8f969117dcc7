"""Calibration against labels, model comparisons and data-quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proplake.config import LIVING_ROOMS, STOP_WORDS, TIER_ORDER, TIER_RANK
from proplake.functions.ranks import value_at, value_positions
from proplake.functions.sequence import numbered
from proplake.functions.text import strip
from proplake.operators.lifecycle import newest_session
from proplake.session import cut_lineage


def label_join_latest_session(labels: DataFrame, listings: DataFrame) -> DataFrame:
    """Labels of the newest session with their listing and the tier's rank."""
    rank = F.create_map(*[F.lit(x) for pair in TIER_RANK.items() for x in pair])
    return newest_session(labels).join(listings, "uid").withColumn("tier_rank", F.try_element_at(rank, "tier"))


def tier_component_means(joined: DataFrame, keys: list[str]) -> DataFrame:
    """Per tier: mean of each breakdown component, count and mean score."""
    return joined.filter(F.col("tier").isin(TIER_ORDER)).groupBy("tier").agg(
        *[F.round(F.avg(F.try_element_at("score_breakdown", F.lit(k))), 4).alias(f"mean_{k}") for k in keys],
        F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


def tier_distributions(joined: DataFrame, column: str, values: list) -> DataFrame:
    """Tier by value counts, zero where a combination is absent."""
    return joined.groupBy("tier").pivot(column, values).count().na.fill(0)


def tier_summary(joined: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return joined.groupBy("tier").agg(
        F.round(F.avg(c), 4).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"), F.count(c).alias("count"))


def disagreement_topk(joined: DataFrame, k: int = 6) -> DataFrame:
    """Highest scored of the disliked and lowest scored of the liked: two bounded top-k."""
    scored = joined.filter("score IS NOT NULL").select("uid", "tier", "score")
    over = scored.filter(F.col("tier").isin("bad", "worse")).orderBy(F.desc("score"), "uid").limit(k)
    under = scored.filter(F.col("tier").isin("best", "good")).orderBy(F.asc("score"), "uid").limit(k)
    return over.withColumn("side", F.lit("overrated")).unionAll(under.withColumn("side", F.lit("underrated")))


def token_frequency_per_group(labels: DataFrame, k: int = 15) -> DataFrame:
    """Most frequent words per tier; equal counts go by first occurrence. Counts combine before the ranking."""
    text = F.translate(F.lower("reasoning"), ",.;:()!?/\\", " " * 10)
    words = labels.filter("reasoning IS NOT NULL").select(
        "tier", "position", "uid", F.posexplode(F.split(strip(text), r"(?U)\s+")).alias("i", "token"))
    kept = words.filter((F.length("token") > 2) & ~F.col("token").isin(STOP_WORDS))
    counts = kept.groupBy("tier", "token").agg(F.count("*").alias("n"), F.min(F.struct("position", "uid", "i")).alias("first"))
    top = Window.partitionBy("tier").orderBy(F.desc("n"), "first")
    return counts.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k).drop("first")


def reasons_by_tier(labels: DataFrame) -> DataFrame:
    """Non-blank reasons of the newest session in (tier, position) order."""
    text = strip(F.col("reasoning"))
    return newest_session(labels).filter(F.coalesce(text, F.lit("")) != "").select(
        "tier", "position", "uid", text.alias("reasoning")).orderBy("tier", "position", "uid")


def thresholds(lo: float, hi: float, step: float) -> list[float]:
    steps = int((hi - lo) / step + 1e-6) + 1
    return [round(lo + i * step, 4) for i in range(steps)]


def threshold_sweep(pairs: DataFrame, lo: float = 0.4, hi: float = 0.8, step: float = 0.05) -> DataFrame:
    """tp, fp, fn, precision and recall at every threshold, all from one pass over the pairs."""
    score = F.when(F.col("score") > 1.0, F.col("score") / 100.0).otherwise(F.col("score"))
    yes = F.col("label") == 1
    cuts = thresholds(lo, hi, step)
    counted = pairs.agg(*[
        F.struct(F.lit(c).alias("threshold"), F.count_if((score >= c) & yes).alias("tp"), F.count_if((score >= c) & ~yes).alias("fp"),
                 F.count_if((score < c) & yes).alias("fn")).alias(f"t{i}") for i, c in enumerate(cuts)])
    rows = counted.select(F.inline(F.array(*[f"t{i}" for i in range(len(cuts))])))
    return rows.withColumns({
        "precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))})


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Highest precision, then lowest threshold; the last threshold when no precision is defined."""
    best = sweep.agg(F.max_by(F.struct("*"), F.struct(F.coalesce("precision", F.lit(-1.0)), F.when(
        F.col("precision").isNull(), F.col("threshold")).otherwise(-F.col("threshold")))).alias("row"))
    return best.select("row.*")


def clean_call() -> Column:
    return F.col("parse_success") & ~F.col("missing_keys") & ~F.col("wrong_types")


def exclusive_p95(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group, mean, p95, max, n): p95 interpolates at (n + 1) * 0.95 from 20 values on, below that it is the maximum."""
    spots = value_positions(df, value, (group,))
    sizes = spots.groupBy(group).agg(F.sum("n").alias("size"), F.max(value).alias("top"), F.sum(F.col("n") * F.col(value)).alias("total"))
    low = F.floor((F.col("size") + 1) * 19 / 20)
    frame = spots.join(sizes, group).groupBy(group, "size", "top", "total").agg(
        value_at(low, value).alias("lower"), value_at(low + 1, value).alias("upper"))
    part = (F.col("size") + 1) * 19 % 20
    p95 = F.when(F.col("size") >= 20, (F.col("lower") * (20 - part) + F.col("upper") * part) / 20).otherwise(F.col("top"))
    return frame.select(group, F.round(F.col("total") / F.col("size"), 4).alias("mean"), F.round(p95, 4).alias("p95"),
                        F.col("top").alias("max"), F.col("size").alias("n"))


def variant_latency_stats(calls: DataFrame) -> DataFrame:
    """Per variant: calls, parse and clean rates, and latency per call and per listing pass (milliseconds)."""
    rates = calls.groupBy("variant").agg(
        F.count("*").alias("n_calls"), F.count_if("parse_success").alias("n_parsed"), F.count_if(clean_call()).alias("n_clean"))
    per_call = exclusive_p95(calls, "latency_ms", "variant")
    totals = calls.filter("latency_ms IS NOT NULL").groupBy("variant", "uid", "repeat_idx").agg(F.sum("latency_ms").alias("total_ms"))
    per_pass = exclusive_p95(totals, "total_ms", "variant")
    return rates.join(per_call, "variant", "left").join(
        per_pass.toDF("variant", "mean_total", "p95_total", "max_total", "n_listings"), "variant", "left"
    ).select(
        "variant", "n_calls", "n_parsed", "n_clean", F.round(F.col("n_parsed") / F.col("n_calls"), 4).alias("json_parse_rate"),
        F.round(F.col("n_clean") / F.col("n_calls"), 4).alias("clean_rate"), F.col("mean").alias("mean_latency_ms"),
        F.col("p95").alias("p95_latency_ms"), F.col("max").alias("max_latency_ms"), F.col("mean_total").alias("mean_total_ms"),
        F.col("p95_total").alias("p95_total_ms"), F.col("max_total").alias("max_total_ms"), "n_listings")


def baseline_agreement(calls: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Share of clean calls per variant that agree with the baseline's majority for the same photo (ties say yes)."""
    votes = calls.filter((F.col("variant") == baseline) & F.col("parse_success") & F.col("carpet").isNotNull()).groupBy("uid", "photo_idx").agg(
        (F.count_if("carpet") * 2 >= F.count("*")).alias("majority"))
    judged = calls.filter(clean_call() & F.col("carpet").isNotNull()).join(votes, ["uid", "photo_idx"])
    return judged.groupBy("variant").agg(
        F.count("*").alias("agreement_total"), F.count_if(F.col("carpet") == F.col("majority")).alias("agreement_n")
    ).withColumn("agreement_rate", F.round(F.col("agreement_n") / F.col("agreement_total"), 4))


def failure_buckets(calls: DataFrame) -> DataFrame:
    return calls.filter("failure_class IS NOT NULL").groupBy("variant", F.split_part("failure_class", F.lit(":"), F.lit(1)).alias("bucket")).agg(
        F.count("*").alias("n"))


def paired_models(calls: DataFrame, first: str, second: str) -> DataFrame:
    """Photos whose last call by each of the two models came back clean, side by side."""
    fields = ["repeat_idx", "latency_ms", "parse_success", "missing_keys", "wrong_types", "room_type", "carpet"]
    last = F.struct(*fields)
    pairs = calls.filter(F.col("model").isin(first, second)).groupBy("uid", "photo_idx").agg(
        F.max(F.when(F.col("model") == first, last)).alias("a"), F.max(F.when(F.col("model") == second, last)).alias("b"))

    def clean(side: str) -> Column:
        return F.col(f"{side}.parse_success") & ~F.col(f"{side}.missing_keys") & ~F.col(f"{side}.wrong_types")

    return pairs.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & clean("a") & clean("b"))


def inter_model_agreement(calls: DataFrame, first: str, second: str) -> DataFrame:
    same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    counts = paired_models(calls, first, second).agg(
        F.count("*").alias("n_paired_clean"), F.count_if(same("room_type")).alias("_room"), F.count_if(same("carpet")).alias("_carpet"))
    return counts.select("n_paired_clean", F.round(F.try_divide("_room", "n_paired_clean"), 4).alias("room_type_agree_rate"),
                         F.round(F.try_divide("_carpet", "n_paired_clean"), 4).alias("carpet_agree_rate"))


def model_disagreements(calls: DataFrame, first: str, second: str, field: str = "room_type", k: int = 20) -> DataFrame:
    """The first ``k`` photos the two models read differently (a report of examples)."""
    a, b = F.col(f"a.{field}"), F.col(f"b.{field}")
    return paired_models(calls, first, second).filter(~a.eqNullSafe(b)).select(
        "uid", "photo_idx", a.alias("first_value"), b.alias("second_value")).orderBy("uid", "photo_idx").limit(k)


def flip_class(old: Column, new: Column) -> Column:
    word = lambda c: F.when(c, "true").otherwise("false")
    return (
        F.when(old.eqNullSafe(new), "unchanged").when(old.isNull(), F.concat(F.lit("none_to_"), word(new)))
        .when(new.isNull(), F.concat(F.lit("to_none_from_"), F.initcap(word(old))))
        .otherwise(F.concat(word(old), F.lit("_to_"), word(new)))
    )


def flip_matrix(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.groupBy(flip_class(F.col(old), F.col(new)).alias("flip")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "flip")


# --- fixed values: fields whose coverage is reported ----------------------------------------------------
REQUIRED = [
    "uid", "portal", "property_id", "url", "title", "price_numeric", "bedrooms", "area", "latitude",
    "longitude", "first_seen", "last_scraped", "is_active",
]
OPTIONAL = [
    "address", "postcode", "bathrooms", "furnished", "garden", "bills_included", "let_available_date", "images",
]
ENRICHMENT = [
    "tube_distance", "cycle_minutes", "epc_rating", "tfl_zone", "nearest_station", "commute_primary",
    "commute_secondary", "commute_pass_40min", "score", "region", "cluster_id", "carpet_in_bedroom",
    "carpet_other_areas", "is_let_agreed",
]
# --- end of fixed values --------------------------------------------------------------------------------


def field_coverage(df: DataFrame, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """(kind, field, present, total, complete): filled values per field. Enrichment flags count only when true."""
    groups = groups or {"required": REQUIRED, "optional": OPTIONAL, "enrichment": ENRICHMENT}
    kinds = {f.name: f.dataType.typeName() for f in df.schema}

    def present(kind: str, field: str) -> Column:
        if field not in kinds:
            return F.lit(0).cast("long")
        c = F.col(field)
        filled = c.isNotNull()
        if kinds[field] == "string":
            filled = filled & (c != "")
        if kind == "enrichment" and kinds[field] == "boolean":
            filled = filled & c
        return F.count_if(filled)

    cells = [(kind, field) for kind, fields in groups.items() for field in fields]
    row = df.agg(F.count("*").alias("total"), *[present(k, f).alias(f"p{i}") for i, (k, f) in enumerate(cells)])
    table = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(f).alias("field"), F.col(f"p{i}").alias("present")) for i, (k, f) in enumerate(cells)])
    return row.select("total", F.inline(table)).select("kind", "field", "present", "total", (F.col("present") == F.col("total")).alias("complete"))


def _label_counts(photos: DataFrame) -> DataFrame:
    """(uid, bs, bwc, has_living_area_carpet, declared, beds): distinct bedrooms and those with carpet, from photo labels.

    Rows of equal (uid, name) combine first and are written; unnamed photos are counted, not numbered, except of listings with
    a name of the form that numbers take: there the names that a numbered photo also has are taken off again.
    """
    bedroom, carpet = F.coalesce(F.col("room_truth") == "bedroom", F.lit(False)), F.coalesce("has_carpet_truth", F.lit(False))
    unnamed = bedroom & (F.coalesce("bedroom_slug", F.lit("")) == "")
    slug = F.when(bedroom & ~unnamed, F.col("bedroom_slug"))
    names = cut_lineage(photos.groupBy("uid", slug.alias("slug")).agg(
        F.count_if(unnamed).alias("unnamed"), F.count_if(unnamed & carpet).alias("unnamed_carpet"), F.bool_or(carpet).alias("carpet"),
        F.bool_or(F.col("room_truth").isin(LIVING_ROOMS) & F.col("has_carpet_truth")).alias("living"),
        F.max("bedrooms_declared").alias("declared"), F.count_if(bedroom).alias("beds")))
    counts = names.groupBy("uid").agg(
        (F.count("slug") + F.sum("unnamed")).alias("bs"), (F.count_if(F.col("slug").isNotNull() & F.col("carpet")) + F.sum("unnamed_carpet")).alias("bwc"),
        F.bool_or("living").alias("has_living_area_carpet"), F.max("declared").alias("declared"), F.sum("beds").alias("beds"))
    like_numbers = names.filter(F.col("slug").rlike(r"^bedroom_[1-9][0-9]*$")).select("uid", "slug", "carpet")
    if like_numbers.isEmpty():
        return counts
    open_photos = photos.filter(unnamed).join(like_numbers.select("uid").distinct(), "uid", "left_semi")
    given = numbered(open_photos, "photo_idx").select("uid", F.concat(F.lit("bedroom_"), F.col("number").cast("string")).alias("slug"), carpet.alias("_carpet"))
    twice = given.join(like_numbers, ["uid", "slug"]).groupBy("uid").agg(F.count("*").alias("_same"), F.count_if(F.col("carpet") & F.col("_carpet")).alias("_both"))
    off = counts.join(twice, "uid", "left")
    return off.withColumns({"bs": F.col("bs") - F.coalesce("_same", F.lit(0)), "bwc": F.col("bwc") - F.coalesce("_both", F.lit(0))}).select(*counts.columns)


def label_expected_rollup(photos: DataFrame) -> DataFrame:
    """Expected bedroom counts from photo labels. An unnamed bedroom photo is a bedroom of its own, numbered in photo order."""
    return _label_counts(photos).select("uid", F.least("bs", "declared").alias("bedrooms_seen"), F.least("bwc", "declared").alias("bedrooms_with_carpet"),
                                        "has_living_area_carpet")


def photo_diff(photos: DataFrame) -> DataFrame:
    """Per photo: whether predicted room and carpet agree with the labels (carpet only where it was judged)."""
    return photos.select(
        "uid", "photo_idx", F.col("room_truth").eqNullSafe(F.col("room_type")).alias("room_match"),
        F.when(F.col("carpet").isNotNull(), F.coalesce("has_carpet_truth", F.lit(False)) == F.col("carpet")).alias("carpet_match"))


def prediction_vs_truth(photos: DataFrame, predicted: DataFrame) -> DataFrame:
    """Listings evaluated and how many of the three roll-ups match; listings without a labelled bedroom are skipped.

    Both sides are written first, so that no task holds their groups beside the rows it joins.
    """
    expected = cut_lineage(_label_counts(photos).filter("beds > 0").select(
        "uid", F.least("bs", "declared").alias("bedrooms_seen"), F.least("bwc", "declared").alias("bedrooms_with_carpet"),
        "has_living_area_carpet", F.nullif(F.col("declared"), F.lit(0)).alias("declared")))
    p = cut_lineage(predicted.select("uid", F.col("bedrooms_seen").alias("p_seen"), F.col("bedrooms_with_carpet").alias("p_carpet"),
                                     F.col("has_living_area_carpet").alias("p_living")))
    judged = expected.join(p, "uid")
    return judged.agg(
        F.count("*").alias("n_evaluated"),
        F.count_if(F.least("p_seen", "declared") == F.col("bedrooms_seen")).alias("bedrooms_seen_ok"),
        F.count_if(F.least("p_carpet", "declared") == F.col("bedrooms_with_carpet")).alias("bedrooms_with_carpet_ok"),
        F.count_if(F.col("p_living") == F.col("has_living_area_carpet")).alias("living_area_ok"))


def geo_delta_stats(deltas: DataFrame, value: str = "metres") -> DataFrame:
    """Number, upper median (element n div 2 of the sorted values) and mean of distances."""
    spots = value_positions(deltas, value)
    size = spots.agg(F.sum("n").alias("size")).scalar()
    return spots.agg(
        F.sum("n").alias("n"), value_at(F.floor(size / 2) + 1, value).alias("upper_median"),
        F.round(F.sum(F.col("n") * F.col(value)) / F.sum("n"), 3).alias("mean"))


def scrape_outcome_stats(results: DataFrame) -> DataFrame:
    """(measure, n): successes, failures, and failures per error class (text before the first colon)."""
    error = F.when(~F.col("success") & (F.coalesce("error", F.lit("")) != ""), F.concat(F.lit("error:"), F.split_part("error", F.lit(":"), F.lit(1))))
    measures = F.array_compact(F.array(F.when(F.col("success"), "successful").otherwise("failed"), error))
    return results.select("portal", F.explode(measures).alias("measure")).groupBy("portal", "measure").agg(F.count("*").alias("n"))
