"""Typed columns from listing text: one select over (description, features, title)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proplake.config import SQM_TO_SQFT
from proplake.functions import patterns as P
from proplake.functions.text import bind, extract, first_known, strip, to_int


def _bullets(features: Column) -> Column:
    """Lower-cased bullets without NULLs; no bullets -> empty array."""
    return F.transform(F.filter(F.coalesce(features, F.array().cast("array<string>")), lambda f: f.isNotNull()), F.lower)


def _prose(description: Column, title: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(description, F.lit("")), F.coalesce(title, F.lit("")))


def _sources(features: Column, *texts: Column) -> Column:
    """Bullets first, then the given texts, as one array in search order."""
    bullets = F.filter(F.coalesce(features, F.array().cast("array<string>")), lambda f: f.isNotNull())
    return F.concat(bullets, F.array(*[F.coalesce(t, F.lit("")) for t in texts]))


def _mentions(bullets: Column, *needles: str) -> Column:
    return F.exists(bullets, lambda b: F.greatest(*[b.contains(n) for n in needles]) if len(needles) > 1 else b.contains(needles[0]))


def _names_any(text: Column, words: tuple[str, ...]) -> Column:
    """Cheap test for words without which none of a pattern list can match; it spares most texts the regex scan."""
    low = F.lower(text)
    tests = [low.contains(w) for w in words]
    return F.greatest(*tests) if len(tests) > 1 else tests[0]


def _verdict(by_bullet: Column, prose: Column, words: tuple[str, ...], no: list[str], yes: list[str]) -> Column:
    """Bullets win, then a denial in the prose, then an affirmation; silence means False."""
    return (
        F.when(by_bullet, True).when(~_names_any(prose, words), False).when(prose.rlike(P.any_of(no)), False)
        .otherwise(prose.rlike(P.any_of(yes)))
    )


def garden(description: Column, features: Column, title: Column) -> Column:
    bullets = _bullets(features)
    claimed = _mentions(bullets, "garden") & ~_mentions(bullets, "no garden", "without garden")
    return _verdict(claimed, _prose(description, title), ("garden", "outdoor"), P.GARDEN_NO, P.GARDEN_YES)


def balcony(description: Column, features: Column, title: Column) -> Column:
    claimed = _mentions(_bullets(features), "balcony", "terrace", "patio")
    return _verdict(claimed, _prose(description, title), ("balcony", "terrace", "patio"), P.BALCONY_NO, P.BALCONY_YES)


def bills_included(description: Column, features: Column, title: Column) -> Column:
    claimed = _mentions(_bullets(features), "bills included", "bills inc", "all bills")
    return _verdict(claimed, _prose(description, title), ("bill", "includ"), P.BILLS_NO, P.BILLS_YES)


def furnished(description: Column, features: Column, title: Column) -> Column:
    """First bullet that names a state, else the most specific state in the prose, else ``unknown``."""
    def state(bullet: Column) -> Column:
        return F.coalesce(*[F.when(bullet.contains(needle), value) for needle, value in P.FURNISHED_BULLETS])

    prose = _prose(description, title)
    named = _names_any(prose, ("furni",))
    in_text = [F.when(named & prose.rlike(P.insensitive(pattern)), value) for pattern, value in P.FURNISHED_TEXT]
    return F.coalesce(first_known(F.transform(_bullets(features), state)), *in_text, F.lit("unknown"))


def first_match(sources: Column, words: tuple[str, ...], patterns: list[str]) -> Column:
    """First source with any match; within it the earliest pattern of the list."""
    def match(source: Column) -> Column:
        return F.when(_names_any(source, words), F.coalesce(*[extract(source, P.insensitive(p)) for p in patterns]))

    return first_known(F.transform(sources, match))


def council_band(description: Column, features: Column, title: Column) -> Column:
    return F.upper(first_match(_sources(features, description, title), ("tax band", "ctb"), P.COUNCIL_BAND))


def available_raw(description: Column, features: Column, title: Column) -> Column:
    return strip(first_match(_sources(features, description, title), ("available",), P.AVAILABLE))


def size_sqft(description: Column, features: Column) -> Column:
    """Square feet as written, or metres converted, from the first source that states a readable size."""
    def size(s: Column) -> Column:
        feet = extract(s, P.insensitive(P.SQFT))
        metres = to_int(extract(s, P.insensitive(P.SQM)))
        return F.when(feet.isNotNull(), to_int(feet)).otherwise(F.bround(metres * F.lit(SQM_TO_SQFT), 0).cast("int"))

    return first_known(F.transform(_sources(features, description), size))


def rating_letter(description: Column, features: Column) -> Column:
    return F.upper(first_match(_sources(features, description), ("epc", "energy"), P.RATING))


# --- fixed values: month names and date shapes ----------------------------------------------------------
MONTH_NUMBERS = {
    name: i for i, names in enumerate(
        ("january jan", "february feb", "march mar", "april apr", "may", "june jun", "july jul", "august aug",
         "september sep sept", "october oct", "november nov", "december dec"), start=1)
    for name in names.split()
}


MONTHS_RE = "|".join(sorted(MONTH_NUMBERS, key=len, reverse=True))
NUMERIC_SHAPES = [  # (pattern, year group, month group, day group)
    (r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", 1, 2, 3),
    (r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$", 3, 2, 1),
]
NAMED_SHAPES = [
    (rf"^(\d{{1,2}})\s+({MONTHS_RE})\s+(\d{{4}})$", 3, 2, 1),
    (rf"^({MONTHS_RE})\s+(\d{{1,2}})\s+(\d{{4}})$", 3, 1, 2),
    (rf"^({MONTHS_RE})\s+(\d{{4}})$", 2, 1, None),
]
YEARLESS = rf"^(\d{{1,2}})\s+({MONTHS_RE})$"
# --- end of fixed values --------------------------------------------------------------------------------


def _date(year: Column, month: Column, day: Column) -> Column:
    """A real calendar date or NULL."""
    text = F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def available_iso(raw: Column, today: str) -> Column:
    """Free-form availability -> ISO date text, NULL when it is not a readable date.

    A day and month without a year mean the next such day on or after ``today``.
    """
    now = F.lit(today).cast("date")
    number = F.create_map(*[F.lit(x) for pair in MONTH_NUMBERS.items() for x in pair])

    def month_number(name: Column) -> Column:
        return F.try_element_at(number, name).cast("string")

    def dated(value: Column) -> Column:
        numeric = [_date(extract(value, p, y), extract(value, p, m), extract(value, p, d)) for p, y, m, d in NUMERIC_SHAPES]
        named = [
            _date(extract(value, p, y), month_number(extract(value, p, m)), extract(value, p, d) if d else F.lit("1"))
            for p, y, m, d in NAMED_SHAPES
        ]
        day, month = extract(value, YEARLESS, 1), month_number(extract(value, YEARLESS, 2))
        this_year = _date(F.year(now).cast("string"), month, day)
        next_year = _date((F.year(now) + 1).cast("string"), month, day)
        upcoming = F.when(this_year >= now, this_year).when(this_year < now, next_year)
        return F.coalesce(*numeric, *named, upcoming)

    def tidy(value: Column) -> Column:
        value = F.regexp_replace(F.regexp_replace(value, r"\b(\d{1,2})(?:st|nd|rd|th)\b", "$1"), r"\bof\s+", "")
        return F.regexp_replace(value, r"^[ ,.;:]+|[ ,.;:]+$", "")

    def read(value: Column) -> Column:
        return (
            F.when(value.isin("", "tbc", "available soon"), F.lit(None).cast("date"))
            .when(value.isin("now", "immediately", "from now", "asap"), now)
            .otherwise(bind(tidy(value), dated))
        )

    squeezed = strip(F.lower(F.regexp_replace(F.replace(raw, F.lit("\x00"), F.lit(" ")), r"(?U)\s+", " ")))
    subject = strip(F.regexp_replace(squeezed, r"^available(?:\s+from)?(?:\s*:\s*|\s+)", ""))
    return F.date_format(bind(subject, read), "yyyy-MM-dd")


def extract_text_features(df: DataFrame) -> DataFrame:
    """All text columns of a (description, features, title) table in one projection."""
    d, f, t = F.col("description"), F.col("features"), F.col("title")
    return df.withColumns({
        "garden": garden(d, f, t), "balcony": balcony(d, f, t), "bills_included": bills_included(d, f, t),
        "furnished": furnished(d, f, t), "council_tax_band": council_band(d, f, t),
        "let_available_date": available_raw(d, f, t), "size_sqft": size_sqft(d, f), "epc_rating": rating_letter(d, f),
    })


def extraction_misses(df: DataFrame) -> DataFrame:
    """Rows lacking size or rating, whole, with which of them are missing."""
    missing = F.concat_ws("+", F.when(F.col("size_sqft").isNull(), "size"), F.when(F.col("epc_rating").isNull(), "epc"))
    return df.withColumn("missing", missing).filter(F.col("missing") != "")


def extraction_miss_report(df: DataFrame) -> DataFrame:
    return extraction_misses(df).groupBy("missing").agg(F.count("*").alias("n"))
