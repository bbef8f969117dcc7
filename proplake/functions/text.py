"""Small text-to-value expressions shared by the extraction and enrichment jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from proplake.config import PROPERTY_TYPE_RULES, SQM_TO_SQFT_DISPLAY
from proplake.functions.patterns import DISPLAY_SQFT, DISPLAY_SQM, insensitive

# --- fixed values: postcode pattern ---------------------------------------------------------------------
POSTCODE = r"\b([A-Z]{1,2}[0-9][A-Z0-9]?\s*[0-9][A-Z]{2})\b"
# --- end of fixed values --------------------------------------------------------------------------------


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, NULL when there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def extract_all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first_known(items: Column) -> Column:
    """First non-NULL item of an array."""
    return F.get(F.filter(items, lambda x: x.isNotNull()), F.lit(0))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once, however often the expression mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def to_int(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("int")


def html_to_text(html: Column) -> Column:
    """Tags become spaces, two entities are decoded, white space collapses."""
    plain = F.regexp_replace(html, "<[^>]+>", " ")
    plain = F.replace(F.replace(plain, F.lit("&amp;"), F.lit("&")), F.lit("&quot;"), F.lit('"'))
    return strip(F.regexp_replace(plain, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def first_postcode(text: Column) -> Column:
    return F.upper(extract(text, insensitive(POSTCODE)))


def clean_address(address: Column) -> Column:
    """Address without postcodes, with single spaces and no comma at either end."""
    bare = F.regexp_replace(address, insensitive(POSTCODE), "")
    bare = strip(F.regexp_replace(bare, r"(?U)\s{2,}", " "))
    return strip(F.regexp_replace(bare, "^,+|,+$", ""))


def area_of(address: Column) -> Column:
    """Last comma part of the address when there are at least two non-empty ones."""
    bare = strip(F.regexp_replace(address, r"([A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2})", ""))
    parts = F.filter(F.transform(F.split(bare, ","), strip), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -1))


def money(text: Column) -> Column:
    """First pound amount, decimals kept."""
    return F.replace(extract(text, r"£\s*([\d,]+(?:\.\d+)?)"), F.lit(","), F.lit("")).try_cast("double")


def price_text_to_pence(text: Column) -> Column:
    """First whole pound amount, in pence."""
    return F.replace(extract(text, r"£([\d,]+)"), F.lit(","), F.lit("")).try_cast("long") * 100


def first_digits(text: Column) -> Column:
    """First run of digits once commas are gone."""
    return extract(F.replace(text, F.lit(","), F.lit("")), r"(\d+)").try_cast("long")


def property_type(text: Column) -> Column:
    low = F.lower(text)
    expr = F.when(text.isNull(), F.lit(None).cast("string"))
    for needle, kind in PROPERTY_TYPE_RULES:
        expr = expr.when(low.contains(needle), kind)
    return expr.otherwise("unknown")


def normal_postcode(text: Column) -> Column:
    """``OUT IN`` in upper case when the shape is a full postcode, else NULL. One that is so already is taken as it stands."""
    squeezed = F.replace(F.upper(strip(text)), F.lit(" "), F.lit(""))
    shape = r"^([A-Z]{1,2}[0-9][A-Z0-9]?)([0-9][A-Z]{2})$"
    ready = text.rlike(r"\A[A-Z]{1,2}[0-9][A-Z0-9]? [0-9][A-Z]{2}\z")
    return F.when(ready, text).when(squeezed.rlike(shape), F.regexp_replace(squeezed, shape, "$1 $2"))


def floor_level_int(raw: Column) -> Column:
    """Ground words -> 0, a leading signed number -> that number, anything else NULL."""
    low = F.lower(strip(raw))
    return F.when(low.isin("ground", "ground floor", "gr", "g"), 0).otherwise(extract(low, r"^(-?\d+)").try_cast("int"))


def display_size(raw: Column) -> Column:
    """Portal display size -> square feet; metres only when no feet are given."""
    feet, metres = extract(raw, insensitive(DISPLAY_SQFT)), extract(raw, insensitive(DISPLAY_SQM))
    return F.when(feet.isNotNull(), to_int(feet)).otherwise(
        F.bround(to_int(metres) * F.lit(SQM_TO_SQFT_DISPLAY), 0).cast("int")
    )
