"""JSON text columns <-> typed columns. Malformed text gives an empty or NULL value, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOORPLAN = "struct<total_size_sqft:double,total_area_sqft:double,total_sqft:double,size_sqft:double,error:string," \
            "rooms:array<struct<name:string,size_sqft:double>>>"


def is_json_array(text: Column) -> Column:
    return F.coalesce(F.json_array_length(text).isNotNull(), F.lit(False))


def string_array(text: Column) -> Column:
    """JSON array -> array of its non-empty items as text; anything else -> empty array."""
    parsed = F.when(is_json_array(text), F.from_json(text, "array<string>"))
    return F.coalesce(F.filter(parsed, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def int_map(text: Column) -> Column:
    """JSON object -> map of the values that read as numbers, rounded half to even; anything else -> empty map."""
    parsed = F.from_json(text, "map<string,string>")
    rounded = F.transform_values(parsed, lambda _, v: F.bround(v.try_cast("double"), 0).cast("int"))
    return F.coalesce(F.map_filter(rounded, lambda _, v: v.isNotNull()), F.create_map().cast("map<string,int>"))


def floorplan(text: Column) -> Column:
    """Floorplan reading, NULL when empty, malformed or carrying an error."""
    parsed = F.from_json(text, FLOORPLAN)
    valid = F.get_json_object(text, "$").isNotNull() & text.startswith("{") & (F.coalesce(parsed["error"], F.lit("")) == "")
    return F.when(valid, parsed)


def photo_count(text: Column) -> Column:
    """Number of items in a JSON array or under ``urls``; empty -> 0, malformed or other shapes -> NULL."""
    urls = F.get_json_object(text, "$.urls")
    return F.when(text.isNull() | (text == ""), 0).otherwise(F.coalesce(F.json_array_length(text), F.json_array_length(urls)))
