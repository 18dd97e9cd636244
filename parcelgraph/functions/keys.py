"""Asset keys: ten characters, borough digit, five of block, four of lot."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The boroughs by the first digit of a key.
BOROUGHS = {"1": "Manhattan", "2": "Bronx", "3": "Brooklyn", "4": "Queens", "5": "Staten Island"}

# Fixed value: a well-formed key.
VALID_KEY = "^[1-5][0-9]{9}$"


def zero_fill(text: Column, width: int) -> Column:
    """Left zeros up to ``width``; unlike lpad it never cuts longer values."""
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def blank_to_null(text: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def key_from_parts(borough: Column, block: Column, lot: Column) -> Column:
    """A key of its parts, null unless all three are there."""
    parts = [blank_to_null(p.cast("string")) for p in (borough, block, lot)]
    return F.concat(parts[0], zero_fill(parts[1], 5), zero_fill(parts[2], 4))


def normalize_key(key: Column, borough: Column, block: Column, lot: Column) -> Column:
    """A key of ten characters is kept, any other one is rebuilt from its parts, else null."""
    given = F.trim(key)
    return F.when(F.length(given) == 10, given).otherwise(key_from_parts(borough, block, lot))


def normalize_key_blank_only(key: Column, borough: Column, block: Column, lot: Column) -> Column:
    """Only a blank key is rebuilt."""
    return F.coalesce(blank_to_null(key), key_from_parts(borough, block, lot))


def normalize_key_valid(key: Column, borough: Column, block: Column, lot: Column) -> Column:
    """A well-formed key is kept, any other one is rebuilt."""
    given = F.trim(key)
    return F.when(given.rlike(VALID_KEY), given).otherwise(key_from_parts(borough, block, lot))


def borough_of(key: Column) -> Column:
    """The borough's name, null for an unknown first digit."""
    pairs = [x for k, v in BOROUGHS.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[F.substring(key, 1, 1)]


def event_id(source: str, *parts: Column) -> Column:
    """``EVT-{source}-{part}-...``; a missing part reads None."""
    return F.concat_ws("-", F.lit(f"EVT-{source}"), *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))
