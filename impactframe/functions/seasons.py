"""Season arithmetic as column expressions.

A season is written ``2014-15``; with its type it becomes ``2014-15:REGULAR``.
Tables keep the readable type text (``Regular Season``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Season type code -> readable text, slug, sort order.
SEASON_TYPES = {
    "PRESEASON": ("Pre Season", "preseason", 0),
    "REGULAR": ("Regular Season", "regular_season", 1),
    "PLAYOFFS": ("Playoffs", "playoffs", 2),
}

# Accepted spellings of a season type.
SEASON_TYPE_SPELLINGS = {
    "PRESEASON": ["preseason", "pre season", "pre"],
    "REGULAR": ["regular season", "regular", "reg season", "reg. season"],
    "PLAYOFFS": ["playoffs", "playoff", "post season", "postseason", "post"],
}

FIRST_SEASON_YEAR = 1946


def _lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), key)


def start_year_of_date(day: Column) -> Column:
    """Seasons turn over in July."""
    return F.when(F.month(day) >= 7, F.year(day)).otherwise(F.year(day) - 1)


def season_text(start_year: Column) -> Column:
    """2014 -> ``2014-15``; 1999 -> ``1999-00``."""
    suffix = F.lpad(F.pmod(start_year + 1, F.lit(100)).cast("string"), 2, "0")
    return F.concat(start_year.cast("string"), F.lit("-"), suffix)


def start_year(season: Column) -> Column:
    """Start year of ``YYYY`` or ``YYYY-YY`` text; null unless the suffix is the next year."""
    text = F.trim(season)
    year = F.regexp_extract(text, r"^(\d{4})(?:-\d{2})?$", 1)
    parsed = F.nullif(year, F.lit("")).cast("int")
    suffix = F.nullif(F.regexp_extract(text, r"^\d{4}-(\d{2})$", 1), F.lit(""))
    expected = F.lpad(F.pmod(parsed + 1, F.lit(100)).cast("string"), 2, "0")
    return F.when((parsed > 0) & (suffix.isNull() | (suffix == expected)), parsed)


def type_code(spelling: Column) -> Column:
    """Any accepted spelling -> REGULAR / PLAYOFFS / PRESEASON; null if unknown."""
    table = {s: code for code, spellings in SEASON_TYPE_SPELLINGS.items() for s in spellings}
    return _lookup(F.lower(F.trim(spelling)), table)


def type_text(code: Column) -> Column:
    return _lookup(code, {code_: names[0] for code_, names in SEASON_TYPES.items()})


def type_slug(code: Column) -> Column:
    return _lookup(code, {code_: names[1] for code_, names in SEASON_TYPES.items()})


def type_order(code: Column) -> Column:
    return _lookup(code, {code_: str(names[2]) for code_, names in SEASON_TYPES.items()}).cast("int")


def season_id(season: Column, season_type: Column) -> Column:
    """``2014-15`` and any spelling of its type -> ``2014-15:REGULAR``; null if either is invalid."""
    return F.concat(season_text(start_year(season)), F.lit(":"), type_code(season_type))


def parse_season_id(text: Column) -> Column:
    """``2014-15:regular`` -> struct(start_year, season_type code); fields null if invalid."""
    trimmed = F.trim(text)
    return F.struct(
        start_year(F.substring_index(trimmed, ":", 1)).alias("start_year"),
        type_code(F.nullif(F.regexp_extract(trimmed, r"^[^:]*:(.*)$", 1), F.lit(""))).alias("season_type"),
    )


def canonical_season_id(text: Column) -> Column:
    parsed = parse_season_id(text)
    return F.concat(season_text(parsed["start_year"]), F.lit(":"), parsed["season_type"])
