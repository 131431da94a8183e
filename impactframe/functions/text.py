"""Text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How numbers and durations are written in source files.
NUMBER_TEXT = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)$"
INTEGER_TEXT = r"^[+-]?\d+(?:\.0+)?$"
CLOCK_TEXT = r"^(\d+):(\d+(?:\.\d+)?)$"
DURATION_TEXT = r"^PT(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)S)?$"


def is_blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def text_or_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def number(text: Column) -> Column:
    """Plain decimal text as a number. Words such as nan, inf or true are not numbers."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(NUMBER_TEXT), trimmed.try_cast("double"))


def whole_number(text: Column) -> Column:
    """``12`` or ``12.0`` as a whole number; anything else is null."""
    trimmed = F.trim(text)
    digits = F.regexp_replace(trimmed, r"\.0+$", "")
    return F.when(trimmed.rlike(INTEGER_TEXT), digits.try_cast("bigint"))


def played_minutes(text: Column) -> Column:
    """Minutes written as a number, as ``MM:SS`` or as ``PT..M..S``; null if written otherwise."""
    trimmed = F.trim(text)

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(trimmed, pattern, group).try_cast("double")

    duration = F.coalesce(part(DURATION_TEXT, 1), F.lit(0.0)) + F.coalesce(part(DURATION_TEXT, 2), F.lit(0.0)) / 60
    clock = part(CLOCK_TEXT, 1) + part(CLOCK_TEXT, 2) / 60
    return (
        F.when(trimmed.rlike(DURATION_TEXT) & (trimmed != "PT"), duration)
        .when(trimmed.rlike(CLOCK_TEXT), clock)
        .when(trimmed.rlike(NUMBER_TEXT), trimmed.try_cast("double"))
    )


# How a quoted value and a number are shown in a signature.
SHOWN_VALUE, SHOWN_NUMBER = "'<value>'", "<num>"
# Pieces of a message: letters with the one digit or sign that belongs to them, letters, numbers, anything else.
MESSAGE_PIECES = r"([A-Za-z]+[0-9-]|[A-Za-z]+|-?[0-9]+\.[0-9]+|-?[0-9]+|[^A-Za-z0-9-]+|-)"


def message_signature(message: Column) -> Column:
    """A message as its kind: each quoted value, number and stretch of white space stands for any other."""
    unquoted = F.regexp_replace(message, "'[^']*'", SHOWN_VALUE)
    pieces = F.regexp_extract_all(unquoted, F.lit(MESSAGE_PIECES), F.lit(1))
    shown = F.transform(pieces, lambda x: F.when(x.rlike("^-?[0-9]"), F.lit(SHOWN_NUMBER)).otherwise(x))
    return F.trim(F.regexp_replace(F.array_join(shown, ""), r"\s+", " "))


def two_decimals(value: Column) -> Column:
    """10.005 -> ``10.01``: half away from zero, on the decimal digits of the number."""
    return F.round(value.cast("decimal(38,10)"), 2).cast("decimal(38,2)").cast("string")


def canonical_team_filter(text: Column) -> Column:
    """The text itself if it is empty or lists unique positive ids in ascending order; else null."""
    ids = F.split(text, ",")
    numbers = F.transform(ids, lambda i: i.try_cast("bigint"))
    valid = F.forall(ids, lambda i: i.rlike(r"^[1-9]\d*$"))
    ordered = numbers == F.array_sort(F.array_distinct(numbers))
    return F.when(text == "", text).when(valid & ordered, text)
