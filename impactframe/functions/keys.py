"""Cache keys: the text that identifies one calculation."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from impactframe.functions.seasons import SEASON_TYPES, canonical_season_id, parse_season_id, type_order
from impactframe.functions.text import canonical_team_filter, two_decimals

# Spellings of the metrics.
METRIC_SPELLINGS = {
    "wowy": ["wowy", "with or without you"],
    "wowy_shrunk": [
        "wowy_shrunk",
        "wowy shrunk",
        "with or without you shrunk",
        "shrunk wowy",
        "shrunk with or without you",
        "shrinkage_wowy",
    ],
    "ridge": ["ridge"],
}

# Order of the settings in a key, and what a missing one means.
SETTINGS = {
    "wowy": [],
    "wowy_shrunk": ["shrinkage_prior_games"],
    "ridge": ["ridge_alpha", "shrinkage_mode", "shrinkage_strength", "shrinkage_minute_scale", "min_games"],
}
_TEXT_SETTINGS = {"shrinkage_mode", "min_games"}


def metric_name(spelling: Column) -> Column:
    """Canonical metric of any accepted spelling; null if unknown."""
    pairs = [F.lit(v) for name, spellings in METRIC_SPELLINGS.items() for s in spellings for v in (s, name)]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.trim(spelling)))


def variant(metric: str) -> str:
    return "default" if metric == "ridge" else metric


def setting_text(name: str, value: object) -> str:
    if name in _TEXT_SETTINGS:
        return str(value)
    return f"{Decimal(str(value)).quantize(Decimal('0.01'), rounding=ROUND_HALF_UP):.2f}"


def season_sort_key(season_id: str) -> tuple[int, int]:
    season, _, code = season_id.partition(":")
    return int(season[:4]), SEASON_TYPES[code][2]


def cache_key(metric: str, season_ids: list[str], team_ids: list[int], settings: dict[str, object]) -> str:
    """The key of one query: seasons by year and type, teams by id, numbers with two decimals."""
    seasons = sorted(set(season_ids), key=season_sort_key)
    teams = ",".join(str(t) for t in sorted(set(team_ids))) or "all-teams"
    parts = [f"metric={metric}", f"variant={variant(metric)}", f"team_ids={teams}", f"season_ids={','.join(seasons)}"]
    parts += [f"{name}={setting_text(name, settings[name])}" for name in SETTINGS[metric] if name in settings]
    return "|".join(parts)


def parse_key(key: str) -> dict[str, object]:
    """The parts of one key. Raises if metric, variant or seasons are missing."""
    fields: dict[str, str] = {}
    for part in key.split("|"):
        name, equals, value = part.partition("=")
        if not equals:
            raise ValueError(f"invalid cache key part {part!r}")
        fields[name] = value
    for needed in ("metric", "variant", "season_ids"):
        if not fields.get(needed):
            raise ValueError(f"cache key has no {needed}")
    teams = fields.get("team_ids", "")
    return {
        "metric": fields["metric"],
        "variant": fields["variant"],
        "season_ids": [s for s in fields["season_ids"].split(",") if s],
        "team_ids": [] if teams == "all-teams" else [int(t) for t in teams.split(",") if t],
        "settings": {k: v for k, v in fields.items() if k not in ("metric", "variant", "team_ids", "season_ids")},
    }


def key_field(key: Column, name: str) -> Column:
    """One part of a key column; null if it has no such part."""
    value = F.regexp_extract(key, rf"(?:^|\|){name}=([^|]*)", 1)
    return F.nullif(value, F.lit(""))


def key_seasons(key: Column) -> Column:
    return F.filter(F.split(key_field(key, "season_ids"), ","), lambda s: s != "")


def key_teams(key: Column) -> Column:
    """Team ids of a key; empty for all teams."""
    listed = key_field(key, "team_ids")
    ids = F.transform(F.split(listed, ","), lambda t: t.try_cast("bigint"))
    return F.when(listed == "all-teams", F.array().cast("array<bigint>")).otherwise(ids)


def is_canonical_key(key: Column, metric: str) -> Column:
    """Whether writing the parsed parts again gives the same key."""
    seasons = key_seasons(key)

    def order(season: Column) -> Column:
        parsed = parse_season_id(season)
        return F.struct(
            parsed["start_year"].alias("y"), type_order(parsed["season_type"]).alias("o"), season.alias("s")
        )

    sorted_seasons = F.transform(F.array_sort(F.array_distinct(F.transform(seasons, order))), lambda s: s["s"])
    parts = [
        F.lit(f"metric={metric}"),
        F.lit(f"variant={variant(metric)}"),
        F.concat(F.lit("team_ids="), key_field(key, "team_ids")),
        F.concat(F.lit("season_ids="), F.array_join(sorted_seasons, ",")),
    ]
    for name in SETTINGS[metric]:
        text = key_field(key, name)
        number = two_decimals(text.try_cast("double"))
        parts.append(F.concat(F.lit(f"{name}="), text if name in _TEXT_SETTINGS else number))
    teams = key_field(key, "team_ids")
    seasons_valid = F.forall(seasons, lambda s: canonical_season_id(s).eqNullSafe(s))
    teams_valid = (teams == "all-teams") | canonical_team_filter(teams).isNotNull()
    # concat_ws skips nulls, so a missing setting shortens the text and fails the comparison.
    return F.coalesce(seasons_valid & teams_valid & (F.concat_ws("|", *parts) == key), F.lit(False))
