"""Small hand-built tables."""

import datetime as dt

from impactframe import schemas


def games(spark, rows, season="2022-23", season_type="Regular Season"):
    """rows: (game_id, team, opponent, is_home, margin) and optionally a day or a season."""
    full = []
    for row in rows:
        game, team, opponent, home, margin, *rest = row
        day = next((r for r in rest if isinstance(r, dt.date)), dt.date(int(season[:4]), 11, 1))
        own_season = next((r for r in rest if isinstance(r, str)), season)
        full.append((str(game), own_season, season_type, day, team, opponent, home, float(margin), "test"))
    return spark.createDataFrame(full, schemas.GAMES)


def players(spark, rows, season="2022-23", season_type="Regular Season"):
    """rows: (game_id, team, player_id, minutes) and optionally a season; None minutes did not appear."""
    full = []
    for row in rows:
        game, team, player, minutes, *rest = row
        own_season = rest[0] if rest else season
        appeared = minutes is not None
        full.append((str(game), own_season, season_type, team, player, f"Player {player}", appeared, minutes))
    return spark.createDataFrame(full, schemas.GAME_PLAYERS)


def dimension(spark, teams, years):
    rows = [(t, y, f"T{t:02d}", "City", "Club", "City Club") for t in teams for y in years]
    return spark.createDataFrame(
        rows, "team_id bigint, start_year int, abbreviation string, city string, nickname string, full_name string"
    )
