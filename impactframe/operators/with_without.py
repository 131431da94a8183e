"""With/without margins per player and season.

A player's without-games are all games of every team the player appeared for in
that season, minus the games played. So instead of comparing players with games,
sum what a player played and subtract it from the team's totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from impactframe.functions.scores import shrunk_score
from impactframe.functions.seasons import season_id
from impactframe.schemas import SCOPE, SEASON, SIDE


def positive_minutes() -> Column:
    """Appeared and has a minute count above zero."""
    return F.col("appeared") & F.coalesce(F.col("minutes") > 0, F.lit(False))


def game_number() -> Column:
    """Game ids are numbers in text; as a number, the last one can be found by hash aggregation."""
    return F.expr("try_cast(game_id as bigint)")


def minute_filter(min_average: float | None, min_total: float | None) -> Column:
    """Unknown minutes fail a minimum, even a minimum of zero."""
    keep = F.lit(True)
    if min_average is not None:
        keep = keep & F.coalesce(F.col("average_minutes") >= float(min_average), F.lit(False))
    if min_total is not None:
        keep = keep & F.coalesce(F.col("total_minutes") >= float(min_total), F.lit(False))
    return keep


def lineup_issues(games: DataFrame, players: DataFrame) -> DataFrame:
    """Team-games nobody appeared in; they make a with/without split meaningless."""
    seen = players.filter("appeared").select(*SIDE).distinct()
    return games.join(seen, SIDE, "left_anti").select(
        F.lit("games").alias("table"),
        F.format_string("game_id=%s,team_id=%d", "game_id", "team_id").alias("key"),
        F.lit("no appeared players for this team-game").alias("message"),
    )


def with_without(games: DataFrame, players: DataFrame) -> DataFrame:
    """One row per season and player: games and margins with and without, and minutes."""
    margins = games.select(*SIDE, "margin")
    played_minutes = F.when(positive_minutes(), F.col("minutes"))
    # Names are a grouping key here and picked below: sums and counts of numbers
    # aggregate by hash, an aggregate over text would sort every input row.
    by_team = (
        players.filter("appeared")
        .join(margins, SIDE)
        .groupBy(*SCOPE, "player_id", "player_name")
        .agg(
            F.count("*").alias("games_with"),
            F.sum("margin").alias("margin_with"),
            F.sum(played_minutes).alias("minutes"),
            F.count(played_minutes).alias("minute_games"),
            F.max(game_number()).alias("last_game"),
        )
        .groupBy(*SCOPE, "player_id")
        .agg(
            F.sum("games_with").alias("games_with"),
            F.sum("margin_with").alias("margin_with"),
            F.sum("minutes").alias("minutes"),
            F.sum("minute_games").alias("minute_games"),
            F.max(F.struct("season", "team_id", "last_game", "player_name")).alias("last_row"),
        )
    )
    team_totals = games.groupBy(*SCOPE).agg(F.count("*").alias("team_games"), F.sum("margin").alias("team_margin"))
    by_player = (
        by_team.join(team_totals, SCOPE)
        .groupBy(*SEASON, "player_id")
        .agg(
            F.sum("games_with").alias("games_with"),
            F.sum("team_games").alias("team_games"),
            F.sum("margin_with").alias("margin_with"),
            F.sum("team_margin").alias("team_margin"),
            F.sum("minutes").alias("total_minutes"),
            F.sum("minute_games").alias("minute_games"),
            F.max("last_row").alias("last_row"),
        )
    )
    # One group holds at most one row per season, so this window stays small.
    name = F.max("last_row").over(W.partitionBy("player_id"))["player_name"]
    without = F.col("team_games") - F.col("games_with")
    average_with = F.try_divide("margin_with", "games_with")
    average_without = F.try_divide(F.col("team_margin") - F.col("margin_with"), without)
    return by_player.select(
        season_id(F.col("season"), F.col("season_type")).alias("season_id"),
        *SEASON,
        "player_id",
        name.alias("player_name"),
        "games_with",
        without.alias("games_without"),
        average_with.alias("avg_margin_with"),
        average_without.alias("avg_margin_without"),
        (average_with - average_without).alias("value"),
        F.try_divide("total_minutes", "minute_games").alias("average_minutes"),
        "total_minutes",
    )


def player_minutes(players: DataFrame) -> DataFrame:
    """Total and average of the games with positive minutes, per season and player."""
    return (
        players.filter(positive_minutes())
        .groupBy(*SEASON, "player_id")
        .agg(
            F.sum("minutes").alias("total_minutes"),
            F.avg("minutes").alias("average_minutes"),
            F.count("*").alias("minute_games"),
        )
    )


def last_names(players: DataFrame) -> DataFrame:
    """One name per player: that of the last row by season, team and game."""
    spellings = players.groupBy("player_id", "player_name", "season", "team_id").agg(
        F.max(game_number()).alias("last_game")
    )
    return spellings.groupBy("player_id").agg(
        F.max(F.struct("season", "team_id", "last_game", "player_name"))["player_name"].alias("player_name")
    )


def eligible_margins(rows: DataFrame, min_games_with: int, min_games_without: int) -> DataFrame:
    if min_games_with < 0 or min_games_without < 0:
        raise ValueError("minimum game filters must be non-negative")
    return rows.filter(
        (F.col("games_with") >= min_games_with)
        & (F.col("games_without") >= min_games_without)
        & F.col("value").isNotNull()
    )


def wowy(
    games: DataFrame,
    players: DataFrame,
    *,
    min_games_with: int = 15,
    min_games_without: int = 2,
    min_average_minutes: float | None = 30.0,
    min_total_minutes: float | None = 600.0,
) -> DataFrame:
    """Player-season with/without records that pass every filter."""
    rows = eligible_margins(with_without(games, players), min_games_with, min_games_without)
    return rows.filter(minute_filter(min_average_minutes, min_total_minutes)).withColumn(
        "raw_wowy_score", F.lit(None).cast("double")
    )


def wowy_shrunk(games: DataFrame, players: DataFrame, *, prior_games: float = 10.0, **filters) -> DataFrame:
    """The same records with the value shrunk; the unshrunk margin stays beside it."""
    score = shrunk_score(F.col("games_with"), F.col("games_without"), F.col("value"), prior_games)
    return (
        wowy(games, players, **filters)
        .withColumn("raw_wowy_score", F.col("value"))
        .withColumn("value", score)
    )


def newest_first(rows: DataFrame, value: str = "value") -> DataFrame:
    """Display order of live player-season rows."""
    return rows.orderBy(F.desc("season_id"), F.desc(value), F.desc("player_name"))


def stored_order(rows: DataFrame, value: str = "value") -> DataFrame:
    """Display order of stored player-season rows."""
    return rows.orderBy(F.asc("season_id"), F.desc(value), F.asc("player_name"))
