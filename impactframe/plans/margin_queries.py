"""Registered queries: canonical tables, with/without margins and leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactframe.operators import leaderboard as L
from impactframe.operators import with_without as M
from impactframe.plans.reference_sql import WITH_WITHOUT, over
from impactframe.sources.sample_tables import game_players_view, games_view

# The sample games are shorter than real ones.
MINUTES = {"min_average_minutes": 20.0, "min_total_minutes": 600.0}


def tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return games_view(spark, folder), game_players_view(spark, folder)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the fractional columns, so that the order of summation does not show; adding zero drops its sign."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def games_text(spark, folder):
    return games_view(spark, folder).withColumn("game_date", F.col("game_date").cast("string"))


def with_without(spark, folder):
    return rounded(M.with_without(*tables(spark, folder)))


def wowy_player_season(spark, folder):
    return rounded(M.wowy(*tables(spark, folder), **MINUTES))


def wowy_shrunk(spark, folder):
    return rounded(M.wowy_shrunk(*tables(spark, folder), **MINUTES))


def minutes_player_season(spark, folder):
    return rounded(M.player_minutes(game_players_view(spark, folder)))


def player_names(spark, folder):
    return M.last_names(game_players_view(spark, folder))


def wowy_leaderboard(spark, folder):
    board = L.leaderboard(M.wowy(*tables(spark, folder), **MINUTES), "wowy", 30)
    return rounded(board.drop("points"))


def wowy_points(spark, folder):
    board = L.leaderboard(M.wowy(*tables(spark, folder), **MINUTES), "wowy", 30)
    return rounded(L.series_points(board))


def shrunk_leaderboard_all(spark, folder):
    board = L.full_leaderboard(M.wowy_shrunk(*tables(spark, folder), **MINUTES), "wowy_shrunk")
    return rounded(board.select("rank", "player_id", "player_name", "span_average_value", "season_count"))


def leaderboard_span(spark, folder):
    span = L.span_summary(M.wowy(*tables(spark, folder), **MINUTES), 30)
    return span.withColumn("available_seasons", F.array_join("available_seasons", ","))


def player_season_table(spark, folder):
    return rounded(L.player_season_table(M.wowy(*tables(spark, folder), **MINUTES), "wowy"))


def lineup_issues(spark, folder):
    games, players = tables(spark, folder)
    # Players of every 101st game go missing, so that there is something to report.
    return M.lineup_issues(games, players.filter(F.col("game_id").cast("bigint") % 101 != 0))


QUERIES = {
    "games_view": games_text,
    "game_players_view": game_players_view,
    "with_without": with_without,
    "wowy_player_season": wowy_player_season,
    "wowy_shrunk": wowy_shrunk,
    "minutes_player_season": minutes_player_season,
    "player_names": player_names,
    "wowy_leaderboard": wowy_leaderboard,
    "wowy_points": wowy_points,
    "shrunk_leaderboard_all": shrunk_leaderboard_all,
    "leaderboard_span": leaderboard_span,
    "player_season_table": player_season_table,
    "lineup_issues": lineup_issues,
}

_MARGIN_COLUMNS = """season_id, season, season_type, player_id, player_name, games_with, games_without,
  round(avg_margin_with, 6) AS avg_margin_with, round(avg_margin_without, 6) AS avg_margin_without,
  round(average_minutes, 6) AS average_minutes, total_minutes"""

_SHRUNK = """2.0 * games_with * games_without / (games_with + games_without)
  / (2.0 * games_with * games_without / (games_with + games_without) + 10.0) * value"""

_BOARD = """
span AS (SELECT DISTINCT season FROM kept),
board AS (
  SELECT player_id, max(player_name) AS player_name, sum(value) / (SELECT count(*) FROM span) AS span_average_value,
    sum(total_minutes) / sum(games_with) AS average_minutes, sum(total_minutes) AS total_minutes,
    CAST(sum(games_with) AS BIGINT) AS games_with, CAST(sum(games_without) AS BIGINT) AS games_without,
    sum(avg_margin_with * games_with) / sum(games_with) AS avg_margin_with,
    sum(avg_margin_without * games_without) / sum(games_without) AS avg_margin_without,
    count(*) AS season_count
  FROM kept GROUP BY player_id),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY span_average_value DESC, player_name DESC, player_id) AS rank FROM board),
top AS (SELECT * FROM ranked WHERE rank <= 30)"""

ORACLES = {
    "games_view": over(
        select="SELECT game_id, season, season_type, CAST(game_date AS VARCHAR) AS game_date, team_id, opponent_team_id, is_home, margin, source FROM games"
    ),
    "game_players_view": over(
        select="SELECT game_id, season, season_type, team_id, player_id, player_name, appeared, minutes FROM players"
    ),
    "with_without": over(
        WITH_WITHOUT, select=f"SELECT {_MARGIN_COLUMNS}, round(value, 6) AS value FROM margins"
    ),
    "wowy_player_season": over(
        WITH_WITHOUT,
        select=f"SELECT {_MARGIN_COLUMNS}, round(value, 6) AS value, CAST(NULL AS DOUBLE) AS raw_wowy_score FROM kept",
    ),
    "wowy_shrunk": over(
        WITH_WITHOUT,
        select=f"SELECT {_MARGIN_COLUMNS}, round({_SHRUNK}, 6) AS value, round(value, 6) AS raw_wowy_score FROM kept",
    ),
    "minutes_player_season": over(
        WITH_WITHOUT,
        select="""SELECT season, season_type, player_id, sum(minutes) AS total_minutes,
          round(avg(minutes), 6) AS average_minutes, count(*) AS minute_games
          FROM players WHERE appeared AND minutes > 0 GROUP BY season, season_type, player_id""",
    ),
    "player_names": over(
        select="""SELECT player_id, arg_max(player_name, (season, team_id, CAST(game_id AS BIGINT))) AS player_name
          FROM players GROUP BY player_id"""
    ),
    "wowy_leaderboard": over(
        WITH_WITHOUT,
        _BOARD,
        select="""SELECT rank, player_id, player_name, round(span_average_value, 6) AS span_average_value,
          round(average_minutes, 6) AS average_minutes, total_minutes, games_with, games_without,
          round(avg_margin_with, 6) AS avg_margin_with, round(avg_margin_without, 6) AS avg_margin_without,
          season_count FROM top""",
    ),
    "wowy_points": over(
        WITH_WITHOUT,
        _BOARD,
        select="""SELECT t.rank, t.player_id, s.season, round(k.value, 6) AS value
          FROM top t CROSS JOIN span s LEFT JOIN kept k ON k.player_id = t.player_id AND k.season = s.season""",
    ),
    "shrunk_leaderboard_all": over(
        WITH_WITHOUT,
        f"""
shrunk AS (SELECT player_id, player_name, season, {_SHRUNK} AS value FROM kept),
totals AS (
  SELECT player_id, max(player_name) AS player_name, count(*) AS season_count,
    sum(value) / (SELECT count(DISTINCT season) FROM shrunk) AS span_average_value
  FROM shrunk GROUP BY player_id)""",
        select="""SELECT row_number() OVER (ORDER BY span_average_value DESC, player_name DESC, player_id) AS rank,
          player_id, player_name, round(span_average_value, 6) AS span_average_value, season_count FROM totals""",
    ),
    "leaderboard_span": over(
        WITH_WITHOUT,
        select="""SELECT min(season) AS start_season, max(season) AS end_season,
          string_agg(DISTINCT season, ',' ORDER BY season) AS available_seasons, CAST(30 AS INTEGER) AS top_n FROM kept""",
    ),
    "player_season_table": over(
        WITH_WITHOUT,
        select="""SELECT season AS season_id, player_id, player_name, round(value, 6) AS value,
          games_with AS sample_size, games_without AS secondary_sample_size, games_with, games_without,
          round(avg_margin_with, 6) AS avg_margin_with, round(avg_margin_without, 6) AS avg_margin_without,
          round(average_minutes, 6) AS average_minutes, total_minutes, CAST(NULL AS DOUBLE) AS raw_wowy_score
          FROM kept""",
    ),
    "lineup_issues": over(
        select="""SELECT 'games' AS "table", 'game_id=' || game_id || ',team_id=' || team_id AS key,
          'no appeared players for this team-game' AS message FROM games g
          WHERE NOT EXISTS (SELECT 1 FROM players p WHERE p.game_id = g.game_id AND p.team_id = g.team_id
            AND p.appeared AND CAST(p.game_id AS BIGINT) % 101 <> 0)""",
    ),
}
