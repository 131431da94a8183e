"""The canonical tables, read out of the order tables used for testing.

Two consecutive orders form a game, the customer's nation is the team, suppliers
are the players and shipped quantity is their playing time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactframe.functions.seasons import season_text, start_year_of_date
from impactframe.session import keep


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _games_by_order(spark: SparkSession, folder: str) -> DataFrame:
    """Two rows per game, each with the order it was made from."""
    played = (
        read_table(spark, folder, "lineitem")
        .filter(F.col("l_returnflag") != "R")
        .select(F.col("l_orderkey").alias("order_key"))
        .distinct()
    )
    customers = read_table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    side = {
        "order_key": F.col("order_key"),
        "team_id": (F.col("c_nationkey") + 1).cast("bigint"),
        "price": F.col("o_totalprice"),
        "day": F.col("o_orderdate").cast("date"),
    }
    is_home = F.col("order_key") % 2 == 0
    pairs = (
        read_table(spark, folder, "orders")
        .select(F.col("o_orderkey").alias("order_key"), "o_custkey", "o_totalprice", "o_orderdate")
        .join(played, "order_key", "left_semi")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.floor(F.col("order_key") / 2).alias("game_number"))
        .agg(
            *[F.max(F.when(is_home, value)).alias(f"home_{name}") for name, value in side.items()],
            *[F.max(F.when(~is_home, value)).alias(f"away_{name}") for name, value in side.items()],
        )
        .filter(F.col("home_team_id") != F.col("away_team_id"))
        .withColumn("margin", F.floor((F.col("home_price") - F.col("away_price")) / 10000).cast("double"))
    )

    def row(mine: str, other: str, home: bool) -> F.Column:
        return F.struct(
            F.col(f"{mine}_order_key").alias("order_key"),
            F.col(f"{mine}_team_id").alias("team_id"),
            F.col(f"{other}_team_id").alias("opponent_team_id"),
            F.lit(home).alias("is_home"),
            (F.col("margin") if home else F.lit(0.0) - F.col("margin")).alias("margin"),
        )

    return pairs.select(
        F.col("game_number").cast("string").alias("game_id"),
        season_text(start_year_of_date(F.col("home_day"))).alias("season"),
        F.lit("Regular Season").alias("season_type"),
        F.col("home_day").alias("game_date"),
        F.inline(F.array(row("home", "away", True), row("away", "home", False))),
        F.lit("orders").alias("source"),
    )


def games_view(spark: SparkSession, folder: str) -> DataFrame:
    return _games_by_order(spark, folder).select(
        "game_id", "season", "season_type", "game_date", "team_id", "opponent_team_id", "is_home", "margin", "source"
    )


def _player_lines(lines: DataFrame) -> DataFrame:
    """Every order's players, whether they appeared and for how long."""
    counted = F.col("l_returnflag") != "R"
    return lines.groupBy(F.col("l_orderkey").alias("order_key"), (F.col("l_suppkey") + 1).alias("player_id")).agg(
        F.max(counted).alias("appeared"),
        F.sum(F.when(counted, F.col("l_quantity"))).alias("minutes"),
    )


def games_with_players(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of ``games_view``, those of ``game_players_view`` with ``is_home`` and without names, and all player
    ids of the latter, with the games computed once and the lines of an order shuffled once."""
    sides = keep(_games_by_order(spark, folder))
    lines = read_table(spark, folder, "lineitem")
    # Dealt by order, lines are counted and joined where they are.
    by_order = lines.select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag").repartition("l_orderkey")
    players = _player_lines(by_order).join(sides.select("order_key", "game_id", "team_id", "is_home"), "order_key")
    ids = lines.select(F.col("l_orderkey").alias("order_key"), (F.col("l_suppkey") + 1).alias("player_id"))
    ids = ids.join(sides.select("order_key"), "order_key", "left_semi").select("player_id").distinct()
    return sides.drop("order_key"), players.drop("order_key"), ids


def game_players_view(spark: SparkSession, folder: str) -> DataFrame:
    lines = _player_lines(read_table(spark, folder, "lineitem"))
    sides = _games_by_order(spark, folder).select("order_key", "game_id", "season", "season_type", "team_id")
    return lines.join(sides, "order_key").select(
        "game_id",
        "season",
        "season_type",
        "team_id",
        "player_id",
        F.concat(F.lit("Player "), F.col("player_id").cast("string")).alias("player_name"),
        "appeared",
        "minutes",
    )


def loads_view(games: DataFrame, players: DataFrame) -> DataFrame:
    """Load metadata of the sample tables.

    Every eleventh team lacks one expected game in odd start years and every
    thirteenth has no expected count, so that completeness has something to find.
    """
    scope = ["team_id", "season", "season_type"]
    game_counts = games.groupBy(*scope).agg(F.count("*").alias("games_row_count"))
    player_counts = players.groupBy(*scope).agg(F.count("*").alias("game_players_row_count"))
    odd_year = F.substring("season", 1, 4).cast("int") % 2 == 1
    short = ((F.col("team_id") % 11 == 0) & odd_year).cast("bigint")
    return game_counts.join(player_counts, scope, "left").select(
        *scope,
        F.lit("orders").alias("source_path"),
        F.lit("sample-v1").alias("source_snapshot"),
        F.lit("orders").alias("source_kind"),
        F.lit("v1").alias("build_version"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("refreshed_at"),
        "games_row_count",
        F.coalesce("game_players_row_count", F.lit(0)).alias("game_players_row_count"),
        F.when(F.col("team_id") % 13 != 0, F.col("games_row_count") + short).alias("expected_games_row_count"),
        F.lit(0).cast("bigint").alias("skipped_games_row_count"),
    )
