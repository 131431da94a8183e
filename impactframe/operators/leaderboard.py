"""Multi-season leaderboards over player-season rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactframe.functions.scores import weighted_average
from impactframe.functions.seasons import type_code
from impactframe.operators.ranking import positions, top_rows
from impactframe.session import keep


@dataclass(frozen=True)
class Board:
    """What differs between the metrics' boards."""

    value: str
    games: str
    label: str
    margins: bool


BOARDS = {
    "wowy": Board("value", "games_with", "WOWY", True),
    "wowy_shrunk": Board("value", "games_with", "WOWY Shrunk", True),
    "ridge": Board("coefficient", "games", "Ridge", False),
}

# Column order and headings of the exported file.
EXPORT_HEADINGS = {
    "rank": "Rank",
    "player_id": "Player ID",
    "player_name": "Player",
    "span_average_value": None,
    "average_minutes": "Avg Min",
    "total_minutes": "Tot Min",
    "games": "Games",
    "games_with": "With",
    "games_without": "Without",
    "avg_margin_with": "Avg With",
    "avg_margin_without": "Avg Without",
    "season_count": "Seasons",
    "points": "Points",
}


def span_seasons(rows: DataFrame) -> Column:
    """Scalar: the sorted season texts that still have rows. A span has as many entries as seasons exist."""
    return rows.agg(F.array_sort(F.collect_set("season")).alias("seasons")).scalar()


def span_summary(rows: DataFrame, top_n: int) -> DataFrame:
    """First and last season, all seasons, and the limit the board was asked for."""
    seasons = F.array_sort(F.collect_set("season"))
    return rows.agg(
        F.min("season").alias("start_season"),
        F.max("season").alias("end_season"),
        seasons.alias("available_seasons"),
        F.lit(top_n).alias("top_n"),
    )


def board_rows(rows: DataFrame, metric: str) -> DataFrame:
    """One unranked row per player. Seasons a player missed count as zero in the span average."""
    board = BOARDS[metric]
    value, games = F.col(board.value), F.col(board.games)
    # Read by the span and by the board itself.
    rows = keep(rows)
    span = span_seasons(rows)
    extra: list[Column] = []
    if board.margins:
        extra = [
            F.sum("games_without").alias("games_without"),
            weighted_average(F.col("avg_margin_with"), games).alias("avg_margin_with"),
            weighted_average(F.col("avg_margin_without"), F.col("games_without")).alias("avg_margin_without"),
        ]
    # A player has at most one row per season and type, so the list is short.
    point = F.struct("season", type_code(F.col("season_type")).alias("type"), value.alias("value"))
    players = rows.groupBy("player_id").agg(
        F.max_by("player_name", "season_id").alias("player_name"),
        F.sum(value).alias("_total_value"),
        F.sum(F.coalesce("total_minutes", F.lit(0.0))).alias("total_minutes"),
        F.sum(games).cast("bigint").alias(board.games),
        *extra,
        F.count("*").alias("season_count"),
        F.reverse(F.array_sort(F.collect_list(point))).alias("_points"),
    )

    def season_point(season: Column) -> Column:
        first = F.try_element_at(F.filter("_points", lambda p: p["season"] == season), F.lit(1))
        return F.struct(season.alias("season"), first["value"].alias("value"))

    return (
        players.withColumn("_span", span)
        .withColumn("span_average_value", F.col("_total_value") / F.greatest(F.size("_span"), F.lit(1)))
        .withColumn("average_minutes", F.when(F.col(board.games) > 0, F.try_divide("total_minutes", board.games)))
        .withColumn("points", F.transform("_span", season_point))
        .drop("_total_value", "_points", "_span")
    )


def _order() -> list[Column]:
    return [F.desc("span_average_value"), F.desc("player_name"), F.asc("player_id")]


def leaderboard(rows: DataFrame, metric: str, top_n: int = 30) -> DataFrame:
    """The ``top_n`` players by span average."""
    return top_rows(board_rows(rows, metric), _order(), top_n)


def full_leaderboard(rows: DataFrame, metric: str) -> DataFrame:
    """Every player with a rank, for export."""
    return positions(board_rows(rows, metric), [], _order(), "rank")


def leaderboard_series(board: DataFrame) -> DataFrame:
    """The chart columns of a leaderboard."""
    return board.select("player_id", "player_name", "span_average_value", "season_count", "points")


def series_points(board: DataFrame) -> DataFrame:
    """One row per player and season of the span; seasons without a value stay as null."""
    return board.select("rank", "player_id", F.inline("points"))


def player_season_table(rows: DataFrame, metric: str) -> DataFrame:
    """Flat player-season columns with generic sample sizes beside the metric's own."""
    board = BOARDS[metric]
    common = [
        F.col("season").alias("season_id"),
        "player_id",
        "player_name",
        F.col(board.value).alias("value"),
        F.col(board.games).alias("sample_size"),
    ]
    minutes = ["average_minutes", "total_minutes"]
    if not board.margins:
        return rows.select(*common, F.lit(None).cast("bigint").alias("secondary_sample_size"), "games", *minutes)
    return rows.select(
        *common,
        F.col("games_without").alias("secondary_sample_size"),
        "games_with",
        "games_without",
        "avg_margin_with",
        "avg_margin_without",
        *minutes,
        "raw_wowy_score",
    )


def full_span_series(rows: DataFrame, season_ids: list[str], value: str, top_n: int | None = None) -> DataFrame:
    """Chart series of stored rows: ranked by total, divided by the number of season ids asked for."""
    point = F.struct("season_id", F.col(value).alias("value"))
    wanted = F.array(*[F.lit(s) for s in season_ids])
    players = (
        rows.filter(F.col(value).isNotNull() & F.col("season_id").isin(season_ids))
        .groupBy("player_id")
        .agg(
            F.max_by("player_name", "season_id").alias("player_name"),
            F.sum(value).alias("total_value"),
            F.count("*").alias("season_count"),
            F.map_from_entries(F.collect_list(point)).alias("_by_season"),
        )
        .withColumn("span_average_value", F.col("total_value") / F.lit(max(len(season_ids), 1)))
        .withColumn(
            "points_by_season",
            F.filter(
                F.transform(
                    wanted,
                    lambda s: F.struct(s.alias("season_id"), F.try_element_at("_by_season", s).alias("value")),
                ),
                lambda p: p["value"].isNotNull(),
            ),
        )
    )
    order = [F.desc("total_value"), F.desc("player_name"), F.asc("player_id")]
    ranked = (
        positions(players, [], order, "rank_order")
        if top_n is None
        else top_rows(players, order, top_n, "rank_order")
    )
    return ranked.drop("total_value", "_by_season")


def _export_text(name: str, kind: str) -> Column:
    if name == "points":
        text = F.to_json(name, {"ignoreNullFields": "false"})
    elif kind in ("double", "float"):
        text = _six_digits(F.col(name))
    else:
        text = F.col(name).cast("string")
    return F.coalesce(text, F.lit("—"))


def _six_digits(value: Column) -> Column:
    """Six significant digits without trailing zeros, in e-notation outside 1e-4 .. 1e6."""
    scientific = F.format_string("%.5e", value)
    exponent = F.regexp_extract(scientific, r"e([+-]\d+)$", 1).try_cast("int")
    mantissa = F.regexp_replace(F.regexp_extract(scientific, r"^(.*)e", 1), r"\.?0+$", "")
    # Rounding to the shortest decimal that has six digits keeps the fixed form exact.
    fixed = scientific.try_cast("decimal(38,18)").cast("string")
    fixed = F.regexp_replace(fixed, r"\.?0+$", "")
    return (
        F.when(value.isNull(), F.lit(None))
        .when(value == 0, F.lit("0"))
        .when((exponent < -4) | (exponent >= 6), F.concat(mantissa, F.lit("e"), F.regexp_extract(scientific, r"e(.*)$", 1)))
        .otherwise(fixed)
    )


def export_columns(board: DataFrame, metric: str) -> DataFrame:
    """A ranked board as text columns with display headings; unknown columns follow in name order."""
    kinds = dict(board.dtypes)
    names = [c for c in EXPORT_HEADINGS if c in kinds] + sorted(set(kinds) - set(EXPORT_HEADINGS))
    headings = {**EXPORT_HEADINGS, "span_average_value": BOARDS[metric].label}
    return board.orderBy("rank").select(*[_export_text(c, kinds[c]).alias(headings.get(c, c)) for c in names])


def export_csv(board: DataFrame, metric: str, path: str) -> None:
    export_columns(board, metric).write.mode("overwrite").csv(path, header=True, escape='"')
