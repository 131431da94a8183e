"""Games, players and box scores from flat text files, to the canonical tables."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from impactframe.functions.seasons import season_text, start_year_of_date, type_code, type_text
from impactframe.functions.text import is_blank, text_or_null, whole_number
from impactframe.operators import quality as Q
from impactframe.schemas import SCOPE, SIDE
from impactframe.session import keep

# Game types that count, and as what.
COUNTED_GAME_TYPES = {
    "Regular Season": "Regular Season",
    "NBA Emirates Cup": "Regular Season",
    "Emirates NBA Cup": "Regular Season",
    "NBA Cup": "Regular Season",
    "Playoffs": "Playoffs",
    "Preseason": "Preseason",
    "Pre Season": "Preseason",
}
# Game types that are left out on purpose.
SKIPPED_GAME_TYPES = ["", "All-Star Game", "Play-in Tournament", "in-season-knockout"]
# A player with any of these above or below zero took part.
ACTIVITY_COLUMNS = [
    "points",
    "assists",
    "blocks",
    "steals",
    "fieldGoalsAttempted",
    "fieldGoalsMade",
    "threePointersAttempted",
    "threePointersMade",
    "freeThrowsAttempted",
    "freeThrowsMade",
    "reboundsDefensive",
    "reboundsOffensive",
    "reboundsTotal",
    "foulsPersonal",
    "turnovers",
    "plusMinusPoints",
]

GAME_COLUMNS = ["gameId", "gameType", "gameDateTimeEst", "hometeamId", "awayteamId", "homeScore", "awayScore"]
PLAYER_COLUMNS = ["gameId", "home", "personId", "firstName", "lastName", "numMinutes", *ACTIVITY_COLUMNS]
NAME_COLUMNS = ["personId", "firstName", "lastName"]


@dataclass(frozen=True)
class Ingested:
    """Canonical tables of one load, and everything that kept rows out of them."""

    games: DataFrame
    game_players: DataFrame
    loads: DataFrame
    issues: DataFrame
    failures: DataFrame | None = None


def read_text_columns(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every column as text."""
    df = spark.read.csv(path, header=True, escape='"', inferSchema=False)
    return df.toDF(*[c.removeprefix("﻿") for c in df.columns])


def columns_of(df: DataFrame, names: list[str]) -> DataFrame:
    """Exactly these columns; those the file lacks are empty."""
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])


def distinct_games(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per game id, conflicting rows). Identical repeats collapse; no one of differing ones is right."""
    # Rows dealt by their id are made distinct and counted where they are. Rows without an id do not conflict.
    known = raw.filter(F.col("gameId").isNotNull()).repartition("gameId").distinct()
    counted = keep(known.withColumn("_variants", F.count("*").over(W.partitionBy("gameId"))))
    settled = counted.filter("_variants = 1").drop("_variants").unionByName(raw.filter(F.col("gameId").isNull()).distinct())
    return settled, counted.filter("_variants > 1").drop("_variants")


def player_dictionary(raw: DataFrame) -> DataFrame:
    """Id to name; of several names the last in file order counts."""
    name = text_or_null(F.concat_ws(" ", F.trim("firstName"), F.trim("lastName")))
    return (
        raw.select(
            whole_number(F.col("personId")).alias("player_id"),
            name.alias("dictionary_name"),
            F.monotonically_increasing_id().alias("_line"),
        )
        .filter(F.col("player_id").isNotNull() & F.col("dictionary_name").isNotNull())
        .groupBy("player_id")
        .agg(F.max_by("dictionary_name", "_line").alias("dictionary_name"))
    )


def _counted_type(raw: Column) -> Column:
    pairs = [F.lit(v) for item in COUNTED_GAME_TYPES.items() for v in item]
    return type_text(type_code(F.try_element_at(F.create_map(*pairs), F.trim(raw))))


def prepared_games(raw: DataFrame, dimension: DataFrame) -> DataFrame:
    """Typed game rows with known team ids (null if unknown), counted type (null if left out) and ``problem``."""
    known = dimension.select("team_id").distinct()
    day = F.split(F.trim("gameDateTimeEst"), " ")[0].try_cast("date")
    kind = F.trim("gameType")
    typed = raw.select(
        F.trim("gameId").alias("game_id"),
        kind.alias("game_type"),
        _counted_type(F.col("gameType")).alias("season_type"),
        day.alias("game_date"),
        whole_number(F.col("hometeamId")).alias("home_id"),
        whole_number(F.col("awayteamId")).alias("away_id"),
        whole_number(F.col("homeScore")).alias("home_score"),
        whole_number(F.col("awayScore")).alias("away_score"),
    )
    counted = F.col("season_type").isNotNull()
    joined = typed
    for side in ("home", "away"):
        team = known.select(F.col("team_id").alias(f"{side}_team"))
        joined = joined.join(team, F.col(f"{side}_id") == F.col(f"{side}_team"), "left")
    scored = counted & F.col("home_team").isNotNull() & F.col("away_team").isNotNull()
    problem = Q.first_problem(
        (is_blank(F.col("game_id")), "missing gameId"),
        (is_blank(F.col("game_type")), "missing gameType"),
        (~counted & ~F.col("game_type").isin(SKIPPED_GAME_TYPES), F.concat(F.lit("unsupported gameType "), F.col("game_type"))),
        (F.col("game_date").isNull(), "missing or invalid gameDateTimeEst"),
        (F.col("home_id").isNull() | F.col("away_id").isNull(), "missing or invalid team id"),
        (scored & (F.col("home_score").isNull() | F.col("away_score").isNull()), "missing or invalid score"),
    )
    return joined.withColumn("season", season_text(start_year_of_date(F.col("game_date")))).withColumn("problem", problem)


def game_rows(prepared: DataFrame, source: str) -> DataFrame:
    """Two canonical rows per counted game between known teams."""
    margin = (F.col("home_score") - F.col("away_score")).cast("double")

    def row(mine: str, other: str, home: bool) -> Column:
        return F.struct(
            F.col(f"{mine}_team").alias("team_id"),
            F.col(f"{other}_team").alias("opponent_team_id"),
            F.lit(home).alias("is_home"),
            (margin if home else F.lit(0.0) - margin).alias("margin"),
        )

    return (
        _countable(prepared)
        .select(
            "game_id",
            "season",
            "season_type",
            "game_date",
            F.inline(F.array(row("home", "away", True), row("away", "home", False))),
            F.lit(source).alias("source"),
        )
    )


def _countable(prepared: DataFrame) -> DataFrame:
    return prepared.filter("problem is null and season_type is not null and home_team is not null and away_team is not null")


def skipped_counts(prepared: DataFrame) -> DataFrame:
    """Games left out per scope. Games of a skipped type count against the regular season."""
    out = prepared.filter(
        "problem is null and (season_type is null or home_team is null or away_team is null)"
    )
    return (
        out.select(
            F.explode(F.array_compact(F.array("home_team", "away_team"))).alias("team_id"),
            "season",
            F.coalesce("season_type", F.lit("Regular Season")).alias("season_type"),
        )
        .groupBy(*SCOPE)
        .agg(F.count("*").alias("skipped_games_row_count"))
    )


def prepared_players(raw: DataFrame, prepared: DataFrame, names: DataFrame) -> DataFrame:
    """Canonical player rows of the counted games, with ``problem``."""

    def value(column: str) -> Column:
        return F.coalesce(F.trim(column).try_cast("double"), F.lit(0.0))

    minutes = F.greatest(value("numMinutes"), F.lit(0.0))
    active = minutes > 0
    for column in ACTIVITY_COLUMNS:
        active = active | (value(column) != 0)
    written = ["numMinutes", *ACTIVITY_COLUMNS]
    unreadable = F.lit(False)
    for column in written:
        unreadable = unreadable | (~is_blank(F.col(column)) & F.trim(column).try_cast("double").isNull())
    flag = F.trim("home")
    typed = raw.select(
        F.trim("gameId").alias("game_id"),
        flag.alias("home_flag"),
        whole_number(F.col("personId")).alias("player_id"),
        text_or_null(F.concat_ws(" ", F.trim("firstName"), F.trim("lastName"))).alias("own_name"),
        active.alias("appeared"),
        minutes.alias("minutes"),
        unreadable.alias("unreadable"),
    )
    games = _countable(prepared).select("game_id", "season", "season_type", "home_team", "away_team")
    problem = Q.first_problem(
        (~F.coalesce(F.col("home_flag").isin("0", "1"), F.lit(False)), "invalid home flag"),
        (F.col("player_id").isNull(), "missing or invalid personId"),
        (F.col("player_name").isNull(), "blank player name"),
        (F.col("unreadable"), "unreadable minutes or statistics"),
    )
    # The games come last, so that the rows of a team-game stay together and are counted before they are sent.
    return (
        typed.join(names, "player_id", "left")
        .withColumn("player_name", F.coalesce("own_name", "dictionary_name"))
        .drop("own_name", "dictionary_name")
        .join(games, "game_id")
        .select(
            "game_id",
            "season",
            "season_type",
            F.when(F.col("home_flag") == "1", F.col("home_team")).when(F.col("home_flag") == "0", F.col("away_team")).alias("team_id"),
            "player_id",
            "player_name",
            "appeared",
            "minutes",
            "home_flag",
            "unreadable",
        )
        .withColumn("problem", problem)
        .drop("home_flag", "unreadable")
    )


def covered(games: DataFrame, players: DataFrame, minimum: int = Q.MIN_APPEARED) -> tuple[DataFrame, DataFrame]:
    """Only team-games in which enough players appeared."""
    enough = (
        players.groupBy(*SIDE).agg(F.count_if("appeared").alias("_n")).filter(F.col("_n") >= minimum).select(*SIDE)
    )
    # The rows of the kept games as a common side for both tables.
    kept = games.select(*SIDE).join(enough, SIDE, "left_semi")
    return games.join(kept, SIDE, "left_semi"), players.join(kept, SIDE, "left_semi")


def normalize(
    raw_games: DataFrame,
    raw_players: DataFrame,
    raw_names: DataFrame,
    dimension: DataFrame,
    *,
    source: str = "kaggle",
    source_path: str = "",
    source_snapshot: str = "",
    build_version: str = "v1",
) -> Ingested:
    """Canonical tables out of the raw text columns of the three files."""
    rows, conflicting = distinct_games(columns_of(raw_games, GAME_COLUMNS))
    # Read by the rows, the counts and the issues; parsing happens once.
    prepared = keep(prepared_games(rows, dimension))
    unsettled = keep(prepared_games(conflicting, dimension))
    all_games = game_rows(prepared, source)
    names = player_dictionary(columns_of(raw_names, NAME_COLUMNS))
    typed_players = keep(prepared_players(columns_of(raw_players, PLAYER_COLUMNS), prepared, names))
    good = typed_players.filter("problem is null").drop("problem")
    games, players = covered(all_games, good)

    # Rejected games are expected too, so a season without them is not complete.
    expected = _counted_sides(prepared.unionByName(unsettled)).groupBy(*SCOPE).agg(F.count("*").alias("expected_games_row_count"))
    stored_games = games.groupBy(*SCOPE).agg(F.count("*").alias("games_row_count"))
    stored_players = players.groupBy(*SCOPE).agg(F.count("*").alias("game_players_row_count"))
    loads = (
        stored_games.join(stored_players, SCOPE)
        .join(expected, SCOPE)
        .join(skipped_counts(prepared), SCOPE, "left")
        .select(
            *SCOPE,
            F.lit(source_path).alias("source_path"),
            F.lit(source_snapshot).alias("source_snapshot"),
            F.lit(source).alias("source_kind"),
            F.lit(build_version).alias("build_version"),
            F.current_timestamp().alias("refreshed_at"),
            "games_row_count",
            "game_players_row_count",
            "expected_games_row_count",
            F.coalesce("skipped_games_row_count", F.lit(0)).alias("skipped_games_row_count"),
        )
    )
    player_key = Q.key_text(game_id="game_id", team_id="team_id", player_id="player_id")
    batch = Q.scope_findings(games, players, total_minutes=None)
    conflicts = conflicting.select("gameId").distinct()
    issues = (
        Q.issue_rows(conflicts, "games", Q.key_text(game_id="gameId"), F.lit(CONFLICT))
        .unionByName(Q.issue_rows(prepared, "games", Q.key_text(game_id="game_id"), F.col("problem")))
        .unionByName(Q.issue_rows(typed_players, "game_players", player_key, F.col("problem")))
        .unionByName(Q.scope_issues(batch))
    )
    failures = _failed_games(prepared.filter("problem is not null"))
    failures = failures.unionByName(_failed_games(unsettled.withColumn("problem", F.lit(CONFLICT))))
    failures = failures.unionByName(_failed_players(typed_players, prepared)).unionByName(_failed_scopes(batch)).distinct()
    return Ingested(games, players, loads, issues, failures)


CONFLICT = "conflicting rows for one game id"


def _counted_sides(prepared: DataFrame) -> DataFrame:
    """The team-games that the rows speak of, whether or not their values can be used."""
    counted = prepared.filter("season_type is not null and home_team is not null and away_team is not null and season is not null")
    return counted.select("game_id", "season", "season_type", F.explode(F.array("home_team", "away_team")).alias("team_id")).distinct()


def _failures(df: DataFrame, kind: str) -> DataFrame:
    return df.select(*SCOPE, "game_id", F.lit(kind).alias("failure_kind"), F.col("problem").alias("message"))


def _failed_games(bad: DataFrame) -> DataFrame:
    """A failure for each known team of the game; the team is null if none is known."""
    teams = F.array_compact(F.array("home_team", "away_team"))
    teams = F.when(F.size(teams) > 0, teams).otherwise(F.array(F.lit(None).cast("bigint")))
    return _failures(bad.withColumn("team_id", F.explode(teams)), "partial_scope_error")


def _failed_players(typed: DataFrame, prepared: DataFrame) -> DataFrame:
    """A failure for the team of the row, or for both if the row does not say which."""
    bad = typed.filter("problem is not null").join(prepared.select("game_id", "home_team", "away_team"), "game_id")
    teams = F.when(F.col("team_id").isNull(), F.array("home_team", "away_team")).otherwise(F.array("team_id"))
    return _failures(bad.withColumn("_teams", teams).drop("team_id").withColumn("team_id", F.explode("_teams")), "partial_scope_error")


def _failed_scopes(findings: DataFrame) -> DataFrame:
    """The first finding of every team-season whose rows are fine one by one, but not together."""
    first = findings.groupBy(*SCOPE).agg(F.min(F.struct("step", "game_id", "message")).alias("first"))
    return _failures(first.select(*SCOPE, "first.game_id", F.col("first.message").alias("problem")), "validation_error")


def whole_scopes(ingested: Ingested) -> Ingested:
    """Only the team-seasons without a failure; a failure without a team refuses its season, one without both everything."""
    refused = ingested.failures.select(*SCOPE).distinct()
    # Every failure that can refuse a team-season equals it in some columns and is null in the others: eight texts to
    # look up by null-safe equality, where "null or equal" would compare all team-seasons with all failures.
    patterns = [
        F.struct(*[F.when(F.lit(known), F.col(c)).alias(c) for c, known in zip(SCOPE, flags, strict=True)])
        for flags in product((True, False), repeat=len(SCOPE))
    ]
    asked = ingested.loads.select(*[F.col(c).alias(f"_{c}") for c in SCOPE], F.inline(F.array(*patterns)))
    hit = F.lit(True)
    for column in SCOPE:
        hit = hit & asked[column].eqNullSafe(refused[column])
    bad = asked.join(refused, hit, "left_semi").select(*[F.col(f"_{c}").alias(c) for c in SCOPE]).distinct()
    kept = [df.join(bad, SCOPE, "left_anti") for df in (ingested.games, ingested.game_players, ingested.loads)]
    return Ingested(*kept, ingested.issues, ingested.failures)


def ingest_folder(spark: SparkSession, folder: str, dimension: DataFrame, *, refuse: bool = True, **options) -> Ingested:
    """Canonical tables out of ``Games.csv``, ``PlayerStatistics.csv`` and ``Players.csv``.

    A team-season with any problem is refused as a whole; without ``refuse`` it keeps its good rows.
    """
    names = ["Games.csv", "PlayerStatistics.csv", "Players.csv"]
    frames = [read_text_columns(spark, f"{folder}/{name}") for name in names]
    snapshot = source_snapshot(spark, [f"{folder}/{name}" for name in names])
    ingested = normalize(*frames, dimension, source_path=folder, source_snapshot=snapshot, **options)
    return whole_scopes(ingested) if refuse else ingested


def source_snapshot(spark: SparkSession, paths: list[str], prefix: str = "kaggle-v1") -> str:
    """Name, size and time of every source file as one text; it changes when a file does."""
    parts = []
    for path in paths:
        # Listing the files does not read them.
        files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
        parts += files.select(
            F.concat_ws(
                ":",
                F.element_at(F.split("path", "/"), -1),
                F.col("length").cast("string"),
                F.unix_micros("modificationTime").cast("string"),
            ).alias("part")
        ).orderBy("part").collect()
    return f"{prefix}:" + "|".join(row["part"] for row in parts)


def ingest_summary(loads: DataFrame) -> DataFrame:
    """Stored games, players and skipped games per scope, with a total row (null scope)."""
    return loads.rollup(F.struct("season_type", "season", "team_id").alias("scope")).agg(
        F.count("*").alias("scopes"),
        F.sum("games_row_count").alias("games"),
        F.sum("game_players_row_count").alias("game_players"),
        F.sum("skipped_games_row_count").alias("skipped_games"),
    ).select("scope.*", "scopes", "games", "game_players", "skipped_games")


def column_profile(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """Columns of each file and the narrowest type that all its values have."""
    profile = None
    for name in names:
        table = spark.read.csv(f"{folder}/{name}", header=True, escape='"')
        kinds = []
        for position, column in enumerate(table.columns):
            value = text_or_null(F.col(f"`{column}`"))

            def all_are(kind: str, value: Column = value) -> Column:
                return F.coalesce(F.bool_and(value.try_cast(kind).isNotNull() | value.isNull()), F.lit(True))

            guess = (
                F.when(F.count(value) == 0, "empty")
                .when(all_are("bigint"), "bigint")
                .when(all_are("double"), "double")
                .when(all_are("timestamp"), "timestamp")
                .otherwise("string")
            )
            kinds.append(
                F.struct(
                    F.lit(position).alias("position"),
                    F.lit(column.removeprefix("﻿")).alias("column"),
                    guess.alias("type"),
                )
            )
        rows = table.agg(F.array(*kinds).alias("columns"), F.count("*").alias("rows")).select(
            F.lit(name).alias("file"), "rows", F.inline("columns")
        )
        profile = rows if profile is None else profile.unionByName(rows)
    return profile
