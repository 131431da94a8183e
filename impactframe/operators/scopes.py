"""Which team-seasons are loaded, complete and requested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactframe.functions.seasons import (
    FIRST_SEASON_YEAR,
    season_id,
    season_text,
    start_year,
    type_code,
    type_order,
    type_text,
)
from impactframe.schemas import GAME, SCOPE, SEASON


def scan(
    df: DataFrame,
    *,
    scopes: DataFrame | None = None,
    teams: list[int] | None = None,
    seasons: list[str] | None = None,
    season_types: list[str] | None = None,
    games: DataFrame | None = None,
) -> DataFrame:
    """Filter any scoped table. Lists become pushed-down predicates, frames become semi joins."""
    if teams:
        df = df.filter(F.col("team_id").isin(teams))
    if seasons:
        df = df.filter(F.col("season").isin(seasons))
    if season_types:
        df = df.filter(F.col("season_type").isin(season_types))
    if scopes is not None:
        df = df.join(scopes.select(*SCOPE).distinct(), SCOPE, "left_semi")
    if games is not None:
        df = df.join(games.select("game_id").distinct(), "game_id", "left_semi")
    return df


def game_ids(games: DataFrame, scopes: DataFrame) -> DataFrame:
    return scan(games, scopes=scopes).select("game_id").distinct()


def whole_games(games: DataFrame, players: DataFrame, scopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of every game that a requested scope played."""
    wanted = scan(games, scopes=scopes).select(*GAME).distinct()
    return games.join(wanted, GAME, "left_semi"), players.join(wanted, GAME, "left_semi")


def own_sides(games: DataFrame, players: DataFrame, scopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Only the requested scopes' own rows."""
    return scan(games, scopes=scopes), scan(players, scopes=scopes)


def available(loads: DataFrame) -> DataFrame:
    return loads.filter((F.col("games_row_count") > 0) & (F.col("game_players_row_count") > 0))


def requested(loads: DataFrame, dimension: DataFrame, teams: list[int] | None, season_ids: list[str]) -> DataFrame:
    """Available scopes of the requested teams in the requested seasons they were active in."""
    wanted = season_id(F.col("season"), F.col("season_type")).isin(season_ids)
    rows = scan(available(loads), teams=teams).filter(wanted).withColumn("_year", start_year(F.col("season")))
    active = dimension.select("team_id", F.col("start_year").alias("_year"))
    return rows.join(active, ["team_id", "_year"], "left_semi").select(*SCOPE)


def resolve(loads: DataFrame, teams: list[int] | None, seasons: list[tuple[str, str]]) -> DataFrame:
    """All cached scopes of the seasons, or every requested team and season with ``is_cached``."""
    listed = F.array(*[F.struct(F.lit(s).alias("season"), F.lit(t).alias("season_type")) for s, t in seasons])
    spark = loads.sparkSession
    cached = available(loads).select(*SCOPE)
    if teams is None:
        wanted = spark.range(1).select(F.inline(listed))
        return cached.join(wanted, SEASON, "left_semi").withColumn("is_cached", F.lit(True))
    ids = F.array(*[F.lit(t).cast("bigint") for t in sorted(set(teams))])
    wanted = spark.range(1).select(F.explode(ids).alias("team_id")).select("team_id", F.inline(listed))
    found = cached.withColumn("_found", F.lit(True))
    return wanted.join(found, SCOPE, "left").select(*SCOPE, F.col("_found").isNotNull().alias("is_cached"))


def missing_scopes(scopes: DataFrame, loads: DataFrame) -> DataFrame:
    """Requested scopes that cannot be read because they are not loaded."""
    return scopes.join(available(loads).select(*SCOPE), SCOPE, "left_anti")


def _expected(loads: DataFrame, dimension: DataFrame) -> DataFrame:
    """Teams that a loaded season should have; playoffs expect nobody in particular."""
    seasons = loads.select(*SEASON).distinct().filter(type_code(F.col("season_type")) != "PLAYOFFS")
    return (
        seasons.withColumn("start_year", start_year(F.col("season")))
        .join(dimension.select("team_id", "start_year", "abbreviation"), "start_year")
        .select(*SCOPE, "abbreviation")
    )


def _labelled(loads: DataFrame, dimension: DataFrame) -> DataFrame:
    labels = dimension.select("team_id", F.col("start_year").alias("_year"), "abbreviation")
    return loads.withColumn("_year", start_year(F.col("season"))).join(labels, ["team_id", "_year"], "left").drop("_year")


def completeness(loads: DataFrame, dimension: DataFrame) -> DataFrame:
    """Per season: teams missing, unexpected, without counts, short of games or with skipped games."""
    counts_known = F.col("expected_games_row_count").isNotNull() & F.col("skipped_games_row_count").isNotNull()
    facts = loads.join(_expected(loads, dimension).withColumn("_expected", F.lit(True)), SCOPE, "full")
    loaded = F.col("games_row_count").isNotNull()
    needs_all = type_code(F.col("season_type")) != "PLAYOFFS"
    per_season = facts.groupBy(*SEASON).agg(
        F.count_if(~loaded).alias("missing_teams"),
        F.count_if(loaded & needs_all & F.col("_expected").isNull()).alias("unexpected_teams"),
        F.count_if(loaded & ~counts_known).alias("teams_without_counts"),
        F.count_if(counts_known & (F.col("games_row_count") != F.col("expected_games_row_count"))).alias("partial_teams"),
        F.count_if(counts_known & (F.col("skipped_games_row_count") != 0)).alias("teams_with_skips"),
    )
    problems = ["missing_teams", "unexpected_teams", "teams_without_counts", "partial_teams", "teams_with_skips"]
    clean = F.lit(True)
    for name in problems:
        clean = clean & (F.col(name) == 0)
    return per_season.withColumn("is_complete", clean)


def complete_only(scopes: DataFrame, loads: DataFrame, dimension: DataFrame) -> DataFrame:
    """Scopes of complete seasons. Incomplete seasons drop out without an error."""
    complete = completeness(loads, dimension).filter("is_complete").select(*SEASON)
    return scopes.join(complete, SEASON, "left_semi")


def completeness_warnings(loads: DataFrame, dimension: DataFrame, season_ids: list[str] | None = None) -> DataFrame:
    """One row per reason why a season is not complete: season_id, message."""
    identity = season_id(F.col("season"), F.col("season_type"))
    rows = _labelled(loads, dimension)
    label = F.coalesce("abbreviation", F.col("team_id").cast("string"))
    known = F.col("expected_games_row_count").isNotNull() & F.col("skipped_games_row_count").isNotNull()
    partial = known & (F.col("games_row_count") != F.col("expected_games_row_count"))
    messages = F.array_compact(
        F.array(
            F.when(~known, F.concat(F.lit("incomplete load metadata for "), label)),
            F.when(
                partial,
                F.format_string("partial team-season for %s (%d/%d games)", label, "games_row_count", "expected_games_row_count"),
            ),
            F.when(
                known & (F.col("skipped_games_row_count") != 0),
                F.format_string("skipped games present for %s (%d skipped)", label, "skipped_games_row_count"),
            ),
        )
    )
    per_team = rows.select(identity.alias("season_id"), F.explode(messages).alias("message"))
    absent = _expected(loads, dimension).join(loads.select(*SCOPE), SCOPE, "left_anti")
    # As many names as the league has teams.
    missing = absent.groupBy(identity.alias("season_id")).agg(
        F.concat(
            F.lit("missing team-seasons: "), F.array_join(F.array_sort(F.collect_set("abbreviation")), ", ")
        ).alias("message")
    )
    warnings = per_team.unionByName(missing)
    if season_ids is None:
        return warnings
    wanted = loads.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in season_ids])).alias("season_id"))
    loaded = loads.select(identity.alias("season_id")).distinct()
    unknown = wanted.join(loaded, "season_id", "left_anti").withColumn("message", F.lit("no load metadata found"))
    return warnings.join(wanted, "season_id", "left_semi").unionByName(unknown)


def source_fingerprint(loads: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Digest of load rows; it changes when any of them changes.

    The rows' digests are combined by exclusive-or, in any order and by partial
    aggregation, so no list of all rows is ever built.
    """
    fields = [
        "team_id",
        "season",
        "season_type",
        "source_path",
        "source_snapshot",
        "source_kind",
        "build_version",
        "games_row_count",
        "game_players_row_count",
        "expected_games_row_count",
        "skipped_games_row_count",
    ]
    text = F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("None")) for f in fields])
    digest = F.sha2(text, 256)

    def piece(n: int) -> Column:
        return F.bit_xor(F.conv(F.substring("_digest", 15 * n + 1, 15), 16, 10).cast("bigint")).cast("string")

    combined = F.concat_ws(":", F.count("*").cast("string"), *[piece(n) for n in range(4)])
    rows = loads.select(*(by or []), digest.alias("_digest"))
    return rows.groupBy(*(by or [])).agg(F.sha2(combined, 256).alias("source_fingerprint"))


# --- season lists ---------------------------------------------------------


def normalized_seasons(seasons: DataFrame) -> DataFrame:
    """Unique seasons in order of year and type; ``season_type`` may be any spelling."""
    code = type_code(F.col("season_type"))
    year = start_year(F.col("season"))
    return (
        seasons.select(year.alias("start_year"), code.alias("code"))
        .distinct()
        .select(
            season_text(F.col("start_year")).alias("season"),
            type_text(F.col("code")).alias("season_type"),
            F.concat_ws(":", season_text(F.col("start_year")), "code").alias("season_id"),
            "start_year",
            type_order(F.col("code")).alias("type_order"),
        )
        .orderBy("start_year", "type_order")
    )


def season_range(spark, first_year: int, last_year: int, types: list[str]) -> DataFrame:
    """Every season of the given type codes from the last year down to the first."""
    if last_year < first_year:
        raise ValueError("the last year must not be before the first")
    year = F.col("id").cast("int").alias("start_year")
    return (
        spark.range(first_year, last_year + 1)
        .select(year, F.explode(F.array(*[F.lit(t) for t in types])).alias("code"))
        .select(
            season_text(F.col("start_year")).alias("season"),
            type_text(F.col("code")).alias("season_type"),
            F.concat_ws(":", season_text(F.col("start_year")), "code").alias("season_id"),
            "start_year",
        )
        .orderBy(F.desc("start_year"))
    )


def all_history(spark, end_year: int, types: list[str] | None = None) -> DataFrame:
    return season_range(spark, FIRST_SEASON_YEAR, end_year, types or ["REGULAR", "PLAYOFFS"])


def selected_season_ids(seasons: DataFrame, first: str, last: str, types: list[str] | None = None) -> DataFrame:
    """Season ids of the available seasons between two chosen ones (in either order), for each type."""
    low, high = min(first, last), max(first, last)
    # Without both ends on offer the selection is empty.
    ends = seasons.select("season").distinct().filter(F.col("season").isin(low, high))
    offered = ends.agg(F.count("*").alias("n")).scalar()
    codes = F.array(*[F.lit(t) for t in (types or ["REGULAR", "PLAYOFFS"])])
    return (
        seasons.select("season")
        .distinct()
        .filter(F.col("season").between(low, high) & (offered == len({low, high})))
        .select(F.explode(F.transform(codes, lambda c: F.concat_ws(":", "season", c))).alias("season_id"))
    )


def combined_scopes(loads: DataFrame) -> DataFrame:
    """Regular and playoff scopes of the years that have both."""
    code = type_code(F.col("season_type"))
    scopes = loads.select(*SCOPE, start_year(F.col("season")).alias("start_year"), code.alias("code"))
    regular = scopes.filter("code = 'REGULAR'").select("start_year")
    playoffs = scopes.filter("code = 'PLAYOFFS'").select("start_year")
    both = regular.intersect(playoffs)
    return scopes.filter(F.col("code").isin("REGULAR", "PLAYOFFS")).join(both, "start_year", "left_semi").select(*SCOPE)
