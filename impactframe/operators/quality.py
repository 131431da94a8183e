"""Data-quality checks. Each gives rows of (table, key, message).

Row checks report the first problem of a row. Scope and cache-key checks report
the first problem of the scope or key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactframe.functions.seasons import canonical_season_id, start_year, type_code
from impactframe.functions.text import is_blank, message_signature
from impactframe.operators.teams import current_labels
from impactframe.schemas import GAME, SCOPE, SIDE
from impactframe.session import keep

MIN_APPEARED = 5
MAX_ROWS = 25
MAX_MINUTES = 80.0
SCOPE_MINUTES = (220.0, 450.0)


def key_text(**parts: str) -> Column:
    """``name=value,...`` with text values in quotes."""
    return F.concat_ws(",", *[F.concat(F.lit(f"{name}="), _shown(F.col(column))) for name, column in parts.items()])


def _shown(value: Column) -> Column:
    text = value.cast("string")
    quoted = F.concat(F.lit("'"), text, F.lit("'"))
    return F.coalesce(F.when(F.typeof(value) == "string", quoted).otherwise(text), F.lit("None"))


def first_problem(*checks: tuple[Column, Column | str]) -> Column:
    """Message of the first check that fails; null if the row is fine."""
    return F.coalesce(
        *[F.when(bad, message if isinstance(message, Column) else F.lit(message)) for bad, message in checks],
        F.lit(None).cast("string"),
    )


def issue_rows(df: DataFrame, table: str, key: Column, message: Column) -> DataFrame:
    return df.select(F.lit(table).alias("table"), key.alias("key"), message.alias("message")).filter(
        F.col("message").isNotNull()
    )


def not_finite(value: Column) -> Column:
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))


# --- row checks -----------------------------------------------------------


def _with_years(df: DataFrame, dimension: DataFrame, column: str, name: str) -> DataFrame:
    years = current_labels(dimension).select(F.col("team_id").alias(column), F.col("active_years").alias(name))
    return df.join(years, column, "left")


def _team_checks(column: str, years: str) -> list[tuple[Column, Column | str]]:
    team, known = F.col(column), F.col(years)
    return [
        (team.isNull() | (team <= 0), F.format_string("invalid %s: %s", F.lit(column), F.coalesce(team.cast("string"), F.lit("None")))),
        (known.isNull(), F.format_string("unknown %s: %d", F.lit(column), team)),
    ]


def _season_checks() -> list[tuple[Column, Column | str]]:
    return [
        (start_year(F.col("season")).isNull(), F.concat(F.lit("invalid season "), _shown(F.col("season")))),
        (type_code(F.col("season_type")).isNull(), F.concat(F.lit("invalid season type "), _shown(F.col("season_type")))),
    ]


def _active(column: str, years: str) -> tuple[Column, Column]:
    year = start_year(F.col("season"))
    return (
        ~F.array_contains(F.col(years), year),
        F.format_string("team id %d was not active in season %d", F.col(column), year),
    )


def _game_checks() -> list[tuple[Column, Column | str]]:
    teams = [
        *_team_checks("team_id", "_years"),
        *_team_checks("opponent_team_id", "_opponent_years"),
        _active("team_id", "_years"),
        _active("opponent_team_id", "_opponent_years"),
    ]
    return [
        (F.col("is_home").isNull(), "is_home must be true or false"),
        *_season_checks(),
        *teams,
        (is_blank(F.col("game_id")), "game_id must not be empty"),
        (F.col("game_date").isNull(), "game_date must not be empty"),
        (is_blank(F.col("source")), "source must not be empty"),
        (not_finite(F.col("margin")), "margin must be finite"),
    ]


def game_plausibility() -> list[tuple[Column, Column | str]]:
    """Checks of a game row whose texts and numbers could be read."""
    year = start_year(F.col("season"))
    return [
        (F.col("team_id") == F.col("opponent_team_id"), "team and opponent must differ"),
        (
            ~F.year("game_date").between(year, year + 1),
            F.concat(F.lit("date '"), F.col("game_date").cast("string"), F.lit("' falls outside season "), _shown(F.col("season"))),
        ),
    ]


def check_games(games: DataFrame, dimension: DataFrame) -> DataFrame:
    """Games with their first ``problem`` (null if none), and whether they are ``readable`` at all.

    A readable row has a valid season, known and active teams, texts, a date and a
    margin; the checks across rows use only those.
    """
    known = _with_years(_with_years(games, dimension, "team_id", "_years"), dimension, "opponent_team_id", "_opponent_years")
    structure = first_problem(*_game_checks())
    return (
        known.withColumn("problem", F.coalesce(structure, first_problem(*game_plausibility())))
        .withColumn("readable", structure.isNull())
        .drop("_years", "_opponent_years")
    )


def check_players(
    players: DataFrame, dimension: DataFrame, *, max_minutes: float | None = MAX_MINUTES, require_minutes: bool = False
) -> DataFrame:
    """Player rows with their first ``problem``, and whether season, team and game are ``readable``."""
    minutes = F.col("minutes")
    structure = first_problem(
        *_season_checks(), *_team_checks("team_id", "_years"), (is_blank(F.col("game_id")), "game_id must not be empty")
    )
    checks = [
        (F.coalesce(F.col("player_id") <= 0, F.lit(True)), "player_id must be positive"),
        (is_blank(F.col("player_name")), "player_name must not be empty"),
        (minutes.isNotNull() & (not_finite(minutes) | (minutes < 0)), "minutes must be finite and not negative"),
    ]
    if require_minutes:
        checks.append((minutes.isNull(), "minutes must be present"))
    if max_minutes is not None:
        checks.append((minutes > max_minutes, F.format_string("implausible minutes %.1f", minutes)))
    checks.append(_active("team_id", "_years"))
    no_flag = F.when(F.col("appeared").isNull(), F.lit("appeared must be true or false"))
    return (
        _with_years(players, dimension, "team_id", "_years")
        .withColumn("problem", F.coalesce(no_flag, structure, first_problem(*checks)))
        .withColumn("readable", structure.isNull())
        .drop("_years")
    )


def game_issues(games: DataFrame, dimension: DataFrame) -> DataFrame:
    return _game_issues(check_games(games, dimension))


def _game_issues(checked: DataFrame) -> DataFrame:
    key = key_text(game_id="game_id", team_id="team_id", season="season", season_type="season_type")
    return issue_rows(checked, "games", key, F.col("problem"))


def player_issues(players: DataFrame, dimension: DataFrame, **limits) -> DataFrame:
    return _player_issues(check_players(players, dimension, **limits))


def _player_issues(checked: DataFrame) -> DataFrame:
    key = key_text(
        game_id="game_id", team_id="team_id", player_id="player_id", season="season", season_type="season_type"
    )
    return issue_rows(checked, "game_players", key, F.col("problem"))


def load_issues(loads: DataFrame, dimension: DataFrame) -> DataFrame:
    texts = ["source_path", "source_snapshot", "source_kind", "build_version"]
    counts = ["games_row_count", "game_players_row_count", "expected_games_row_count", "skipped_games_row_count"]
    checks = [
        *_season_checks(),
        *_team_checks("team_id", "_years"),
        _active("team_id", "_years"),
        *[(is_blank(F.col(c)), f"{c} must not be empty") for c in texts],
        (F.col("refreshed_at").isNull(), "refreshed_at must not be empty"),
        *[(F.col(c) < 0, f"{c} must be non-negative") for c in counts],
    ]
    known = _with_years(loads, dimension, "team_id", "_years")
    key = key_text(team_id="team_id", season="season", season_type="season_type")
    return issue_rows(known, "loads", key, first_problem(*checks))


def team_history_issues(history: DataFrame, dimension: DataFrame) -> DataFrame:
    """Stored team names against the dimension."""
    labels = dimension.select("team_id", F.col("start_year").alias("_year"), F.col("abbreviation").alias("_official"))
    current = current_labels(dimension).select("team_id", "current_abbreviation", F.col("active_years").alias("_years"))
    year = start_year(F.col("season"))
    joined = history.withColumn("_year", year).join(labels, ["team_id", "_year"], "left").join(current, "team_id", "left")
    checks = [
        (F.coalesce(F.col("team_id") <= 0, F.lit(True)), "team_id must be a positive integer"),
        *[(is_blank(F.col(c)), f"{c} must not be empty") for c in ("abbreviation", "franchise_id", "lookup_abbreviation")],
        (year.isNull(), F.concat(F.lit("invalid season "), _shown(F.col("season")))),
        *_team_checks("team_id", "_years")[1:],
        (F.col("_official").isNull(), F.format_string("team id %d was not active in season %d", "team_id", year)),
        (F.col("abbreviation") != F.col("_official"), "abbreviation does not match the team history"),
        (F.col("lookup_abbreviation") != F.col("current_abbreviation"), "lookup_abbreviation does not match the current name"),
        (F.col("franchise_id") != F.lower("current_abbreviation"), "franchise_id does not match the team history"),
    ]
    return issue_rows(joined, "team_history", key_text(team_id="team_id", season="season"), first_problem(*checks))


# --- relations ------------------------------------------------------------


def unmatched_players(games: DataFrame, players: DataFrame) -> DataFrame:
    """Player rows without a game row, or whose game row is in another season."""
    # A game and team has one scope; if it has several, the last by type and season counts.
    scopes = games.groupBy("game_id", "team_id").agg(
        F.max(F.struct(F.col("season_type").alias("t"), F.col("season").alias("s"))).alias("_scope")
    )
    message = first_problem(
        (F.col("_scope").isNull(), "player row has no matching game row"),
        (
            (F.col("_scope.s") != F.col("season")) | (F.col("_scope.t") != F.col("season_type")),
            "player row season or season_type does not match its game row",
        ),
    )
    joined = players.join(scopes, ["game_id", "team_id"], "left")
    return issue_rows(joined, "game_players", key_text(game_id="game_id", team_id="team_id", player_id="player_id"), message)


def reciprocal_issues(games: DataFrame) -> DataFrame:
    """The two rows of a game must mirror each other."""

    def both(column: str) -> list[Column]:
        return [
            F.min_by(column, "team_id").alias(f"{column}_1"),
            F.max_by(column, "team_id").alias(f"{column}_2"),
        ]

    pairs = (
        games.groupBy(*GAME)
        .agg(
            F.count("*").alias("rows"),
            F.min("team_id").alias("team_1"),
            F.max("team_id").alias("team_2"),
            *[c for name in ("opponent_team_id", "is_home", "game_date", "margin") for c in both(name)],
        )
        .filter("rows = 2")
    )
    opponents = "paired game rows must reference each other as opponents"
    margins = F.concat(
        F.lit("paired game rows must have opposite margins: "),
        F.concat_ws("=", F.col("team_1").cast("string"), F.col("margin_1").cast("string")),
        F.lit(" "),
        F.concat_ws("=", F.col("team_2").cast("string"), F.col("margin_2").cast("string")),
    )
    messages = F.array_compact(
        F.array(
            F.when(F.col("team_1") != F.col("opponent_team_id_2"), F.lit(opponents)),
            F.when(F.col("team_2") != F.col("opponent_team_id_1"), F.lit(opponents)),
            F.when(F.col("is_home_1") == F.col("is_home_2"), F.lit("paired game rows must have opposite home/away flags")),
            F.when(F.col("game_date_1") != F.col("game_date_2"), F.lit("paired game rows must have the same game date")),
            F.when(F.col("margin_1") != -F.col("margin_2"), margins),
        )
    )
    key = key_text(game_id="game_id", season="season", season_type="season_type")
    return pairs.select(F.lit("games").alias("table"), key.alias("key"), F.explode(messages).alias("message"))


def side_counts(games: DataFrame, players: DataFrame) -> DataFrame:
    """Team-games from either table with their game rows, player rows, appearances and appeared minutes."""
    # Counting both tables in one aggregation replaces a full outer join.
    game_rows = games.select(*SIDE, F.lit(1).alias("_game"), F.lit(False).alias("appeared"), F.lit(0.0).alias("minutes"))
    player_rows = players.select(*SIDE, F.lit(0).alias("_game"), "appeared", F.coalesce("minutes", F.lit(0.0)).alias("minutes"))
    return (
        game_rows.unionByName(player_rows)
        .groupBy(*SIDE)
        .agg(
            F.sum("_game").alias("game_rows"),
            F.count_if(F.col("_game") == 0).alias("player_rows"),
            F.count_if("appeared").alias("appeared_rows"),
            F.sum(F.when(F.col("appeared"), F.col("minutes")).otherwise(0.0)).alias("appeared_minutes"),
        )
    )


def scope_findings(
    games: DataFrame, players: DataFrame, *, total_minutes: tuple[float, float] | None = SCOPE_MINUTES
) -> DataFrame:
    """Every problem of a team-game as a batch: scope columns, game_id, step, message."""
    total = F.col("appeared_minutes")
    checks = [
        (F.col("game_rows") > 1, 2, F.lit("duplicate game row")),
        (F.col("player_rows") == 0, 5, F.lit("game row without player rows")),
        (F.col("game_rows") == 0, 5, F.lit("player rows without a game row")),
        (F.col("appeared_rows") < MIN_APPEARED, 6, F.format_string("expected at least 5 appeared players, found %d", "appeared_rows")),
        (F.col("player_rows") > MAX_ROWS, 7, F.format_string("expected at most 25 player rows, found %d", "player_rows")),
    ]
    if total_minutes is not None:
        low, high = total_minutes
        checks.append(((total < low) | (total > high), 8, F.format_string("implausible total minutes %.1f", total)))
    found = F.array_compact(
        F.array(*[F.when(bad, F.struct(F.lit(step).alias("step"), text.alias("message"))) for bad, step, text in checks])
    )
    sides = side_counts(games, players).select(*SCOPE, "game_id", F.inline(found))
    duplicates = (
        players.groupBy(*SIDE, "player_id")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select(*SCOPE, "game_id", F.lit(4).alias("step"), F.format_string("duplicate player row %d", "player_id").alias("message"))
    )
    return sides.unionByName(duplicates)


def row_findings(checked: DataFrame, step: int) -> DataFrame:
    """Problems of checked rows in the shape of scope findings."""
    return checked.filter(F.col("problem").isNotNull()).select(
        *SCOPE, "game_id", F.lit(step).alias("step"), F.col("problem").alias("message")
    )


def scope_issues(findings: DataFrame) -> DataFrame:
    """The first problem of every scope."""
    first = (
        findings
        .groupBy(*SCOPE)
        .agg(F.min(F.struct("step", "game_id", "message")).alias("first"))
    )
    key = key_text(team_id="team_id", season="season", season_type="season_type")
    message = F.concat(F.lit("game "), _shown(F.col("first.game_id")), F.lit(": "), F.col("first.message"))
    return issue_rows(first, "scopes", key, message)


def count_issues(games: DataFrame, players: DataFrame, loads: DataFrame) -> DataFrame:
    """Declared row counts against the tables, and scopes that have rows but no load row."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*SCOPE).agg(F.count("*").alias(name))

    actual = counted(games, "games").join(counted(players, "players"), SCOPE, "full")
    joined = loads.withColumn("_loaded", F.lit(True)).join(actual, SCOPE, "full")
    key = key_text(team_id="team_id", season="season", season_type="season_type")

    def mismatch(declared: str, actual_name: str, table: str) -> Column:
        real = F.coalesce(F.col(actual_name), F.lit(0))
        text = F.concat(
            F.lit(f"{declared} does not match {table} count: "),
            F.coalesce(F.col(declared).cast("string"), F.lit("None")),
            F.lit(" != "),
            real.cast("string"),
        )
        return F.when(F.col("_loaded") & ~F.col(declared).eqNullSafe(real), text)

    messages = F.array_compact(
        F.array(
            mismatch("games_row_count", "games", "games"),
            mismatch("game_players_row_count", "players", "game_players"),
            F.when(F.col("_loaded").isNull(), F.lit("missing load row for a stored scope")),
        )
    )
    return joined.select(F.lit("loads").alias("table"), key.alias("key"), F.explode(messages).alias("message"))


def key_differences(games: DataFrame, players: DataFrame) -> DataFrame:
    """Team-games present in one table only, and in which."""
    return side_counts(games, players).filter("game_rows = 0 or player_rows = 0").select(
        *SIDE, F.when(F.col("game_rows") == 0, F.lit("players")).otherwise(F.lit("games")).alias("only_in")
    )


# --- stored metrics -------------------------------------------------------


def metric_row_issues(rows: DataFrame, entries: DataFrame, metric_id: str, numbers: list[str], counts: list[str]) -> DataFrame:
    """First problem of every stored key: season in the key, id, name, minutes, finite values, uniqueness."""
    keys = entries.filter(F.col("metric_id") == metric_id).select("metric_cache_key", season_ids_of_key().alias("_seasons"))
    joined = rows.join(keys, "metric_cache_key", "left")
    canonical = canonical_season_id(F.col("season_id"))
    average, total = F.col("average_minutes"), F.col("total_minutes")
    player = F.concat(F.lit("player "), F.coalesce(F.col("player_id").cast("string"), F.lit("None")), F.lit(": "))
    checks = [
        (F.col("_seasons").isNull(), F.lit("rows have no parseable cache key")),
        (~canonical.eqNullSafe(F.col("season_id")), F.lit("season_id is not canonical")),
        (~F.array_contains(F.col("_seasons"), F.col("season_id")), F.lit("season_id is outside the cached seasons")),
        (F.coalesce(F.col("player_id") <= 0, F.lit(True)), F.lit("player_id must be positive")),
        (is_blank(F.col("player_name")), F.lit("player_name must not be empty")),
        (average < 0, F.lit("average_minutes must be non-negative")),
        (total < 0, F.lit("total_minutes must be non-negative")),
        (total + 1e-9 < average, F.lit("total_minutes is smaller than average_minutes")),
        *[(not_finite(F.col(c)), F.lit(f"{c} must be finite")) for c in numbers],
        *[(F.col(c) < 0, F.lit(f"{c} must be non-negative")) for c in counts],
    ]
    if "raw_wowy_score" in rows.columns:
        raw = F.col("raw_wowy_score")
        checks.append((raw.isNotNull() & not_finite(raw), F.lit("raw_wowy_score must be finite")))
    problem = first_problem(*checks)
    found = joined.select(
        "metric_cache_key", "season_id", "player_id", F.concat(player, problem).alias("message")
    ).filter(F.col("message").isNotNull())
    repeated = (
        rows.groupBy("metric_cache_key", "season_id", "player_id")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select("metric_cache_key", "season_id", "player_id", F.concat(player, F.lit("duplicate row")).alias("message"))
    )
    first = (
        found.unionByName(repeated)
        .groupBy("metric_cache_key")
        .agg(F.min(F.struct("season_id", "player_id", "message"))["message"].alias("message"))
        .withColumn("metric", F.lit(metric_id))
    )
    table = "ridge_values" if metric_id == "ridge" else "wowy_values"
    return issue_rows(first, table, key_text(metric="metric", metric_cache_key="metric_cache_key"), F.col("message"))


def season_ids_of_key() -> Column:
    """The seasons written in ``metric_cache_key``; null if the key has none."""
    listed = F.regexp_extract("metric_cache_key", r"(?:^|\|)season_ids=([^|]*)", 1)
    return F.when(listed != "", F.filter(F.split(listed, ","), lambda s: s != ""))


def store_relation_issues(rows: DataFrame, entries: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Stored rows against their cache entries.

    ``rows`` needs metric_id, metric_cache_key and season_id; ``fingerprints`` has the
    current source fingerprint per metric_id and metric_cache_key.
    """
    keys = ["metric_id", "metric_cache_key"]
    stored = rows.groupBy(*keys).agg(
        F.count("*").alias("_rows"),
        # As many as there are seasons.
        F.array_sort(F.collect_set("season_id")).alias("_seasons"),
    )
    joined = (
        entries.withColumn("_entry", F.lit(True))
        .join(stored, keys, "full")
        .join(fingerprints.select(*keys, F.col("source_fingerprint").alias("_current")), keys, "left")
        .withColumn("_key_seasons", season_ids_of_key())
    )
    count = F.format_string("row_count does not match the stored rows: %d != %d", "row_count", "_rows")
    has_entry, has_rows = F.col("_entry").isNotNull(), F.col("_rows").isNotNull()
    messages = F.array_compact(
        F.array(
            F.when(~has_entry, F.lit("missing cache entry row for stored rows")),
            F.when(has_entry & has_rows & (F.col("row_count") != F.col("_rows")), count),
            F.when(F.col("_key_seasons").isNull(), F.lit("cache key is not parseable")),
            F.when(
                has_rows & (F.size(F.array_except("_seasons", "_key_seasons")) > 0),
                F.lit("cache key lacks seasons that stored rows have"),
            ),
            F.when(
                has_entry & (F.col("source_fingerprint") != F.col("_current")),
                F.lit("source_fingerprint does not match the current source tables"),
            ),
            F.when(has_entry & ~has_rows, F.lit("cache entry row has no stored rows")),
        )
    )
    key = key_text(metric="metric_id", metric_cache_key="metric_cache_key")
    return joined.select(F.lit("cache_entries").alias("table"), key.alias("key"), F.explode(messages).alias("message"))


def request_issues(members: DataFrame, context: DataFrame) -> DataFrame:
    """Players used in games or observations that have no context row."""
    missing = members.select("season_id", "player_id").distinct().join(context, ["season_id", "player_id"], "left_anti")
    key = key_text(season_id="season_id", player_id="player_id")
    return issue_rows(missing, "request", key, F.lit("unknown player"))


def write_issues(games: DataFrame, players: DataFrame, loads: DataFrame) -> DataFrame:
    """What keeps rows from being written as the team-seasons of ``loads``."""
    loaded = loads.select(*SCOPE)
    outside = games.join(loaded, SCOPE, "left_anti")
    orphans = players.join(games.select(*SIDE), SIDE, "left_anti")
    key = key_text(game_id="game_id", team_id="team_id")
    player_key = key_text(game_id="game_id", team_id="team_id", player_id="player_id")
    return issue_rows(outside, "games", key, F.lit("row is outside the written team-seasons")).unionByName(
        issue_rows(orphans, "game_players", player_key, F.lit("player row refers to a game that is not written"))
    )


# --- summary --------------------------------------------------------------


def audit(
    games: DataFrame, players: DataFrame, loads: DataFrame, dimension: DataFrame
) -> DataFrame:
    """All checks of the game tables."""
    # Every check below reads one of these two.
    checked_games = keep(check_games(games, dimension))
    checked_players = keep(check_players(players, dimension))
    readable_games = checked_games.filter("readable")
    readable_players = checked_players.filter("readable")
    findings = (
        scope_findings(readable_games, readable_players)
        .unionByName(row_findings(readable_games, 1))
        .unionByName(row_findings(readable_players, 3))
    )
    parts = [
        _game_issues(checked_games),
        _player_issues(checked_players),
        load_issues(loads, dimension),
        unmatched_players(readable_games, readable_players),
        reciprocal_issues(readable_games),
        scope_issues(findings),
        count_issues(readable_games, readable_players, loads),
    ]
    issues = parts[0]
    for part in parts[1:]:
        issues = issues.unionByName(part)
    return issues


def issues_by_table(issues: DataFrame) -> DataFrame:
    return issues.groupBy("table").agg(F.count("*").alias("issues"))


def issue_trends(issues: DataFrame) -> DataFrame:
    """Issues counted by table and message kind, with the first example of each."""
    return (
        issues.withColumn("signature", message_signature(F.col("message")))
        .groupBy("table", "signature")
        .agg(F.count("*").alias("count"), F.min(F.struct("key", "message")).alias("_example"))
        .select(
            "table",
            "signature",
            "count",
            F.col("_example.key").alias("example_key"),
            F.col("_example.message").alias("example_message"),
        )
    )


def top_trends(issues: DataFrame, top_n: int = 10) -> DataFrame:
    return issue_trends(issues).orderBy(F.desc("count"), "table", "signature").limit(top_n)


def require_clean(issues: DataFrame, preview: int = 5) -> None:
    """Raise if there is any issue, showing the first few."""
    total = issues.count()
    if total == 0:
        return
    shown = issues.orderBy("table", "key", "message").limit(preview).collect()
    text = "; ".join(f"{row['table']}[{row['key']}]: {row['message']}" for row in shown)
    more = f"; ... {total - len(shown)} more" if total > len(shown) else ""
    raise ValueError(f"validation failed with {total} issue(s): {text}{more}")


def enforced(df: DataFrame, issues: DataFrame, preview: int = 5) -> DataFrame:
    """The frame itself, but reading it raises if there is any issue, with counts and the first kinds of issue.

    The check is a scalar subquery of the same plan: it is evaluated once, before any row is returned and also if there
    are none. Issues are first counted by kind, so that their number does not matter. The error comes from the
    subquery as a ``Py4JJavaError``; ``raised_text`` gives its message.
    """
    kinds = issue_trends(issues).agg(
        F.sum("count").alias("total"), F.array_sort(F.collect_list(F.struct("table", "example_key", "example_message", "count"))).alias("kinds")
    )
    shown = F.transform(
        F.slice("kinds", 1, preview),
        lambda k: F.concat(k["table"], F.lit("["), k["example_key"], F.lit("]: "), k["example_message"], F.lit(" x"), k["count"].cast("string")),
    )
    text = F.concat(
        F.format_string("validation failed with %d issue(s): ", "total"),
        F.array_join(shown, "; "),
        F.when(F.size("kinds") > preview, F.format_string("; %d more kinds", F.size("kinds") - preview)).otherwise(""),
    )
    verdict = kinds.select(F.when(F.col("total") > 0, F.raise_error(text).cast("boolean")).otherwise(True))
    return df.filter(verdict.scalar())


def raised_text(error: Exception) -> str:
    """What went wrong, without the stack: the message of the innermost cause."""
    cause, text = getattr(error, "java_exception", None), str(error)
    while cause is not None:
        cause, text = cause.getCause(), cause.getMessage() or text
    return text


def summary_text(issues: DataFrame, top_n: int = 10) -> str:
    """Short report of the issue counts and the most frequent kinds."""
    tables = issues_by_table(issues).orderBy(F.desc("issues"), "table").collect()
    total = sum(row["issues"] for row in tables)
    lines = [f"Validation status: {'ok' if total == 0 else 'invalid'}", f"Total issues: {total}"]
    if total:
        trends = top_trends(issues, top_n).collect()
        lines += ["", "Issues by table:"] + [f"- {row['table']}: {row['issues']}" for row in tables]
        lines += ["", f"Top {len(trends)} kinds:"]
        for place, row in enumerate(trends, start=1):
            lines += [
                f"{place}. {row['table']} x{row['count']}: {row['signature']}",
                f"   for example {row['example_key']}: {row['example_message']}",
            ]
    return "\n".join(lines)
