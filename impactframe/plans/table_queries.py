"""Registered queries: scopes, teams, seasons, usage and ingest from text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactframe.functions.keys import is_canonical_key
from impactframe.functions.seasons import season_id, season_text, start_year, start_year_of_date, type_code, type_slug
from impactframe.functions.text import canonical_team_filter, number, played_minutes, two_decimals
from impactframe.operators import coverage, scopes, teams, usage
from impactframe.plans.margin_queries import rounded, tables
from impactframe.plans.quality_queries import DIMENSION, LOADS, dimension, nation_spans, short_name
from impactframe.plans.reference_sql import over
from impactframe.sources import csv_files
from impactframe.sources.sample_tables import games_with_players, loads_view, read_table


def _loads(spark, folder) -> DataFrame:
    return loads_view(*tables(spark, folder))


# --- teams ----------------------------------------------------------------


def team_season_dim(spark, folder):
    return dimension(spark, folder)


def team_labels(spark, folder):
    labels = teams.current_labels(dimension(spark, folder))
    years = F.transform("active_years", lambda y: y.cast("string"))
    return labels.withColumn("active_years", F.array_join(years, ","))


def abbreviation_on_date(spark, folder):
    """Every order's nation abbreviation, resolved on the order's date."""
    nation = read_table(spark, folder, "nation").select("n_nationkey", short_name("N").alias("abbreviation"))
    customer = read_table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    orders = (
        read_table(spark, folder, "orders")
        .select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "day", "abbreviation")
    )
    found = teams.resolve_abbreviations(orders, nation_spans(spark, folder), day=F.col("day"))
    return found.select("o_orderkey", "abbreviation", "resolved_team_id")


def abbreviation_alias(spark, folder):
    spans = nation_spans(spark, folder)
    return teams.resolve_aliases(spans.select("abbreviation").distinct(), spans)


def active_teams(spark, folder):
    loads = _loads(spark, folder).select("team_id", "season")
    return teams.label_in_season(teams.active_in_season(loads, dimension(spark, folder)), dimension(spark, folder))


def _options(spark, folder):
    loads = _loads(spark, folder)
    return teams.selectable_options(loads.filter("team_id % 2 = 0"), loads.select("season"), dimension(spark, folder))


def options_by_team(spark, folder):
    return _options(spark, folder)[0].withColumn("available_seasons", F.array_join("available_seasons", ","))


def options_by_season(spark, folder):
    return _options(spark, folder)[1].withColumn("available_teams", F.array_join("available_teams", ","))


def team_filter(spark, folder):
    return teams.team_filter_text(_loads(spark, folder))


# --- seasons --------------------------------------------------------------


def season_of_date(spark, folder):
    day = F.col("o_orderdate").cast("date")
    return read_table(spark, folder, "orders").select("o_orderkey", season_text(start_year_of_date(day)).alias("season"))


def season_texts(spark, folder):
    """Season and type texts of many spellings, two in five of them invalid, made from the event ids."""
    year = (F.lit(1940) + F.col("event_id") % 90).cast("int")
    suffix = F.lpad(F.pmod(year + 1, F.lit(100)).cast("string"), 2, "0")
    text = (
        F.when(F.col("event_id") % 5 == 0, year.cast("string"))
        .when(F.col("event_id") % 5 == 1, F.concat_ws("-", year.cast("string"), F.lit("00")))
        .when(F.col("event_id") % 5 == 2, F.concat(F.lit("s"), year.cast("string")))
        .otherwise(F.concat_ws("-", year.cast("string"), suffix))
    )
    spellings = F.array(*[F.lit(s) for s in ("Regular", "playoffs", " PRE ", "post season", "cup")])
    kind = F.element_at(spellings, (F.col("event_id") % 5 + 1).cast("int"))
    rows = read_table(spark, folder, "events").select("event_id", text.alias("season"), kind.alias("season_type"))
    return rows.select(
        "event_id",
        start_year(F.col("season")).alias("start_year"),
        season_id(F.col("season"), F.col("season_type")).alias("season_id"),
        type_slug(type_code(F.col("season_type"))).alias("slug"),
    )


def season_selection(spark, folder):
    return scopes.selected_season_ids(_loads(spark, folder), "1999-00", "1996-97")


def season_order(spark, folder):
    return scopes.normalized_seasons(_loads(spark, folder)).withColumn("start_year", F.col("start_year").cast("bigint"))


# --- scopes ---------------------------------------------------------------


def requested_scopes(spark, folder):
    ids = [f"{y}-{(y + 1) % 100:02d}:REGULAR" for y in (1994, 1996, 1999)]
    return scopes.requested(_loads(spark, folder), dimension(spark, folder), list(range(1, 16)), ids)


def resolved_scopes(spark, folder):
    seasons = [("1996-97", "Regular Season"), ("1996-97", "Playoffs")]
    return scopes.resolve(_loads(spark, folder), [2, 4, 99], seasons)


def _wanted(spark, folder):
    return _loads(spark, folder).filter("team_id in (3, 8) and season in ('1996-97', '1998-99')")


def whole_games(spark, folder):
    games, players = tables(spark, folder)
    kept, kept_players = scopes.whole_games(games, players, _wanted(spark, folder))
    counts = kept_players.groupBy("game_id", "team_id").agg(F.count("*").alias("players"))
    return kept.select("game_id", "season", "team_id", "is_home", "margin").join(counts, ["game_id", "team_id"], "left")


def own_sides(spark, folder):
    games, players = tables(spark, folder)
    kept, kept_players = scopes.own_sides(games, players, _wanted(spark, folder))
    counts = kept_players.groupBy("game_id", "team_id").agg(F.count("*").alias("players"))
    return kept.select("game_id", "season", "team_id", "is_home", "margin").join(counts, ["game_id", "team_id"], "left")


def missing_scopes(spark, folder):
    loads = _loads(spark, folder)
    return scopes.missing_scopes(loads.select(*scopes.SCOPE), loads.filter("team_id % 4 <> 0"))


def combined_scopes(spark, folder):
    # Teams above 12 stand for playoffs; two seasons have none.
    late = (F.col("team_id") > 12) & ~F.col("season").isin("1995-96", "1997-98")
    loads = _loads(spark, folder).filter((F.col("team_id") <= 12) | late)
    kind = F.when(F.col("team_id") > 12, F.lit("Playoffs")).otherwise(F.col("season_type"))
    return scopes.combined_scopes(loads.withColumn("season_type", kind))


def season_completeness(spark, folder):
    return scopes.completeness(_loads(spark, folder), dimension(spark, folder))


def completeness_warnings(spark, folder):
    return scopes.completeness_warnings(_loads(spark, folder), dimension(spark, folder))


def source_fingerprint(spark, folder):
    return scopes.source_fingerprint(_loads(spark, folder), ["season"])


# --- usage ----------------------------------------------------------------


def usage_log(spark, folder):
    metric = F.when(F.col("user_id") % 2 == 0, "wowy").otherwise("ridge")
    key = F.concat_ws("-", "event_type", (F.col("user_id") % 7).cast("string"))
    return read_table(spark, folder, "events").select(
        metric.alias("metric_id"), key.alias("metric_cache_key"), F.col("ts").cast("timestamp").alias("requested_at")
    )


def usage_counts(spark, folder):
    counts = usage.usage_counts(usage_log(spark, folder))
    return counts.withColumn("last_requested_at", F.date_format("last_requested_at", "yyyy-MM-dd HH:mm:ss"))


def retained_keys(spark, folder):
    counts = usage.usage_counts(usage_log(spark, folder))
    used = counts.filter("metric_id = 'wowy'")
    pinned = counts.filter("metric_id = 'ridge' and metric_cache_key like '%-3'")
    return usage.retained_keys(pinned, used).select("metric_cache_key", "tier", "query_count")


def refreshable_keys(spark, folder):
    """Keys for pairs of teams and one season each; some unordered, some for seasons that are not loaded."""
    loads = _loads(spark, folder).filter("season <> '1997-98'")
    games = tables(spark, folder)[0].select("season", "team_id", "opponent_team_id").distinct()
    pair = F.concat_ws(",", F.col("team_id").cast("string"), F.col("opponent_team_id").cast("string"))
    key = F.concat(
        F.lit("metric=wowy_shrunk|variant=wowy_shrunk|team_ids="),
        pair,
        F.lit("|season_ids="),
        F.col("season"),
        F.lit(":REGULAR|shrinkage_prior_games=10.00"),
    )
    return usage.refreshable(games.select(key.alias("metric_cache_key")), "wowy_shrunk", loads)


def canonical_keys(spark, folder):
    prior = (F.col("p_retailprice")).cast("string")
    key = F.concat(
        F.lit("metric=wowy_shrunk|variant=wowy_shrunk|team_ids=all-teams|season_ids=2014-15:REGULAR|shrinkage_prior_games="),
        F.when(F.col("p_partkey") % 2 == 0, two_decimals(F.col("p_retailprice"))).otherwise(prior),
    )
    parts = read_table(spark, folder, "part").select("p_partkey", key.alias("k"))
    return parts.select("p_partkey", is_canonical_key(F.col("k"), "wowy_shrunk").alias("is_canonical"))


def team_filters(spark, folder):
    listed = F.concat_ws(",", F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"))
    lines = read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", listed.alias("filter"))
    return lines.filter(canonical_team_filter(F.col("filter")).isNotNull())


def minute_texts(spark, folder):
    """Line quantities written in the three ways sources write minutes, and read back."""
    whole = F.col("l_quantity").cast("int").cast("string")
    seconds = F.lpad((F.col("l_linenumber") * 7 % 60).cast("string"), 2, "0")
    text = (
        F.when(F.col("l_linenumber") % 4 == 0, F.concat_ws(":", whole, seconds))
        .when(F.col("l_linenumber") % 4 == 1, F.concat(F.lit("PT"), whole, F.lit("M"), seconds, F.lit(".00S")))
        .when(F.col("l_linenumber") % 4 == 2, F.concat(whole, F.lit(".5")))
        .otherwise(F.concat(F.lit("DNP - "), whole))
    )
    return rounded(
        read_table(spark, folder, "lineitem").select(
            "l_orderkey", "l_linenumber", played_minutes(text).alias("minutes"), number(text).alias("plain")
        )
    )


# --- coverage -------------------------------------------------------------


def earliest_per_type(spark, folder):
    events = read_table(spark, folder, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    first = coverage.earliest_per_group(events, "event_type", "ts", "event_id")
    return first.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def _quarter_scores(spark, folder):
    """Orders as team statistics: a quarter's score is known if a line of that number exists."""
    lines = read_table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        *[F.max(F.when(F.col("l_linenumber") == n, F.col("l_quantity"))).cast("string").alias(f"q{n}Points") for n in range(1, 5)]
    )
    orders = read_table(spark, folder, "orders")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").cast("string").alias("gameId"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("gameDateTimeEst"),
        F.col("o_orderpriority").alias("teamCity"),
        F.col("o_orderstatus").alias("teamName"),
        *[f"q{n}Points" for n in range(1, 5)],
    )


def quarter_coverage(spark, folder):
    found = coverage.quarter_coverage(_quarter_scores(spark, folder))
    return found.withColumn("gameDateTimeEst", F.date_format("gameDateTimeEst", "yyyy-MM-dd HH:mm:ss"))


def oldest_game(spark, folder):
    orders = read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("gameId"), F.col("o_orderdate").cast("timestamp").alias("gameDateTimeEst")
    )
    found = coverage.oldest_game(orders)
    return found.withColumn("gameDateTimeEst", F.date_format("gameDateTimeEst", "yyyy-MM-dd HH:mm:ss"))


# --- ingest from text columns ---------------------------------------------


def _raw_columns(spark, folder):
    """The sample tables as a source would write them: text, with repeats, skipped types and unknown teams."""
    games, players, ids = games_with_players(spark, folder)
    number_ = F.col("game_id").cast("bigint")
    home = games.filter("is_home")
    kind = F.when(number_ % 17 == 0, "All-Star Game").when(number_ % 19 == 0, "NBA Cup").otherwise("Regular Season")
    raw_games = home.select(
        F.col("game_id").alias("gameId"),
        kind.alias("gameType"),
        F.concat(F.col("game_date").cast("string"), F.lit(" 19:30:00")).alias("gameDateTimeEst"),
        F.col("team_id").cast("string").alias("hometeamId"),
        F.when(number_ % 23 == 0, F.lit("0")).otherwise(F.col("opponent_team_id").cast("string")).alias("awayteamId"),
        (F.lit(100) + F.greatest("margin", F.lit(0.0))).cast("int").cast("string").alias("homeScore"),
        (F.lit(100) - F.least("margin", F.lit(0.0))).cast("int").cast("string").alias("awayScore"),
    )
    # Every 29th game is written twice, every 31st with another score the second time.
    once, other = (F.struct(*[F.lit("7").alias(c) if c == score else F.col(c) for c in raw_games.columns]) for score in ("", "homeScore"))
    written = F.col("gameId").cast("bigint")
    raw_games = raw_games.select(
        F.inline(F.array_compact(F.array(once, F.when(written % 29 == 0, once), F.when(written % 31 == 0, other))))
    )
    raw_players = players.select(
        F.col("game_id").alias("gameId"),
        F.col("is_home").cast("int").cast("string").alias("home"),
        F.col("player_id").cast("string").alias("personId"),
        F.lit("Player").alias("firstName"),
        F.when(F.col("player_id") % 9 == 0, F.lit("")).otherwise(F.col("player_id").cast("string")).alias("lastName"),
        F.when(number_ % 7 == 0, F.lit("-3")).otherwise(F.coalesce(F.col("minutes").cast("string"), F.lit(""))).alias("numMinutes"),
        F.when(F.col("appeared"), F.lit("2")).otherwise(F.lit("0.0")).alias("points"),
    )
    raw_players = raw_players.withColumn("firstName", F.when(F.col("lastName") == "", F.lit(" ")).otherwise(F.col("firstName")))
    raw_names = ids.select(
        F.col("player_id").cast("string").alias("personId"),
        F.lit("Listed").alias("firstName"),
        F.when(F.col("player_id") % 27 == 0, F.lit("")).otherwise(F.col("player_id").cast("string")).alias("lastName"),
    ).distinct()
    raw_names = raw_names.withColumn("firstName", F.when(F.col("lastName") == "", F.lit("")).otherwise(F.col("firstName")))
    return raw_games, raw_players, raw_names


def _ingested(spark, folder):
    return csv_files.normalize(*_raw_columns(spark, folder), dimension(spark, folder), source="text")


def ingest_games(spark, folder):
    games = _ingested(spark, folder).games
    return games.withColumn("game_date", F.col("game_date").cast("string"))


def ingest_game_players(spark, folder):
    return _ingested(spark, folder).game_players


def ingest_loads(spark, folder):
    return _ingested(spark, folder).loads.select(
        *scopes.SCOPE, "games_row_count", "game_players_row_count", "expected_games_row_count", "skipped_games_row_count"
    )


def ingest_issues(spark, folder):
    return _ingested(spark, folder).issues


def ingest_failures(spark, folder):
    """Refused team-seasons, with the number of games behind each message."""
    failures = _ingested(spark, folder).failures
    return failures.groupBy(*scopes.SCOPE, "failure_kind", "message").agg(F.countDistinct("game_id").alias("games"))


def ingest_summary(spark, folder):
    return csv_files.ingest_summary(_ingested(spark, folder).loads)


QUERIES = {
    "team_season_dim": team_season_dim,
    "team_labels": team_labels,
    "abbreviation_on_date": abbreviation_on_date,
    "abbreviation_alias": abbreviation_alias,
    "active_teams": active_teams,
    "options_by_team": options_by_team,
    "options_by_season": options_by_season,
    "team_filter": team_filter,
    "season_of_date": season_of_date,
    "season_texts": season_texts,
    "season_selection": season_selection,
    "season_order": season_order,
    "requested_scopes": requested_scopes,
    "resolved_scopes": resolved_scopes,
    "whole_games": whole_games,
    "own_sides": own_sides,
    "missing_scopes": missing_scopes,
    "combined_scopes": combined_scopes,
    "season_completeness": season_completeness,
    "completeness_warnings": completeness_warnings,
    "source_fingerprint": source_fingerprint,
    "usage_counts": usage_counts,
    "retained_keys": retained_keys,
    "refreshable_keys": refreshable_keys,
    "canonical_keys": canonical_keys,
    "team_filters": team_filters,
    "minute_texts": minute_texts,
    "earliest_per_type": earliest_per_type,
    "quarter_coverage": quarter_coverage,
    "oldest_game": oldest_game,
    "ingest_games": ingest_games,
    "ingest_game_players": ingest_game_players,
    "ingest_loads": ingest_loads,
    "ingest_issues": ingest_issues,
    "ingest_failures": ingest_failures,
    "ingest_summary": ingest_summary,
}

_EXPECTED = """
seasons AS (SELECT DISTINCT season, CAST(substr(season, 1, 4) AS INTEGER) AS y FROM loads),
expected AS (SELECT s.season, d.team_id, d.abbreviation FROM seasons s JOIN dimension d ON d.start_year = s.y)"""

_WANTED = "(SELECT DISTINCT game_id FROM games WHERE team_id IN (3, 8) AND season IN ('1996-97', '1998-99'))"

USAGE = """
log AS (
  SELECT CASE WHEN user_id % 2 = 0 THEN 'wowy' ELSE 'ridge' END AS metric_id,
    event_type || '-' || user_id % 7 AS metric_cache_key, ts AS requested_at FROM events),
counts AS (
  SELECT metric_id, metric_cache_key, count(*) AS query_count, max(requested_at) AS last_requested_at
  FROM log GROUP BY ALL)"""

_RAW = """
raw AS (
  SELECT *, CAST(game_id AS BIGINT) AS n FROM games),
conflicting AS (SELECT game_id FROM raw WHERE is_home AND n % 31 = 0 AND 100 + greatest(margin, 0) <> 7),
known AS (SELECT DISTINCT team_id FROM dimension),
counted AS (
  SELECT r.* FROM raw r WHERE n % 17 <> 0 AND n % 23 <> 0 AND game_id NOT IN (SELECT game_id FROM conflicting)),
raw_players AS (
  SELECT p.*, CAST(p.game_id AS BIGINT) AS n FROM players p),
typed AS (
  SELECT game_id, season, season_id, season_type, team_id, player_id,
    CASE WHEN player_id % 9 <> 0 THEN 'Player ' || player_id WHEN player_id % 27 <> 0 THEN 'Listed ' || player_id END AS player_name,
    CASE WHEN n % 7 = 0 THEN appeared ELSE coalesce(minutes, 0) > 0 OR appeared END AS appeared,
    CASE WHEN n % 7 = 0 THEN 0.0 ELSE coalesce(minutes, 0.0) END AS minutes
  FROM raw_players WHERE game_id IN (SELECT game_id FROM counted)),
good AS (SELECT * FROM typed WHERE player_name IS NOT NULL),
enough AS (SELECT game_id, team_id FROM good GROUP BY ALL HAVING count(*) FILTER (WHERE appeared) >= 5),
kept_games AS (SELECT c.* FROM counted c JOIN enough e ON e.game_id = c.game_id AND e.team_id = c.team_id),
kept_players AS (SELECT g.* FROM good g JOIN enough e ON e.game_id = g.game_id AND e.team_id = g.team_id),
skipped AS (
  SELECT team_id, season, count(*) AS n FROM raw
  WHERE (n % 17 = 0 OR n % 23 = 0) AND NOT (n % 23 = 0 AND NOT is_home)
    AND game_id NOT IN (SELECT game_id FROM conflicting) GROUP BY ALL),
load_counts AS (
  SELECT e.team_id, e.season, 'Regular Season' AS season_type, e.games_row_count, p.game_players_row_count,
    x.expected_games_row_count, coalesce(s.n, 0) AS skipped_games_row_count
  FROM (SELECT team_id, season, count(*) AS games_row_count FROM kept_games GROUP BY ALL) e
  JOIN (SELECT team_id, season, count(*) AS game_players_row_count FROM kept_players GROUP BY ALL) p USING (team_id, season)
  JOIN (SELECT team_id, season, count(*) AS expected_games_row_count FROM raw WHERE n % 17 <> 0 AND n % 23 <> 0
    GROUP BY ALL) x USING (team_id, season)
  LEFT JOIN skipped s USING (team_id, season))"""

ORACLES = {
    "team_season_dim": over(
        DIMENSION,
        select="""SELECT team_id, start_year, abbreviation,
            upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS city, nickname,
            upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) || ' ' || nickname AS full_name
          FROM dimension""",
    ),
    "team_labels": over(
        DIMENSION,
        select="""SELECT team_id, arg_max(abbreviation, start_year) AS current_abbreviation,
            arg_max(upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) || ' ' || nickname, start_year) AS current_name,
            string_agg(CAST(start_year AS VARCHAR), ',' ORDER BY start_year) AS active_years
          FROM dimension GROUP BY team_id""",
    ),
    "abbreviation_alias": over(
        DIMENSION, select="SELECT DISTINCT abbreviation, team_id AS resolved_team_id FROM spans"
    ),
    "canonical_keys": """SELECT p_partkey,
      p_partkey % 2 = 0 OR CAST(p_retailprice AS VARCHAR) = printf('%.2f', p_retailprice) AS is_canonical FROM part""",
    "abbreviation_on_date": over(
        DIMENSION,
        """
used AS (
  SELECT abbreviation, y.y AS y, arg_min(team_id, first) AS team_id
  FROM spans, LATERAL (SELECT unnest(range(first, coalesce(last, 2200) + 1)) AS y) y GROUP BY ALL),
dated AS (
  SELECT o_orderkey, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS abbreviation,
    CASE WHEN month(o_orderdate) >= 7 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS y
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)""",
        select="""SELECT o_orderkey, d.abbreviation, u.team_id AS resolved_team_id
          FROM dated d LEFT JOIN used u ON u.abbreviation = d.abbreviation AND u.y = d.y""",
    ),
    "active_teams": over(
        DIMENSION,
        LOADS,
        select="""SELECT l.team_id, l.season, d.abbreviation FROM loads l JOIN dimension d
          ON d.team_id = l.team_id AND d.start_year = CAST(substr(l.season, 1, 4) AS INTEGER)""",
    ),
    "options_by_team": over(
        DIMENSION,
        LOADS,
        _EXPECTED,
        select="""SELECT team_id, string_agg(season, ',' ORDER BY season) AS available_seasons,
            max(current_abbreviation) AS label
          FROM expected JOIN current_names USING (team_id)
          WHERE team_id % 2 = 0 AND team_id IN (SELECT team_id FROM loads) GROUP BY team_id""",
    ),
    "options_by_season": over(
        DIMENSION,
        LOADS,
        _EXPECTED,
        select="""SELECT season, string_agg(abbreviation, ',' ORDER BY current_abbreviation) AS available_teams
          FROM expected JOIN current_names USING (team_id)
          WHERE team_id % 2 = 0 AND team_id IN (SELECT team_id FROM loads) GROUP BY season""",
    ),
    "team_filter": over(
        LOADS, select="SELECT string_agg(CAST(team_id AS VARCHAR), ',' ORDER BY team_id) AS team_filter FROM (SELECT DISTINCT team_id FROM loads)"
    ),
    "season_of_date": """SELECT o_orderkey, CAST(y AS VARCHAR) || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS season
      FROM (SELECT o_orderkey, year(o_orderdate) - CASE WHEN month(o_orderdate) >= 7 THEN 0 ELSE 1 END AS y FROM orders)""",
    "season_texts": """SELECT event_id,
        CASE WHEN event_id % 5 IN (0, 3, 4) OR (event_id % 5 = 1 AND y % 100 = 99) THEN CAST(y AS INTEGER) END AS start_year,
        CASE WHEN event_id % 5 = 0 THEN s || ':REGULAR' WHEN event_id % 5 = 1 AND y % 100 = 99 THEN s || ':PLAYOFFS'
          WHEN event_id % 5 = 3 THEN s || ':PLAYOFFS' END AS season_id,
        CASE event_id % 5 WHEN 0 THEN 'regular_season' WHEN 1 THEN 'playoffs' WHEN 2 THEN 'preseason'
          WHEN 3 THEN 'playoffs' END AS slug
      FROM (SELECT *, CAST(y AS VARCHAR) || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS s
        FROM (SELECT event_id, 1940 + event_id % 90 AS y FROM events))""",
    "season_selection": over(
        LOADS,
        select="""SELECT DISTINCT season || ':' || t AS season_id FROM loads, (VALUES ('REGULAR'), ('PLAYOFFS')) v(t)
          WHERE season BETWEEN '1996-97' AND '1999-00'""",
    ),
    "season_order": over(
        LOADS,
        select="""SELECT DISTINCT season, season_type, season || ':REGULAR' AS season_id,
          CAST(substr(season, 1, 4) AS BIGINT) AS start_year, CAST(1 AS INTEGER) AS type_order FROM loads""",
    ),
    "requested_scopes": over(
        DIMENSION,
        LOADS,
        select="""SELECT l.team_id, l.season, l.season_type FROM loads l JOIN dimension d
            ON d.team_id = l.team_id AND d.start_year = CAST(substr(l.season, 1, 4) AS INTEGER)
          WHERE l.team_id BETWEEN 1 AND 15 AND l.season IN ('1994-95', '1996-97', '1999-00')
            AND games_row_count > 0 AND game_players_row_count > 0""",
    ),
    "resolved_scopes": over(
        LOADS,
        select="""SELECT CAST(t AS BIGINT) AS team_id, s AS season, k AS season_type, l.team_id IS NOT NULL AS is_cached
          FROM (VALUES (2), (4), (99)) a(t), (VALUES ('1996-97')) b(s), (VALUES ('Regular Season'), ('Playoffs')) c(k)
          LEFT JOIN loads l ON l.team_id = t AND l.season = s AND l.season_type = k AND game_players_row_count > 0""",
    ),
    "whole_games": over(
        select=f"""SELECT g.game_id, g.season, g.team_id, g.is_home, g.margin, n AS players FROM games g
          LEFT JOIN (SELECT game_id, team_id, count(*) AS n FROM players GROUP BY ALL) p
            ON p.game_id = g.game_id AND p.team_id = g.team_id
          WHERE g.game_id IN {_WANTED}"""
    ),
    "own_sides": over(
        select="""SELECT g.game_id, g.season, g.team_id, g.is_home, g.margin, n AS players FROM games g
          LEFT JOIN (SELECT game_id, team_id, count(*) AS n FROM players GROUP BY ALL) p
            ON p.game_id = g.game_id AND p.team_id = g.team_id
          WHERE g.team_id IN (3, 8) AND g.season IN ('1996-97', '1998-99')"""
    ),
    "missing_scopes": over(LOADS, select="SELECT team_id, season, season_type FROM loads WHERE team_id % 4 = 0"),
    "combined_scopes": over(
        LOADS,
        """
typed_loads AS (
  SELECT team_id, season, CASE WHEN team_id > 12 THEN 'Playoffs' ELSE season_type END AS season_type FROM loads
  WHERE team_id <= 12 OR season NOT IN ('1995-96', '1997-98'))""",
        select="""SELECT * FROM typed_loads WHERE season IN (SELECT season FROM typed_loads WHERE season_type = 'Playoffs'
          INTERSECT SELECT season FROM typed_loads WHERE season_type = 'Regular Season')""",
    ),
    "season_completeness": over(
        DIMENSION,
        LOADS,
        _EXPECTED,
        """
facts AS (
  SELECT coalesce(l.season, e.season) AS season, l.team_id AS loaded, e.team_id AS wanted,
    games_row_count AS g, expected_games_row_count AS x, skipped_games_row_count AS s
  FROM loads l FULL JOIN expected e ON e.team_id = l.team_id AND e.season = l.season),
per_season AS (
  SELECT season, count(*) FILTER (WHERE loaded IS NULL) AS missing_teams,
    count(*) FILTER (WHERE wanted IS NULL) AS unexpected_teams,
    count(*) FILTER (WHERE loaded IS NOT NULL AND x IS NULL) AS teams_without_counts,
    count(*) FILTER (WHERE x IS NOT NULL AND g <> x) AS partial_teams,
    count(*) FILTER (WHERE x IS NOT NULL AND s <> 0) AS teams_with_skips
  FROM facts GROUP BY season)""",
        select="""SELECT *, 'Regular Season' AS season_type, missing_teams + unexpected_teams + teams_without_counts
          + partial_teams + teams_with_skips = 0 AS is_complete FROM per_season""",
    ),
    "completeness_warnings": over(
        DIMENSION,
        LOADS,
        _EXPECTED,
        """
named AS (
  SELECT l.*, coalesce(d.abbreviation, CAST(l.team_id AS VARCHAR)) AS label FROM loads l LEFT JOIN dimension d
    ON d.team_id = l.team_id AND d.start_year = CAST(substr(l.season, 1, 4) AS INTEGER))""",
        select="""SELECT season || ':REGULAR' AS season_id, 'incomplete load metadata for ' || label AS message
          FROM named WHERE expected_games_row_count IS NULL
          UNION ALL SELECT season || ':REGULAR', 'partial team-season for ' || label || ' (' || games_row_count || '/'
            || expected_games_row_count || ' games)' FROM named WHERE games_row_count <> expected_games_row_count
          UNION ALL SELECT season || ':REGULAR',
            'missing team-seasons: ' || string_agg(DISTINCT abbreviation, ', ' ORDER BY abbreviation)
          FROM expected e WHERE NOT EXISTS (SELECT 1 FROM loads l WHERE l.team_id = e.team_id AND l.season = e.season)
          GROUP BY season""",
    ),
    "source_fingerprint": over(
        LOADS,
        """
digests AS (
  SELECT season, sha256(concat_ws('|', team_id, season, season_type, 'orders', 'sample-v1', 'orders', 'v1',
    games_row_count, game_players_row_count, coalesce(CAST(expected_games_row_count AS VARCHAR), 'None'),
    skipped_games_row_count)) AS d FROM loads)""",
        select="""SELECT season, sha256(concat_ws(':', count(*),
            bit_xor(CAST('0x' || substr(d, 1, 15) AS BIGINT)), bit_xor(CAST('0x' || substr(d, 16, 15) AS BIGINT)),
            bit_xor(CAST('0x' || substr(d, 31, 15) AS BIGINT)), bit_xor(CAST('0x' || substr(d, 46, 15) AS BIGINT))))
            AS source_fingerprint FROM digests GROUP BY season""",
    ),
    "usage_counts": "WITH "
    + USAGE
    + """ SELECT metric_id, metric_cache_key, query_count,
      strftime(last_requested_at, '%Y-%m-%d %H:%M:%S') AS last_requested_at FROM counts""",
    "retained_keys": "WITH "
    + USAGE
    + """, ranked AS (
      SELECT metric_cache_key, 0 AS tier, CAST(0 AS BIGINT) AS query_count, NULL AS last_requested_at FROM counts
      WHERE metric_id = 'ridge' AND metric_cache_key LIKE '%-3'
      UNION ALL SELECT metric_cache_key, 1, query_count, last_requested_at FROM counts c WHERE metric_id = 'wowy'
        AND NOT EXISTS (SELECT 1 FROM counts p WHERE p.metric_id = 'ridge' AND p.metric_cache_key LIKE '%-3'
          AND p.metric_cache_key = c.metric_cache_key))
      SELECT metric_cache_key, CAST(tier AS INTEGER) AS tier, query_count FROM ranked
      ORDER BY tier, query_count DESC, last_requested_at DESC, metric_cache_key LIMIT 10""",
    "refreshable_keys": over(
        select="""SELECT DISTINCT 'metric=wowy_shrunk|variant=wowy_shrunk|team_ids=' || team_id || ',' || opponent_team_id
            || '|season_ids=' || season || ':REGULAR|shrinkage_prior_games=10.00' AS metric_cache_key
          FROM games WHERE team_id < opponent_team_id AND season <> '1997-98'"""
    ),
    "team_filters": """SELECT l_orderkey, l_linenumber, l_suppkey || ',' || l_linenumber AS filter FROM lineitem
      WHERE l_suppkey > 0 AND l_linenumber > l_suppkey""",
    "minute_texts": """SELECT l_orderkey, l_linenumber,
        round(CASE l_linenumber % 4 WHEN 0 THEN l_quantity + (l_linenumber * 7 % 60) / 60.0
          WHEN 1 THEN l_quantity + (l_linenumber * 7 % 60) / 60.0 WHEN 2 THEN l_quantity + 0.5 END, 6) AS minutes,
        CASE WHEN l_linenumber % 4 = 2 THEN l_quantity + 0.5 END AS plain FROM lineitem""",
    "earliest_per_type": """SELECT event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS ts,
        arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY event_type""",
    "quarter_coverage": """WITH lines AS (
        SELECT l_orderkey, bool_or(l_linenumber = 1) AS q1, bool_or(l_linenumber = 2) AS q2,
          bool_or(l_linenumber = 3) AS q3, bool_or(l_linenumber = 4) AS q4 FROM lineitem GROUP BY l_orderkey),
      g AS (SELECT o_orderdate AS t, CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS city, o_orderstatus AS name,
        q1, q2, q3, q4 FROM orders JOIN lines ON l_orderkey = o_orderkey),
      named AS (
        SELECT 'q1Points' AS name, min((t, id, city, g.name)) AS r FROM g WHERE q1 UNION ALL
        SELECT 'q2Points', min((t, id, city, g.name)) FROM g WHERE q2 UNION ALL
        SELECT 'q3Points', min((t, id, city, g.name)) FROM g WHERE q3 UNION ALL
        SELECT 'q4Points', min((t, id, city, g.name)) FROM g WHERE q4 UNION ALL
        SELECT 'all_quarters', min((t, id, city, g.name)) FROM g WHERE q1 AND q2 AND q3 AND q4)
      SELECT name, strftime(r[1], '%Y-%m-%d %H:%M:%S') AS "gameDateTimeEst", r[2] AS "gameId", r[3] AS "teamCity",
        r[4] AS "teamName" FROM named WHERE r IS NOT NULL""",
    "oldest_game": """SELECT 'oldest' AS name, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS "gameDateTimeEst",
        arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS "gameId" FROM orders""",
    "ingest_games": over(
        DIMENSION,
        _RAW,
        select="""SELECT game_id, season, season_type, CAST(game_date AS VARCHAR) AS game_date, team_id, opponent_team_id,
          is_home, margin, 'text' AS source FROM kept_games""",
    ),
    "ingest_game_players": over(
        DIMENSION,
        _RAW,
        select="SELECT game_id, season, season_type, team_id, player_id, player_name, appeared, minutes FROM kept_players",
    ),
    "ingest_loads": over(DIMENSION, _RAW, select="SELECT * FROM load_counts"),
    "ingest_issues": over(
        DIMENSION,
        _RAW,
        select="""SELECT 'games' AS "table", 'game_id=''' || game_id || '''' AS key,
            'conflicting rows for one game id' AS message FROM conflicting
          UNION ALL SELECT 'game_players', 'game_id=''' || game_id || ''',team_id=' || team_id || ',player_id=' || player_id,
            'blank player name' FROM typed WHERE player_name IS NULL""",
    ),
    "ingest_failures": over(
        DIMENSION,
        _RAW,
        select="""SELECT team_id, season,
            CASE WHEN n % 17 <> 0 THEN 'Regular Season' END AS season_type, 'partial_scope_error' AS failure_kind,
            'conflicting rows for one game id' AS message, count(*) AS games
          FROM raw WHERE game_id IN (SELECT game_id FROM conflicting) AND NOT (n % 23 = 0 AND NOT is_home) GROUP BY ALL
          UNION ALL SELECT team_id, season, season_type, 'partial_scope_error', 'blank player name', count(DISTINCT game_id)
          FROM typed WHERE player_name IS NULL GROUP BY ALL""",
    ),
    "ingest_summary": over(
        DIMENSION,
        _RAW,
        select="""SELECT season_type, season, team_id, CAST(1 AS BIGINT) AS scopes, games_row_count AS games,
            game_players_row_count AS game_players, skipped_games_row_count AS skipped_games FROM load_counts
          UNION ALL SELECT NULL, NULL, NULL, count(*), CAST(sum(games_row_count) AS BIGINT),
            CAST(sum(game_players_row_count) AS BIGINT), CAST(sum(skipped_games_row_count) AS BIGINT) FROM load_counts""",
    ),
}
