"""Registered queries: data quality, over sample tables with defects set by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from impactframe.functions.text import message_signature
from impactframe.operators import quality as Q
from impactframe.operators.ridge import observations, exposure_weights, player_context
from impactframe.operators.teams import team_seasons
from impactframe.plans.margin_queries import tables
from impactframe.plans.reference_sql import WEIGHTS, over
from impactframe.sources.sample_tables import loads_view, read_table

LAST_YEAR = 2002


def short_name(letter: str) -> Column:
    """Three-letter abbreviation of a nation: a letter and its number."""
    return F.concat(F.lit(letter), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))


def nation_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as teams; every third was renamed in 1997, and some start late or end early."""
    key = F.col("n_nationkey")
    team = (key + 1).cast("bigint").alias("team_id")
    name = F.initcap("n_name")
    start = (F.lit(1990) + key % 6).cast("int")
    end = F.when(key % 8 == 7, F.lit(1999))
    renamed = key % 3 == 0

    def span(short, nickname, first, last):
        return F.struct(
            short.alias("abbreviation"),
            name.alias("city"),
            F.lit(nickname).alias("nickname"),
            first.cast("int").alias("season_start"),
            last.cast("int").alias("season_end"),
            short_name("N").alias("lookup_abbreviation"),
        )

    short, old_short = short_name("N"), short_name("X")
    # A team that was not renamed has one span; the empty slot is dropped again.
    spans = F.array_compact(
        F.array(
            F.when(renamed, span(old_short, "Old", start, F.lit(1996))),
            F.when(renamed, span(short, "New", F.lit(1997), end)).otherwise(span(short, "New", start, end)),
        )
    )
    return read_table(spark, folder, "nation").select(team, F.inline(spans))


def dimension(spark, folder):
    return team_seasons(nation_spans(spark, folder), LAST_YEAR)


def defective(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The sample tables with one kind of defect for each of a few game numbers."""
    games, players = tables(spark, folder)
    number = F.col("game_id").cast("bigint")

    def every(n: int):
        return (number % n == 0) & ~F.col("is_home")

    games = games.select(
        "game_id",
        "season",
        "season_type",
        F.when(every(83), F.date_add("game_date", 1)).otherwise(F.col("game_date")).alias("game_date"),
        "team_id",
        F.when(every(79), F.col("team_id")).otherwise(F.col("opponent_team_id")).alias("opponent_team_id"),
        (F.col("is_home") | (number % 89 == 0)).alias("is_home"),
        F.when(every(97), F.col("margin") + 1).otherwise(F.col("margin")).alias("margin"),
        F.when(every(73), F.lit(" ")).otherwise(F.col("source")).alias("source"),
    )
    players = players.select(
        "game_id",
        F.when(number % 103 == 0, F.lit("1980-81")).otherwise(F.col("season")).alias("season"),
        "season_type",
        "team_id",
        F.when(number % 71 == 0, -F.col("player_id")).otherwise(F.col("player_id")).alias("player_id"),
        F.when(number % 67 == 0, F.lit("")).otherwise(F.col("player_name")).alias("player_name"),
        "appeared",
        F.when(number % 61 == 0, F.col("minutes") + 100).otherwise(F.col("minutes")).alias("minutes"),
    )
    return games, players.filter(number % 107 != 0)


def _loads(spark, folder):
    games, players = tables(spark, folder)
    return loads_view(games, players).select(
        *[
            F.when(F.col("team_id") == 3, F.lit(" ")).otherwise(F.col(c)).alias(c)
            if c == "source_kind"
            else F.when(F.col("team_id") == 5, F.lit(-1).cast("bigint")).otherwise(F.col(c)).alias(c)
            if c == "skipped_games_row_count"
            else F.col(c)
            for c in loads_view(games, players).columns
        ]
    )


def game_issues(spark, folder):
    return Q.game_issues(defective(spark, folder)[0], dimension(spark, folder))


def player_issues(spark, folder):
    return Q.player_issues(defective(spark, folder)[1], dimension(spark, folder))


def load_issues(spark, folder):
    return Q.load_issues(_loads(spark, folder), dimension(spark, folder))


def unmatched_players(spark, folder):
    games, players = defective(spark, folder)
    return Q.unmatched_players(games.filter(F.col("game_id").cast("bigint") % 53 != 0), players)


def reciprocal_issues(spark, folder):
    return Q.reciprocal_issues(defective(spark, folder)[0])


def scope_issues(spark, folder):
    return Q.scope_issues(Q.scope_findings(*defective(spark, folder)))


def key_differences(spark, folder):
    return Q.key_differences(*defective(spark, folder))


def count_issues(spark, folder):
    games, players = defective(spark, folder)
    return Q.count_issues(games, players, _loads(spark, folder).filter(F.col("team_id") != 7))


def team_history_issues(spark, folder):
    history = dimension(spark, folder).select(
        "team_id",
        F.concat_ws("-", F.col("start_year").cast("string"), F.lpad((F.col("start_year") + 1).cast("string").substr(3, 2), 2, "0")).alias("season"),
        F.when(F.col("team_id") % 5 == 0, F.lit("ZZZ")).otherwise(F.col("abbreviation")).alias("abbreviation"),
        F.lower("abbreviation").alias("franchise_id"),
        F.col("abbreviation").alias("lookup_abbreviation"),
    )
    return Q.team_history_issues(history, dimension(spark, folder))


def audit(spark, folder):
    games, players = defective(spark, folder)
    return Q.audit(games, players, _loads(spark, folder), dimension(spark, folder))


def _listed(spark, folder):
    games, players = defective(spark, folder)
    teams = dimension(spark, folder)
    return (
        Q.game_issues(games, teams).unionByName(Q.player_issues(players, teams)).unionByName(Q.reciprocal_issues(games))
    )


def issue_trends(spark, folder):
    return Q.issue_trends(_listed(spark, folder))


def issue_counts(spark, folder):
    return Q.issues_by_table(_listed(spark, folder))


def document_signatures(spark, folder):
    texts = read_table(spark, folder, "documents")
    return texts.groupBy(message_signature(F.col("text")).alias("signature")).agg(F.count("*").alias("documents"))


def request_issues(spark, folder):
    games, players = tables(spark, folder)
    obs = observations(games, players)
    context = player_context(obs, players).filter(F.col("player_id") % 10 != 0)
    return Q.request_issues(exposure_weights(obs, players), context)


def write_issues(spark, folder):
    """Every 53rd game is written under a season type that is not loaded, its players are not."""
    games, players = tables(spark, folder)
    moved = F.when(F.col("game_id").cast("bigint") % 53 == 0, "Playoffs").otherwise(F.col("season_type"))
    return Q.write_issues(games.withColumn("season_type", moved), players, loads_view(games, players))


QUERIES = {
    "write_issues": write_issues,
    "game_issues": game_issues,
    "player_issues": player_issues,
    "load_issues": load_issues,
    "unmatched_players": unmatched_players,
    "reciprocal_issues": reciprocal_issues,
    "scope_issues": scope_issues,
    "key_differences": key_differences,
    "count_issues": count_issues,
    "team_history_issues": team_history_issues,
    "table_audit": audit,
    "issue_trends": issue_trends,
    "issue_counts": issue_counts,
    "document_signatures": document_signatures,
    "request_issues": request_issues,
}

# The team dimension as SQL; also used by the team queries.
DIMENSION = """
spans AS (
  SELECT CAST(n_nationkey + 1 AS BIGINT) AS team_id, 'X' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS abbreviation, n_name,
    'Old' AS nickname, 1990 + n_nationkey % 6 AS first, 1996 AS last FROM nation WHERE n_nationkey % 3 = 0
  UNION ALL
  SELECT CAST(n_nationkey + 1 AS BIGINT), 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0'), n_name, 'New',
    CASE WHEN n_nationkey % 3 = 0 THEN 1997 ELSE 1990 + n_nationkey % 6 END,
    CASE WHEN n_nationkey % 8 = 7 THEN 1999 END FROM nation),
dimension AS (
  SELECT team_id, abbreviation, n_name, nickname, CAST(y.y AS INTEGER) AS start_year
  FROM spans, LATERAL (SELECT unnest(range(first, coalesce(last, 2002) + 1)) AS y) y),
current_names AS (SELECT team_id, arg_max(abbreviation, start_year) AS current_abbreviation FROM dimension GROUP BY team_id)"""

DEFECTIVE = """
bad_games AS (
  SELECT game_id, season, season_type,
    CASE WHEN n % 83 = 0 AND NOT is_home THEN game_date + 1 ELSE game_date END AS game_date, team_id,
    CASE WHEN n % 79 = 0 AND NOT is_home THEN team_id ELSE opponent_team_id END AS opponent_team_id,
    is_home OR n % 89 = 0 AS is_home,
    CASE WHEN n % 97 = 0 AND NOT is_home THEN margin + 1 ELSE margin END AS margin,
    CASE WHEN n % 73 = 0 AND NOT is_home THEN ' ' ELSE source END AS source
  FROM (SELECT *, CAST(game_id AS BIGINT) AS n FROM games)),
bad_players AS (
  SELECT game_id, CASE WHEN n % 103 = 0 THEN '1980-81' ELSE season END AS season, season_type, team_id,
    CASE WHEN n % 71 = 0 THEN -player_id ELSE player_id END AS player_id,
    CASE WHEN n % 67 = 0 THEN '' ELSE player_name END AS player_name, appeared,
    CASE WHEN n % 61 = 0 THEN minutes + 100 ELSE minutes END AS minutes
  FROM (SELECT *, CAST(game_id AS BIGINT) AS n FROM players) WHERE n % 107 <> 0)"""

LOADS = """
game_counts AS (SELECT team_id, season, season_type, count(*) AS n FROM games GROUP BY ALL),
player_counts AS (SELECT team_id, season, season_type, count(*) AS n FROM players GROUP BY ALL),
loads AS (
  SELECT g.team_id, g.season, g.season_type, g.n AS games_row_count, coalesce(p.n, 0) AS game_players_row_count,
    CASE WHEN g.team_id % 13 <> 0 THEN g.n + CASE WHEN g.team_id % 11 = 0 AND CAST(substr(g.season, 1, 4) AS INTEGER) % 2 = 1
      THEN 1 ELSE 0 END END AS expected_games_row_count, CAST(0 AS BIGINT) AS skipped_games_row_count
  FROM game_counts g LEFT JOIN player_counts p ON p.team_id = g.team_id AND p.season = g.season)"""

_YEAR = "CAST(substr(x.season, 1, 4) AS INTEGER)"


def _active(team: str) -> str:
    """The row is called x."""
    return f"""WHEN NOT EXISTS (SELECT 1 FROM dimension d WHERE d.team_id = x.{team} AND d.start_year = {_YEAR})
      THEN 'team id ' || x.{team} || ' was not active in season ' || {_YEAR}"""


_GAME_ISSUES = f"""
game_problems AS (
  SELECT 'games' AS "table", 'game_id=''' || game_id || ''',team_id=' || team_id || ',season=''' || season
      || ''',season_type=''' || season_type || '''' AS key,
    CASE {_active("team_id")} {_active("opponent_team_id")}
      WHEN trim(source) = '' THEN 'source must not be empty'
      WHEN team_id = opponent_team_id THEN 'team and opponent must differ'
      WHEN year(game_date) NOT BETWEEN {_YEAR} AND {_YEAR} + 1
        THEN 'date ''' || game_date || ''' falls outside season ''' || season || '''' END AS message
  FROM bad_games x)"""

_PLAYER_ISSUES = f"""
player_problems AS (
  SELECT 'game_players' AS "table", 'game_id=''' || game_id || ''',team_id=' || team_id || ',player_id=' || player_id
      || ',season=''' || season || ''',season_type=''' || season_type || '''' AS key,
    CASE WHEN player_id <= 0 THEN 'player_id must be positive'
      WHEN trim(player_name) = '' THEN 'player_name must not be empty'
      WHEN minutes > 80 THEN 'implausible minutes ' || printf('%.1f', minutes)
      {_active("team_id")} END AS message
  FROM bad_players x)"""

_PAIR_ISSUES = """
two AS (
  SELECT a.game_id, a.season, a.season_type, a.team_id AS t1, b.team_id AS t2, a.opponent_team_id AS o1,
    b.opponent_team_id AS o2, a.is_home AS h1, b.is_home AS h2, a.game_date AS d1, b.game_date AS d2,
    a.margin AS m1, b.margin AS m2
  FROM bad_games a JOIN bad_games b ON a.game_id = b.game_id AND a.team_id < b.team_id),
pair_problems AS (
  SELECT 'games' AS "table", 'game_id=''' || game_id || ''',season=''' || season || ''',season_type='''
    || season_type || '''' AS key, message
  FROM (
    SELECT *, 'paired game rows must reference each other as opponents' AS message FROM two WHERE t1 <> o2 UNION ALL
    SELECT *, 'paired game rows must reference each other as opponents' FROM two WHERE t2 <> o1 UNION ALL
    SELECT *, 'paired game rows must have opposite home/away flags' FROM two WHERE h1 = h2 UNION ALL
    SELECT *, 'paired game rows must have the same game date' FROM two WHERE d1 <> d2 UNION ALL
    SELECT *, 'paired game rows must have opposite margins: ' || t1 || '=' || m1 || ' ' || t2 || '=' || m2
    FROM two WHERE m1 <> -m2))"""

_SIDES = """
game_sides AS (SELECT season, season_type, game_id, team_id, count(*) AS n FROM bad_games GROUP BY ALL),
player_sides AS (
  SELECT season, season_type, game_id, team_id, count(*) AS n, count(*) FILTER (WHERE appeared) AS seen,
    coalesce(sum(minutes) FILTER (WHERE appeared), 0) AS minutes FROM bad_players GROUP BY ALL),
team_games AS (
  SELECT coalesce(g.season, p.season) AS season, coalesce(g.season_type, p.season_type) AS season_type,
    coalesce(g.game_id, p.game_id) AS game_id, coalesce(g.team_id, p.team_id) AS team_id,
    coalesce(g.n, 0) AS games, coalesce(p.n, 0) AS rows, coalesce(p.seen, 0) AS seen, coalesce(p.minutes, 0) AS minutes
  FROM game_sides g FULL JOIN player_sides p
    ON p.game_id = g.game_id AND p.team_id = g.team_id AND p.season = g.season AND p.season_type = g.season_type)"""

_ALL = [DEFECTIVE, DIMENSION, _GAME_ISSUES, _PLAYER_ISSUES, _PAIR_ISSUES]
_UNION = """(SELECT * FROM game_problems WHERE message IS NOT NULL UNION ALL
  SELECT * FROM player_problems WHERE message IS NOT NULL UNION ALL SELECT * FROM pair_problems)"""

ORACLES = {
    "write_issues": over(
        select="""SELECT 'games' AS "table", 'game_id=''' || game_id || ''',team_id=' || team_id AS key,
            'row is outside the written team-seasons' AS message
          FROM games WHERE CAST(game_id AS BIGINT) % 53 = 0
          UNION ALL SELECT 'game_players', 'game_id=''' || game_id || ''',team_id=' || team_id || ',player_id=' || player_id,
            'player row refers to a game that is not written'
          FROM players WHERE CAST(game_id AS BIGINT) % 53 = 0"""
    ),
    "document_signatures": r"""
      WITH pieces AS (
        SELECT regexp_extract_all(regexp_replace(text, '''[^'']*''', '''<value>''', 'g'),
          '[A-Za-z]+[0-9-]|[A-Za-z]+|-?[0-9]+\.[0-9]+|-?[0-9]+|[^A-Za-z0-9-]+|-') AS p FROM documents),
      shown AS (
        SELECT array_to_string(list_transform(p, lambda x: CASE WHEN regexp_matches(x, '^-?[0-9]') THEN '<num>' ELSE x END), '')
          AS t FROM pieces)
      SELECT trim(regexp_replace(t, '[\x09-\x0D ]+', ' ', 'g'), ' ') AS signature, count(*) AS documents
      FROM shown GROUP BY ALL""",
    "game_issues": over(
        DEFECTIVE, DIMENSION, _GAME_ISSUES, select="SELECT * FROM game_problems WHERE message IS NOT NULL"
    ),
    "player_issues": over(
        DEFECTIVE, DIMENSION, _PLAYER_ISSUES, select="SELECT * FROM player_problems WHERE message IS NOT NULL"
    ),
    "load_issues": over(
        DIMENSION,
        LOADS,
        select=f"""SELECT * FROM (
          SELECT 'loads' AS "table", 'team_id=' || team_id || ',season=''' || season || ''',season_type='''
              || season_type || '''' AS key,
            CASE {_active("team_id")} WHEN team_id = 3 THEN 'source_kind must not be empty'
              WHEN team_id = 5 THEN 'skipped_games_row_count must be non-negative' END AS message
          FROM loads x) WHERE message IS NOT NULL""",
    ),
    "unmatched_players": over(
        DEFECTIVE,
        select="""SELECT * FROM (
          SELECT 'game_players' AS "table",
            'game_id=''' || p.game_id || ''',team_id=' || p.team_id || ',player_id=' || p.player_id AS key,
            CASE WHEN g.game_id IS NULL THEN 'player row has no matching game row'
              WHEN g.season <> p.season THEN 'player row season or season_type does not match its game row' END AS message
          FROM bad_players p LEFT JOIN bad_games g ON g.game_id = p.game_id AND g.team_id = p.team_id
            AND CAST(g.game_id AS BIGINT) % 53 <> 0)
          WHERE message IS NOT NULL""",
    ),
    "reciprocal_issues": over(DEFECTIVE, _PAIR_ISSUES, select="SELECT * FROM pair_problems"),
    "scope_issues": over(
        DEFECTIVE,
        _SIDES,
        select="""SELECT 'scopes' AS "table",
            'team_id=' || team_id || ',season=''' || season || ''',season_type=''' || season_type || '''' AS key,
            'game ''' || game_id || ''': ' || message AS message
          FROM (
            SELECT *, row_number() OVER (PARTITION BY team_id, season, season_type ORDER BY step, game_id, message) AS n
            FROM (
              SELECT *, 5 AS step, 'game row without player rows' AS message FROM team_games WHERE rows = 0 UNION ALL
              SELECT *, 5, 'player rows without a game row' FROM team_games WHERE games = 0 UNION ALL
              SELECT *, 6, 'expected at least 5 appeared players, found ' || seen FROM team_games WHERE seen < 5 UNION ALL
              SELECT *, 7, 'expected at most 25 player rows, found ' || rows FROM team_games WHERE rows > 25 UNION ALL
              SELECT *, 8, 'implausible total minutes ' || printf('%.1f', minutes) FROM team_games
              WHERE minutes < 220 OR minutes > 450))
          WHERE n = 1""",
    ),
    "key_differences": over(
        DEFECTIVE,
        _SIDES,
        select="""SELECT season, season_type, game_id, team_id, CASE WHEN games = 0 THEN 'players' ELSE 'games' END AS only_in
          FROM team_games WHERE games = 0 OR rows = 0""",
    ),
    "count_issues": over(
        DEFECTIVE,
        LOADS,
        """
declared AS (SELECT * FROM loads WHERE team_id <> 7),
found_games AS (SELECT team_id, season, season_type, count(*) AS n FROM bad_games GROUP BY ALL),
found_players AS (SELECT team_id, season, season_type, count(*) AS n FROM bad_players GROUP BY ALL),
stored AS (
  SELECT coalesce(g.team_id, p.team_id) AS team_id, coalesce(g.season, p.season) AS season,
    coalesce(g.season_type, p.season_type) AS season_type, coalesce(g.n, 0) AS games, coalesce(p.n, 0) AS players
  FROM found_games g FULL JOIN found_players p
    ON p.team_id = g.team_id AND p.season = g.season AND p.season_type = g.season_type),
compared AS (
  SELECT coalesce(d.team_id, s.team_id) AS team_id, coalesce(d.season, s.season) AS season,
    coalesce(d.season_type, s.season_type) AS season_type, d.team_id IS NOT NULL AS loaded,
    d.games_row_count, d.game_players_row_count, coalesce(games, 0) AS games, coalesce(players, 0) AS players
  FROM declared d FULL JOIN stored s ON s.team_id = d.team_id AND s.season = d.season AND s.season_type = d.season_type)""",
        select="""SELECT 'loads' AS "table",
            'team_id=' || team_id || ',season=''' || season || ''',season_type=''' || season_type || '''' AS key, message
          FROM (
            SELECT *, 'games_row_count does not match games count: ' || games_row_count || ' != ' || games AS message
            FROM compared WHERE loaded AND games_row_count <> games UNION ALL
            SELECT *, 'game_players_row_count does not match game_players count: ' || game_players_row_count
              || ' != ' || players FROM compared WHERE loaded AND game_players_row_count <> players UNION ALL
            SELECT *, 'missing load row for a stored scope' FROM compared WHERE NOT loaded)""",
    ),
    "team_history_issues": over(
        DIMENSION,
        select="""SELECT * FROM (
          SELECT 'team_history' AS "table", 'team_id=' || team_id || ',season=''' || start_year || '-'
              || substr(CAST(start_year + 1 AS VARCHAR), 3, 2) || '''' AS key,
            CASE WHEN team_id % 5 = 0 THEN 'abbreviation does not match the team history'
              WHEN abbreviation <> current_abbreviation THEN 'lookup_abbreviation does not match the current name'
              END AS message
          FROM dimension JOIN current_names USING (team_id)) WHERE message IS NOT NULL""",
    ),
    "issue_trends": over(
        *_ALL,
        select=r"""SELECT "table", signature, count(*) AS count, min((key, message))[1] AS example_key,
            min((key, message))[2] AS example_message
          FROM (
            SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(message, '''[^'']*''', '''<value>''', 'g'),
              '(^|[^A-Za-z0-9.<>-])-?\d+(?:\.\d+)?', '\1<num>', 'g'), '\s+', ' ', 'g')) AS signature
            FROM """
        + _UNION
        + """)
          GROUP BY "table", signature""",
    ),
    "issue_counts": over(
        *_ALL, select='SELECT "table", count(*) AS issues FROM ' + _UNION + ' GROUP BY "table"'
    ),
    "request_issues": over(
        WEIGHTS,
        select="""SELECT 'request' AS "table", 'season_id=''' || season_id || ''',player_id=' || player_id AS key,
            'unknown player' AS message FROM exposure WHERE player_id % 10 = 0""",
    ),
}
