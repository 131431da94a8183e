"""Registered queries: ridge regression, its parts, tuning and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from impactframe.operators import leaderboard as L
from impactframe.operators import ridge as R
from impactframe.operators import tuning as T
from impactframe.operators import with_without as M
from impactframe.operators.ranking import average_ranks
from impactframe.plans.margin_queries import MINUTES, rounded, tables
from impactframe.plans.reference_sql import WEIGHTS, WITH_WITHOUT, over
from impactframe.plans.ridge_sql import KIND, RIDGE_ROWS, fitted
from impactframe.session import keep

TRAIN = ["1995-96", "1996-97", "1997-98"]
HOLDOUT = "1998-99"
MODES = [R.Setting(10.0, "uniform"), R.Setting(10.0, "game-count", 1.0), R.Setting(10.0, "minutes", 0.5, 240.0)]

GRID = T.setting_grid([1.0, 3.0, 10.0, 30.0], None, [0.0, 0.5, 1.0], [48.0, 240.0])
ALPHAS = [1.0, 10.0, 100.0]


def _parts(spark, folder):
    games, players = tables(spark, folder)
    obs = R.observations(games, players)
    return obs, R.exposure_weights(obs, players)


def ridge_observations(spark, folder):
    obs, _ = _parts(spark, folder)
    return obs.withColumn("game_date", F.col("game_date").cast("string"))


def observation_issues(spark, folder):
    games, players = tables(spark, folder)
    # Drop the away rows of every 89th game and the players of every 101st.
    number = F.col("game_id").cast("bigint")
    return R.observation_issues(games.filter(F.col("is_home") | (number % 89 != 0)), players.filter(number % 101 != 0))


def ridge_exposure_weights(spark, folder):
    return rounded(_parts(spark, folder)[1])


def ridge_player_exposure(spark, folder):
    return R.player_exposure(_parts(spark, folder)[1])


def ridge_gram(spark, folder):
    gram, _ = R.normal_equations(*_parts(spark, folder))
    return rounded(gram).filter("value <> 0")


def ridge_target(spark, folder):
    _, target = R.normal_equations(*_parts(spark, folder))
    return rounded(target)


def ridge_penalties(spark, folder):
    _, weights = _parts(spark, folder)
    exposure = R.eligible(R.player_exposure(weights), 35)
    return rounded(R.penalties(exposure, MODES).withColumn("setting_id", F.col("setting_id").cast("bigint")))


def ridge_coefficients(spark, folder):
    obs, weights = _parts(spark, folder)
    return rounded(R.fit(obs, weights, MODES, min_games=35))


def ridge_residual(spark, folder):
    """How far the coefficients are from solving (gram + penalty) x = target; zero up to rounding."""
    obs, weights = _parts(spark, folder)
    weights = keep(weights)
    setting = R.Setting(10.0, "minutes", 0.5, 240.0)
    solved = R.fit(obs, weights, [setting])
    kinds = F.create_map(*[F.lit(v) for kind, code in R.KINDS.items() for v in (kind, code)])
    code = F.coalesce(F.col("entity_id") * 8, F.lit(0)) + F.element_at(kinds, F.col("kind"))
    solved = solved.select("season_id", code.alias("code"), "kind", "coefficient")
    gram, target = R.normal_equations(obs, weights)
    upper = gram.select("season_id", F.col("code_1").alias("row"), F.col("code_2").alias("code"), "value")
    lower = gram.filter("code_1 <> code_2").select(
        "season_id", F.col("code_2").alias("row"), F.col("code_1").alias("code"), "value"
    )
    product = upper.unionByName(lower).join(solved, ["season_id", "code"]).select(
        "season_id", F.col("row").alias("code"), (F.col("value") * F.col("coefficient")).alias("part")
    )
    penalty = R.penalties(R.player_exposure(weights), [setting])
    by_kind = F.when(F.col("kind").isin("team", "opponent"), F.lit(setting.alpha)).otherwise(F.lit(0.0))
    shrink = solved.join(penalty, ["season_id", "code"], "left").select(
        "season_id", "code", (F.coalesce("penalty", by_kind) * F.col("coefficient")).alias("part")
    )
    left = target.select("season_id", "code", (-F.col("value")).alias("part"))
    sums = product.unionByName(shrink).unionByName(left).groupBy("season_id", "code").agg(F.sum("part").alias("gap"))
    return rounded(
        sums.groupBy("season_id").agg(F.count("*").alias("columns"), F.max(F.abs("gap")).alias("largest_gap")), 4
    )


def ridge_player_season(spark, folder):
    rows = R.ridge(*tables(spark, folder), **MINUTES)
    return rounded(rows.drop("setting_id"))


def ridge_leaderboard(spark, folder):
    board = L.leaderboard(R.ridge(*tables(spark, folder), **MINUTES), "ridge", 30)
    return rounded(board.drop("points"))


def ridge_points(spark, folder):
    board = L.leaderboard(R.ridge(*tables(spark, folder), **MINUTES), "ridge", 30)
    return rounded(L.series_points(board))


def ridge_model_terms(spark, folder):
    obs, weights = _parts(spark, folder)
    return rounded(R.model_terms(R.fit(obs, weights, [R.Setting()], min_games=35)).drop("setting_id"))


def ridge_tuning(spark, folder):
    obs, weights = _parts(spark, folder)
    return rounded(T.tune_ridge(obs, weights, ALPHAS, min_games=35))


def setting_comparison(spark, folder):
    games, players = tables(spark, folder)
    results = T.compare_settings(games, players, train=TRAIN, holdout=HOLDOUT, settings=GRID, **MINUTES)
    return rounded(results)


def time_split(spark, folder):
    obs, _ = _parts(spark, folder)
    return T.time_split(obs).select("season_id", "game_id", "is_validation")


def _scores(spark, folder):
    games, players = tables(spark, folder)
    return M.wowy(games, players, **MINUTES)


def _training(aggregation):
    def query(spark, folder):
        rows = _scores(spark, folder).filter(F.col("season").isin(TRAIN))
        return rounded(T.training_scores(rows, "value", aggregation))

    return query


def rank_average(spark, folder):
    # Whole games played make many ties.
    rows = _scores(spark, folder).select("season_id", "player_id", "games_with")
    return rounded(average_ranks(rows, ["season_id"], "games_with", "rank"))


def _season_pairs(spark, folder):
    """Each player's training mean against the held-out value."""
    rows = keep(_scores(spark, folder))
    train = T.training_scores(rows.filter(F.col("season").isin(TRAIN)), "value", "mean").withColumn("model", F.lit("wowy"))
    holdout = rows.filter(F.col("season") == HOLDOUT).select(
        "player_id", F.col("player_name").alias("target_name"), F.col("value").alias("target")
    )
    return train.join(holdout, "player_id")


def train_holdout_correlation(spark, folder):
    return rounded(T.correlations(_season_pairs(spark, folder), ["model"], "value", "target"))


def top_n_overlap(spark, folder):
    return T.top_overlap(_season_pairs(spark, folder), ["model"], 20)


QUERIES = {
    "ridge_observations": ridge_observations,
    "observation_issues": observation_issues,
    "ridge_exposure_weights": ridge_exposure_weights,
    "ridge_player_exposure": ridge_player_exposure,
    "ridge_gram": ridge_gram,
    "ridge_target": ridge_target,
    "ridge_penalties": ridge_penalties,
    "ridge_coefficients": ridge_coefficients,
    "ridge_residual": ridge_residual,
    "ridge_player_season": ridge_player_season,
    "ridge_leaderboard": ridge_leaderboard,
    "ridge_points": ridge_points,
    "ridge_model_terms": ridge_model_terms,
    "ridge_tuning": ridge_tuning,
    "setting_comparison": setting_comparison,
    "time_split": time_split,
    "training_mean": _training("mean"),
    "training_max": _training("max"),
    "training_latest": _training("latest"),
    "rank_average": rank_average,
    "train_holdout_correlation": train_holdout_correlation,
    "top_n_overlap": top_n_overlap,
}

_ENTRIES = """
entries AS (
  SELECT o.season_id, o.game_id, s.s AS mirror, s.s * o.margin AS y, c.code, c.x
  FROM obs o, (VALUES (1.0::DOUBLE), (-1.0::DOUBLE)) s(s),
    LATERAL (VALUES (CAST(0 AS BIGINT), 1.0::DOUBLE), (CAST(1 AS BIGINT), s.s),
      ((CASE WHEN s.s > 0 THEN o.home_team_id ELSE o.away_team_id END) * 8 + 3, 1.0::DOUBLE),
      ((CASE WHEN s.s > 0 THEN o.away_team_id ELSE o.home_team_id END) * 8 + 4, 1.0::DOUBLE)) c(code, x)
  UNION ALL
  SELECT o.season_id, o.game_id, s.s, s.s * o.margin, w.player_id * 8 + 2, s.s * w.weight
  FROM weights w JOIN obs o ON o.game_id = w.game_id, (VALUES (1.0::DOUBLE), (-1.0::DOUBLE)) s(s))"""

_PAIRS = """
train AS (
  SELECT player_id, max(player_name) AS player_name, avg(value) AS value FROM kept
  WHERE season IN ('1995-96', '1996-97', '1997-98') GROUP BY player_id),
shared AS (
  SELECT t.player_id, t.player_name, t.value, k.value AS target, k.player_name AS target_name
  FROM train t JOIN kept k ON k.player_id = t.player_id WHERE k.season = '1998-99'),
ranked AS (
  SELECT *, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS rx,
    rank() OVER (ORDER BY target) + (count(*) OVER (PARTITION BY target) - 1) / 2.0::DOUBLE AS ry
  FROM shared)"""


_RIDGE_BOARD = """
span AS (SELECT DISTINCT season FROM ridge_rows),
board AS (
  SELECT player_id, max(player_name) AS player_name, sum(coefficient) / (SELECT count(*) FROM span) AS span_average_value,
    sum(total_minutes) / sum(games) AS average_minutes, sum(total_minutes) AS total_minutes,
    CAST(sum(games) AS BIGINT) AS games, count(*) AS season_count
  FROM ridge_rows GROUP BY player_id),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY span_average_value DESC, player_name DESC, player_id) AS rank FROM board),
top AS (SELECT * FROM ranked WHERE rank <= 30)"""

_SPLIT = """
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY season_id ORDER BY game_date, game_id)
      > count(*) OVER (PARTITION BY season_id)
        - greatest(1, CAST(floor(count(*) OVER (PARTITION BY season_id) * 0.2::DOUBLE) AS BIGINT)) AS held
  FROM obs),
train_obs AS (SELECT * FROM ordered WHERE NOT held),
train_weights AS (SELECT * FROM weights WHERE game_id IN (SELECT game_id FROM train_obs))"""

_VALIDATION = """
terms AS (
  SELECT o.season_id, o.game_id, c.code, 1.0::DOUBLE AS x FROM ordered o,
    LATERAL (VALUES (CAST(0 AS BIGINT)), (CAST(1 AS BIGINT)), (o.home_team_id * 8 + 3), (o.away_team_id * 8 + 4)) c(code) WHERE o.held
  UNION ALL
  SELECT w.season_id, w.game_id, w.player_id * 8 + 2, w.weight FROM weights w
  WHERE w.game_id IN (SELECT game_id FROM ordered WHERE held)),
guessed AS (
  SELECT t.season_id, t.game_id, f.setting_id, sum(t.x * f.coefficient) AS guess
  FROM terms t JOIN fitted f ON f.season_id = t.season_id AND f.code = t.code GROUP BY ALL),
errors AS (
  SELECT g.season_id, g.setting_id, avg(pow(g.guess - o.margin, 2)) AS mse, count(*) AS n
  FROM guessed g JOIN obs o ON o.game_id = g.game_id GROUP BY ALL)"""

_COMPARISON = """
scored AS (
  SELECT -1 AS setting_id, player_id, max(player_name) AS player_name, avg(value) AS value FROM kept
  WHERE season IN ('1995-96', '1996-97', '1997-98') GROUP BY player_id
  UNION ALL
  SELECT setting_id, player_id, max(player_name), avg(coefficient) FROM ridge_rows GROUP BY setting_id, player_id),
aimed AS (SELECT player_id, player_name AS target_name, value AS target FROM kept WHERE season = '1998-99'),
shared AS (SELECT s.*, a.target, a.target_name FROM scored s JOIN aimed a ON a.player_id = s.player_id),
ranked AS (
  SELECT *, rank() OVER (PARTITION BY setting_id ORDER BY value) + (count(*) OVER (PARTITION BY setting_id, value) - 1) / 2.0::DOUBLE AS rx,
    rank() OVER (PARTITION BY setting_id ORDER BY target) + (count(*) OVER (PARTITION BY setting_id, target) - 1) / 2.0::DOUBLE AS ry,
    row_number() OVER (PARTITION BY setting_id ORDER BY value DESC, player_name DESC, player_id) AS a,
    row_number() OVER (PARTITION BY setting_id ORDER BY target DESC, target_name DESC, player_id) AS b
  FROM shared),
told AS (
  SELECT setting_id, 'ridge' AS model, alpha, mode, strength, CASE WHEN mode = 'minutes' THEN scale END AS minute_scale FROM chosen
  UNION ALL SELECT -1, 'wowy-baseline', NULL, NULL, NULL, NULL)"""


def _training_sql(value: str) -> str:
    return over(
        WITH_WITHOUT,
        select=f"""SELECT player_id, arg_max(player_name, season_id) AS player_name, round({value}, 6) AS value,
          count(*) AS season_count FROM kept WHERE season IN ('1995-96', '1996-97', '1997-98') GROUP BY player_id""",
    )


ORACLES = {
    "ridge_observations": over(
        WEIGHTS,
        select="""SELECT season_id, season, season_type, game_id, CAST(game_date AS VARCHAR) AS game_date, margin,
          home_team_id, away_team_id, home_minutes, away_minutes FROM obs""",
    ),
    "observation_issues": over(
        select="""SELECT 'games' AS "table", 'game_id=' || game_id AS key,
          CASE WHEN n <> 2 THEN 'expected two team rows, found ' || n
               WHEN home IS NULL THEN 'no home player with positive minutes'
               ELSE 'no away player with positive minutes' END AS message
          FROM (
            SELECT g.game_id, count(*) AS n, max(CASE WHEN g.is_home THEN t.total END) AS home,
              max(CASE WHEN NOT g.is_home THEN t.total END) AS away
            FROM games g LEFT JOIN (
              SELECT game_id, team_id, sum(minutes) AS total FROM players
              WHERE appeared AND minutes > 0 AND CAST(game_id AS BIGINT) % 101 <> 0 GROUP BY ALL) t
            ON t.game_id = g.game_id AND t.team_id = g.team_id
            WHERE g.is_home OR CAST(g.game_id AS BIGINT) % 89 <> 0
            GROUP BY g.game_id)
          WHERE n <> 2 OR home IS NULL OR away IS NULL"""
    ),
    "ridge_exposure_weights": over(
        WEIGHTS, select="SELECT season_id, game_id, player_id, round(weight, 6) AS weight, minutes FROM weights"
    ),
    "ridge_player_exposure": over(WEIGHTS, select="SELECT season_id, player_id, games, minutes FROM exposure"),
    "ridge_gram": over(
        WEIGHTS,
        _ENTRIES,
        select="""SELECT season_id, code_1, code_2, value + 0.0 AS value FROM (
            SELECT a.season_id, a.code AS code_1, b.code AS code_2, round(sum(a.x * b.x), 6) AS value
            FROM entries a JOIN entries b ON b.game_id = a.game_id AND b.mirror = a.mirror AND a.code <= b.code
            GROUP BY ALL)
          WHERE value <> 0""",
    ),
    "ridge_target": over(
        WEIGHTS,
        _ENTRIES,
        select="SELECT season_id, code, round(sum(x * y), 6) + 0.0 AS value FROM entries GROUP BY ALL",
    ),
    "ridge_penalties": over(
        WEIGHTS,
        select="""SELECT season_id, setting_id, player_id * 8 + 2 AS code, round(penalty, 6) AS penalty FROM (
            SELECT *, CAST(0 AS BIGINT) AS setting_id, 10.0::DOUBLE AS penalty FROM exposure UNION ALL
            SELECT *, 1, 10.0::DOUBLE / games FROM exposure UNION ALL
            SELECT *, 2, 10.0::DOUBLE / sqrt(minutes / 240.0) FROM exposure)
          WHERE games >= 35""",
    ),
    "ridge_residual": over(
        WEIGHTS,
        select="""SELECT season_id, 2 + count(DISTINCT player_id) + 2 * (
            SELECT count(DISTINCT team_id) FROM games g WHERE g.season_id = e.season_id
              AND g.game_id IN (SELECT game_id FROM obs)) AS columns, 0.0::DOUBLE AS largest_gap
          FROM exposure e GROUP BY season_id""",
    ),
    "ridge_coefficients": fitted(
        settings=MODES,
        select=f"""SELECT season_id, CAST(setting_id AS INTEGER) AS setting_id, {KIND} AS kind,
          CASE WHEN code % 8 > 1 THEN code // 8 END AS entity_id, round(coefficient, 6) + 0.0 AS coefficient FROM fitted""",
    ),
    "ridge_model_terms": fitted(
        settings=[R.Setting()],
        select=f"""SELECT season_id, {KIND} AS kind, CASE WHEN code % 8 > 1 THEN code // 8 END AS entity_id,
          round(coefficient, 6) + 0.0 AS coefficient FROM fitted WHERE code % 8 <> 2""",
    ),
    "ridge_player_season": fitted(
        RIDGE_ROWS,
        settings=[R.Setting()],
        select="""SELECT season_id, season, season_type, player_id, player_name, round(coefficient, 6) + 0.0 AS coefficient,
          games, round(average_minutes, 6) AS average_minutes, total_minutes FROM ridge_rows""",
    ),
    "ridge_leaderboard": fitted(
        RIDGE_ROWS,
        _RIDGE_BOARD,
        settings=[R.Setting()],
        select="""SELECT rank, player_id, player_name, round(span_average_value, 6) AS span_average_value,
          round(average_minutes, 6) AS average_minutes, total_minutes, games, season_count FROM top""",
    ),
    "ridge_points": fitted(
        RIDGE_ROWS,
        _RIDGE_BOARD,
        settings=[R.Setting()],
        select="""SELECT t.rank, t.player_id, s.season, round(k.coefficient, 6) + 0.0 AS value
          FROM top t CROSS JOIN span s LEFT JOIN ridge_rows k ON k.player_id = t.player_id AND k.season = s.season""",
    ),
    "ridge_tuning": fitted(
        _VALIDATION,
        settings=[R.Setting(a) for a in ALPHAS],
        games="train_obs",
        shares="train_weights",
        before=(_SPLIT,),
        select="""SELECT e.season_id, CAST(e.setting_id AS INTEGER) AS setting_id, c.alpha, e.n AS validation_games,
          round(e.mse, 6) AS validation_mse,
          row_number() OVER (PARTITION BY e.season_id ORDER BY e.mse, e.setting_id) = 1 AS is_best
          FROM errors e JOIN chosen c ON c.setting_id = e.setting_id""",
    ),
    "setting_comparison": fitted(
        WITH_WITHOUT,
        RIDGE_ROWS,
        _COMPARISON,
        settings=GRID,
        games="train_obs",
        shares="train_weights",
        before=(
            """
train_obs AS (SELECT * FROM obs WHERE season IN ('1995-96', '1996-97', '1997-98')),
train_weights AS (SELECT * FROM weights WHERE game_id IN (SELECT game_id FROM train_obs))""",
        ),
        select="""SELECT CAST(t.setting_id AS INTEGER) AS setting_id, t.model, t.alpha, t.mode, t.strength, t.minute_scale,
          coalesce(n, 0) AS players, round(pearson, 6) + 0.0 AS pearson, round(spearman, 6) + 0.0 AS spearman,
          coalesce(overlap, 0) AS top_n_overlap
          FROM told t LEFT JOIN (
            SELECT setting_id, count(*) AS n, corr(value, target) AS pearson, corr(rx, ry) AS spearman,
              count(*) FILTER (WHERE a <= 20 AND b <= 20) AS overlap
            FROM ranked GROUP BY setting_id) r ON r.setting_id = t.setting_id""",
    ),
    "time_split": over(
        WEIGHTS,
        select="""SELECT season_id, game_id,
            row_number() OVER (PARTITION BY season_id ORDER BY game_date, game_id)
              > count(*) OVER (PARTITION BY season_id)
                - greatest(1, CAST(floor(count(*) OVER (PARTITION BY season_id) * 0.2::DOUBLE) AS BIGINT)) AS is_validation
          FROM obs""",
    ),
    "training_mean": _training_sql("avg(value)"),
    "training_max": _training_sql("max(value)"),
    "training_latest": _training_sql("arg_max(value, season)"),
    "rank_average": over(
        WITH_WITHOUT,
        select="""SELECT season_id, player_id, games_with,
            rank() OVER (PARTITION BY season_id ORDER BY games_with)
              + (count(*) OVER (PARTITION BY season_id, games_with) - 1) / 2.0::DOUBLE AS rank
          FROM kept""",
    ),
    "train_holdout_correlation": over(
        WITH_WITHOUT,
        _PAIRS,
        select="""SELECT 'wowy' AS model, count(*) AS players, round(corr(value, target), 6) AS pearson,
          round(corr(rx, ry), 6) AS spearman FROM ranked""",
    ),
    "top_n_overlap": over(
        WITH_WITHOUT,
        _PAIRS,
        select="""SELECT 'wowy' AS model, count(*) AS top_n_overlap FROM (
            SELECT row_number() OVER (ORDER BY value DESC, player_name DESC, player_id) AS a,
              row_number() OVER (ORDER BY target DESC, target_name DESC, player_id) AS b FROM shared)
          WHERE a <= 20 AND b <= 20""",
    ),
}
