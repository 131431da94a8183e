"""Ridge fits in SQL: normal equations as lists of rows, eliminated column by column in a recursive query."""

from __future__ import annotations

from impactframe.operators.ridge import Setting
from impactframe.plans.reference_sql import BASE, WEIGHTS


def _setting_rows(settings: list[Setting]) -> str:
    rows = [f"({i}, {s.alpha!r}::DOUBLE, '{s.mode}', {s.strength!r}::DOUBLE, {s.minute_scale!r}::DOUBLE)" for i, s in enumerate(settings)]
    return ", ".join(rows)


def fit_parts(settings: list[Setting], min_games: int, games: str = "obs", shares: str = "weights") -> str:
    """``fitted`` (season_id, setting_id, code, coefficient) of the observations and weights of these names."""
    return f"""
chosen(setting_id, alpha, mode, strength, scale) AS (VALUES {_setting_rows(settings)}),
seen AS (
  SELECT season_id, player_id, count(*) AS games, sum(minutes) AS minutes FROM {shares} GROUP BY ALL HAVING count(*) >= {min_games}),
cell AS (
  SELECT o.season_id, o.game_id, s.s AS mirror, s.s * o.margin AS y, c.code, c.x
  FROM {games} o, (VALUES (1.0::DOUBLE), (-1.0::DOUBLE)) s(s),
    LATERAL (VALUES (CAST(0 AS BIGINT), 1.0::DOUBLE), (CAST(1 AS BIGINT), s.s),
      ((CASE WHEN s.s > 0 THEN o.home_team_id ELSE o.away_team_id END) * 8 + 3, 1.0::DOUBLE),
      ((CASE WHEN s.s > 0 THEN o.away_team_id ELSE o.home_team_id END) * 8 + 4, 1.0::DOUBLE)) c(code, x)
  UNION ALL
  SELECT o.season_id, o.game_id, s.s, s.s * o.margin, w.player_id * 8 + 2, s.s * w.weight
  FROM {shares} w JOIN {games} o ON o.game_id = w.game_id
    JOIN seen e ON e.season_id = w.season_id AND e.player_id = w.player_id, (VALUES (1.0::DOUBLE), (-1.0::DOUBLE)) s(s)),
place AS (
  SELECT season_id, code, row_number() OVER (PARTITION BY season_id ORDER BY code) AS pos, count(*) OVER (PARTITION BY season_id) AS p
  FROM (SELECT DISTINCT season_id, code FROM cell) WHERE season_id IN (SELECT season_id FROM seen)),
product AS (
  SELECT a.season_id, a.code AS c1, b.code AS c2, sum(a.x * b.x) AS v
  FROM cell a JOIN cell b ON b.season_id = a.season_id AND b.game_id = a.game_id AND b.mirror = a.mirror GROUP BY ALL),
aim AS (SELECT season_id, code, sum(x * y) AS v FROM cell GROUP BY ALL),
penalty AS (
  SELECT c.season_id, s.setting_id, c.code, c.pos, c.p,
    CASE WHEN c.code % 8 <= 1 THEN 0.0::DOUBLE WHEN c.code % 8 > 2 OR s.mode = 'uniform' THEN s.alpha
         WHEN s.mode = 'game-count' THEN s.alpha / pow(e.games, s.strength)
         ELSE s.alpha / pow(e.minutes / s.scale, s.strength) END AS v
  FROM place c CROSS JOIN chosen s LEFT JOIN seen e ON e.season_id = c.season_id AND c.code = e.player_id * 8 + 2),
line AS (
  SELECT r.season_id, r.setting_id, r.pos, r.p,
    list_append(list(coalesce(g.v, 0.0::DOUBLE) + CASE WHEN c.pos = r.pos THEN r.v ELSE 0.0::DOUBLE END ORDER BY c.pos), any_value(y.v)) AS cells
  FROM penalty r JOIN place c ON c.season_id = r.season_id
    LEFT JOIN product g ON g.season_id = r.season_id AND g.c1 = r.code AND g.c2 = c.code
    JOIN aim y ON y.season_id = r.season_id AND y.code = r.code
  GROUP BY r.season_id, r.setting_id, r.pos, r.p),
reduced(season_id, setting_id, k, p, m) USING KEY (season_id, setting_id) AS (
  SELECT season_id, setting_id, CAST(1 AS BIGINT), p, list(cells ORDER BY pos) FROM line GROUP BY season_id, setting_id, p
  UNION
  SELECT season_id, setting_id, k + 1, p, list_transform(m, lambda r, i: CASE
    WHEN i = k THEN list_transform(r[2:], lambda v: v / r[1])
    ELSE list_transform(list_zip(r[2:], m[k][2:]), lambda z: z[1] - r[1] / m[k][1] * z[2]) END)
  FROM reduced WHERE k <= p),
fitted AS (
  SELECT f.season_id, f.setting_id, c.code, f.m[c.pos][1] AS coefficient FROM reduced f JOIN place c ON c.season_id = f.season_id)"""


#: Names and minutes over the observed games, and the player-season rows that pass the minimums of the queries.
RIDGE_ROWS = """
context AS (
  SELECT p.season_id, p.season, p.season_type, p.player_id, max(p.player_name) AS player_name,
    sum(p.minutes) AS total_minutes, sum(p.minutes) / count(*) AS average_minutes
  FROM positive p WHERE p.game_id IN (SELECT game_id FROM obs) GROUP BY ALL),
ridge_rows AS (
  SELECT f.setting_id, c.*, f.coefficient, e.games
  FROM fitted f JOIN context c ON c.season_id = f.season_id AND f.code = c.player_id * 8 + 2
    JOIN exposure e ON e.season_id = c.season_id AND e.player_id = c.player_id
  WHERE c.average_minutes >= 20 AND c.total_minutes >= 600)"""

KIND = "CASE code % 8 WHEN 0 THEN 'intercept' WHEN 1 THEN 'home_court' WHEN 2 THEN 'player' WHEN 3 THEN 'team' ELSE 'opponent' END"


def fitted(*parts: str, settings: list[Setting], select: str, min_games: int = 35, games: str = "obs", shares: str = "weights", before: tuple[str, ...] = ()) -> str:
    """A query over the fits of the sample tables and any further named parts."""
    return "WITH RECURSIVE " + ",".join([BASE, WEIGHTS, *before, fit_parts(settings, min_games, games, shares), *parts]) + "\n" + select
