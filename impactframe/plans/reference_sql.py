"""The sample tables as ANSI SQL, for checking every query against another engine."""

from __future__ import annotations

BASE = """
line_totals AS (
  SELECT l_orderkey AS ok, l_suppkey + 1 AS player_id,
    max(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS appeared,
    sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity END) AS minutes
  FROM lineitem GROUP BY l_orderkey, l_suppkey),
played AS (SELECT ok FROM line_totals GROUP BY ok HAVING max(appeared) = 1),
sides AS (
  SELECT o_orderkey AS ok, CAST(floor(o_orderkey / 2) AS BIGINT) AS game_number,
    o_orderkey % 2 = 0 AS is_home, CAST(c_nationkey + 1 AS BIGINT) AS team_id,
    o_totalprice AS price, CAST(o_orderdate AS DATE) AS day
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN played ON played.ok = o_orderkey),
pairs AS (
  SELECT h.game_number, h.team_id AS ht, a.team_id AS awt, h.ok AS hok, a.ok AS aok, h.day AS day,
    CAST(floor((h.price - a.price) / 10000) AS DOUBLE) AS m,
    CASE WHEN month(h.day) >= 7 THEN year(h.day) ELSE year(h.day) - 1 END AS y
  FROM sides h JOIN sides a ON h.game_number = a.game_number AND h.is_home AND NOT a.is_home AND h.team_id <> a.team_id),
both_sides AS (
  SELECT game_number, y, day, ht AS team_id, awt AS opponent_team_id, TRUE AS is_home, m AS margin, hok AS ok FROM pairs
  UNION ALL
  SELECT game_number, y, day, awt, ht, FALSE, 0.0 - m, aok FROM pairs),
games AS (
  SELECT ok, CAST(game_number AS VARCHAR) AS game_id,
    CAST(y AS VARCHAR) || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS season,
    CAST(y AS VARCHAR) || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') || ':REGULAR' AS season_id,
    'Regular Season' AS season_type, day AS game_date, team_id, opponent_team_id, is_home, margin, 'orders' AS source
  FROM both_sides),
players AS (
  SELECT g.game_id, g.season, g.season_id, g.season_type, g.team_id, g.is_home, l.player_id,
    'Player ' || CAST(l.player_id AS VARCHAR) AS player_name, l.appeared = 1 AS appeared, l.minutes
  FROM games g JOIN line_totals l ON l.ok = g.ok)"""

WITH_WITHOUT = """
with_rows AS (
  SELECT p.season_id, p.season, p.season_type, p.team_id, p.player_id, count(*) AS n, sum(g.margin) AS m
  FROM players p JOIN games g ON g.game_id = p.game_id AND g.team_id = p.team_id
  WHERE p.appeared GROUP BY ALL),
team_rows AS (SELECT season_id, team_id, count(*) AS n, sum(margin) AS m FROM games GROUP BY ALL),
split AS (
  SELECT w.season_id, w.season, w.season_type, w.player_id, sum(w.n) AS gw, sum(t.n) - sum(w.n) AS go,
    sum(w.m) AS mw, sum(t.m) - sum(w.m) AS mo
  FROM with_rows w JOIN team_rows t ON t.season_id = w.season_id AND t.team_id = w.team_id GROUP BY ALL),
minute_rows AS (
  SELECT season_id, player_id, sum(minutes) AS total_minutes, count(*) AS n
  FROM players WHERE appeared AND minutes > 0 GROUP BY ALL),
margins AS (
  SELECT s.season_id, s.season, s.season_type, s.player_id, 'Player ' || CAST(s.player_id AS VARCHAR) AS player_name,
    CAST(gw AS BIGINT) AS games_with, CAST(go AS BIGINT) AS games_without,
    CASE WHEN gw > 0 THEN mw / gw END AS avg_margin_with, CASE WHEN go > 0 THEN mo / go END AS avg_margin_without,
    CASE WHEN gw > 0 AND go > 0 THEN mw / gw - mo / go END AS value,
    total_minutes / n AS average_minutes, total_minutes
  FROM split s LEFT JOIN minute_rows r ON r.season_id = s.season_id AND r.player_id = s.player_id),
kept AS (
  SELECT * FROM margins WHERE games_with >= 15 AND games_without >= 2 AND value IS NOT NULL
    AND average_minutes >= 20 AND total_minutes >= 600)"""

WEIGHTS = """
positive AS (SELECT * FROM players WHERE appeared AND minutes > 0),
team_minutes AS (SELECT game_id, team_id, sum(minutes) AS total FROM positive GROUP BY ALL),
obs AS (
  SELECT h.season_id, h.season, h.season_type, h.game_id, h.game_date, h.margin, h.team_id AS home_team_id,
    a.team_id AS away_team_id, th.total AS home_minutes, ta.total AS away_minutes
  FROM games h JOIN games a ON a.game_id = h.game_id AND h.is_home AND NOT a.is_home
  JOIN team_minutes th ON th.game_id = h.game_id AND th.team_id = h.team_id
  JOIN team_minutes ta ON ta.game_id = a.game_id AND ta.team_id = a.team_id),
weights AS (
  SELECT season_id, game_id, player_id, weight, minutes FROM (
    SELECT p.season_id, p.game_id, p.player_id, p.minutes,
      CASE WHEN p.is_home THEN 1 ELSE -1 END * (p.minutes / t.total * 5.0) AS weight,
      row_number() OVER (PARTITION BY p.game_id, p.player_id ORDER BY p.is_home) AS n
    FROM positive p JOIN team_minutes t ON t.game_id = p.game_id AND t.team_id = p.team_id
    WHERE p.game_id IN (SELECT game_id FROM obs))
  WHERE n = 1),
exposure AS (
  SELECT season_id, player_id, count(*) AS games, sum(minutes) AS minutes FROM weights GROUP BY ALL)"""


def over(*parts: str, select: str) -> str:
    """A query over the sample tables and any further named parts."""
    return "WITH " + ",".join([BASE, *parts]) + "\n" + select
