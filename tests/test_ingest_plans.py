import duckdb
import pytest
from pyspark.sql import functions as F

from impactframe.plans import table_queries as T
from impactframe.sources import csv_files as C
from impactframe.sources import sample_tables as S


@pytest.fixture()
def folder(spark, tmp_path):
    """Orders of which some have no partner, no counted line or a partner of the same nation; player 5 has only such."""
    con = duckdb.connect()
    tables = {
        "customer": "SELECT i AS c_custkey, i % 3 AS c_nationkey FROM range(9) t(i)",
        "orders": """SELECT i AS o_orderkey, i % 9 AS o_custkey, 1000.0 * i AS o_totalprice, TIMESTAMP '1996-11-01' + to_days(CAST(i AS INT)) AS o_orderdate
                     FROM range(4, 1200) t(i) WHERE i % 50 <> 7""",
        "lineitem": """SELECT i // 3 AS l_orderkey, CASE WHEN i // 3 % 50 IN (6, 7) THEN 4 ELSE i * 7 % 4 + 10 * (i % 3) END AS l_suppkey, 1.0 * (i % 40) AS l_quantity,
                       CASE WHEN i % 5 = 0 THEN 'R' ELSE 'N' END AS l_returnflag FROM range(12, 3600) t(i)""",
    }
    for name, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    return str(tmp_path)


def test_games_with_players_are_the_views(spark, folder):
    games, players, ids = S.games_with_players(spark, folder)
    view, lineups = S.games_view(spark, folder), S.game_players_view(spark, folder)
    sides = view.select("game_id", "team_id", "is_home")
    expected = lineups.join(sides, ["game_id", "team_id"]).drop("player_name")
    columns = ["game_id", "team_id", "player_id", "is_home", "appeared", "minutes"]
    assert sorted(map(tuple, games.select(view.columns).collect())) == sorted(map(tuple, view.collect()))
    assert sorted(map(str, players.select(columns).collect())) == sorted(map(str, expected.select(columns).collect()))
    assert sorted(r.player_id for r in ids.collect()) == sorted(r.player_id for r in lineups.select("player_id").distinct().collect())
    assert 5 not in {r.player_id for r in ids.collect()} and not players.isEmpty()


def test_raw_games_are_written_once_twice_or_otherwise(spark, folder):
    raw, _, _ = T._raw_columns(spark, folder)
    rows = raw.select(F.col("gameId").cast("int").alias("g"), "homeScore").collect()
    found = {g: [r.homeScore for r in rows if r.g == g] for g in {r.g for r in rows}}
    for g, scores in found.items():
        assert len(scores) == 1 + (g % 29 == 0) + (g % 31 == 0) and scores.count("7") == (g % 31 == 0)
    # The orders and lines behind the games are read and shuffled once for all three.
    assert raw._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0


def test_rows_without_an_id_do_not_conflict(spark):
    rows = [("1", "a"), ("1", "a"), ("2", "a"), ("2", "b"), ("2", "b"), (None, "a"), (None, "a"), (None, "b"), ("3", None), ("3", None)]
    raw = spark.createDataFrame(rows, "gameId string, homeScore string")
    settled, conflicting = C.distinct_games(raw)
    assert sorted(map(str, map(tuple, settled.collect()))) == sorted(map(str, [("1", "a"), (None, "a"), (None, "b"), ("3", None)]))
    assert sorted(map(tuple, conflicting.collect())) == [("2", "a"), ("2", "b")]
    # One pass over the rows that have an id, one over those that have none.
    assert settled._jdf.queryExecution().executedPlan().toString().count("Join") == 0
