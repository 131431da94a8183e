import pytest
from builders import games, players
from pyspark.sql import functions as F

from impactframe.operators import leaderboard as L
from impactframe.operators import with_without as M
from impactframe.operators.ranking import average_ranks, positions

LINEUPS = {1: [101, 102, 103], 2: [102, 103, 104], 3: [103, 104, 105]}


def by_player(df):
    return {r["player_id"]: r for r in df.collect()}


def rotation(spark):
    g = games(spark, [(1, 1, 2, True, 10), (2, 1, 2, True, 0), (3, 1, 2, True, -10)])
    p = players(spark, [(n, 1, i, 30.0) for n, ids in LINEUPS.items() for i in ids])
    return g, p


def test_margin_with_and_without(spark):
    rows = by_player(M.with_without(*rotation(spark)))
    first = rows[101]
    assert (first.games_with, first.games_without) == (1, 2)
    assert (first.avg_margin_with, first.avg_margin_without, first.value) == (10.0, -5.0, 15.0)
    assert rows[103].games_without == 0
    assert rows[103].value is None


def test_only_the_teams_of_a_season_count(spark):
    g = games(
        spark,
        [(1, 1, 2, True, 10), (2, 1, 2, True, -5), (3, 2, 1, True, -20), (4, 1, 2, True, -30, "2023-24")],
    )
    p = players(
        spark,
        [(1, 1, 101, 30.0), (1, 1, 102, 30.0), (2, 1, 102, 30.0), (3, 2, 201, 30.0), (4, 1, 301, 30.0, "2023-24")],
    )
    row = by_player(M.with_without(g, p))[101]
    assert (row.games_with, row.games_without, row.value) == (1, 1, 15.0)


def test_a_traded_player_is_compared_with_both_teams(spark):
    g = games(spark, [(1, 1, 9, True, 4), (2, 1, 9, True, 8), (3, 2, 9, True, 1), (4, 2, 9, True, 3)])
    p = players(spark, [(1, 1, 7, 10.0), (3, 2, 7, 20.0), (2, 1, 8, 5.0), (4, 2, 8, 5.0)])
    row = by_player(M.with_without(g, p))[7]
    assert (row.games_with, row.games_without) == (2, 2)
    assert row.value == pytest.approx(2.5 - 5.5)
    assert (row.average_minutes, row.total_minutes) == (15.0, 30.0)


def test_brute_force(spark):
    import random

    rng = random.Random(3)
    g_rows, p_rows = [], []
    for n in range(60):
        team = n % 3 + 1
        g_rows.append((n, team, 9, True, rng.randint(-20, 20)))
        p_rows += [(n, team, i, float(rng.randint(1, 40))) for i in rng.sample(range(1, 12), 5)]
    got = by_player(M.with_without(games(spark, g_rows), players(spark, p_rows)))
    played = {(n, i) for n, _, i, _ in p_rows}
    for player in range(1, 12):
        teams = {t for n, t, i, _ in p_rows if i == player}
        with_ = [m for n, t, _, _, m in g_rows if (n, player) in played]
        without = [m for n, t, _, _, m in g_rows if t in teams and (n, player) not in played]
        row = got[player]
        assert (row.games_with, row.games_without) == (len(with_), len(without))
        assert row.value == pytest.approx(sum(with_) / len(with_) - sum(without) / len(without))


def test_eligibility(spark):
    rows = spark.createDataFrame(
        [(1, 3, 3, 1.0), (2, 1, 5, 1.0), (3, 4, 1, 1.0), (4, 9, 9, None)],
        "player_id int, games_with bigint, games_without bigint, value double",
    )
    assert [r.player_id for r in M.eligible_margins(rows, 2, 2).collect()] == [1]


def test_unknown_minutes_fail_even_a_zero_minimum(spark):
    rows = spark.createDataFrame([(1, None, None), (2, 0.0, 0.0)], "player_id int, average_minutes double, total_minutes double")
    assert [r.player_id for r in rows.filter(M.minute_filter(0.0, 0.0)).collect()] == [2]
    assert rows.filter(M.minute_filter(None, None)).count() == 2


def test_shrunk_score_keeps_the_margin(spark):
    g, p = rotation(spark)
    filters = {"min_games_with": 1, "min_games_without": 1, "min_average_minutes": 0, "min_total_minutes": 0}
    row = by_player(M.wowy_shrunk(g, p, **filters))[101]
    size = 4 / 3
    assert row.value == pytest.approx(15.0 * size / (size + 10))
    assert row.raw_wowy_score == 15.0


def span_rows(spark):
    data = [("2022-23", 101, 12.0), ("2023-24", 101, 2.0), ("2022-23", 102, -1.5), ("2023-24", 103, 6.5)]
    return spark.createDataFrame(data, "season string, player_id bigint, value double").select(
        F.concat("season", F.lit(":REGULAR")).alias("season_id"),
        "season",
        F.lit("Regular Season").alias("season_type"),
        "player_id",
        F.concat(F.lit("Player "), F.col("player_id").cast("string")).alias("player_name"),
        "value",
        F.lit(2).cast("bigint").alias("games_with"),
        F.lit(1).cast("bigint").alias("games_without"),
        F.lit(1.0).alias("avg_margin_with"),
        F.lit(0.0).alias("avg_margin_without"),
        F.lit(20.0).alias("average_minutes"),
        F.lit(40.0).alias("total_minutes"),
    )


def test_leaderboard_divides_by_the_whole_span(spark):
    board = L.leaderboard(span_rows(spark), "wowy", 2).collect()
    assert [(r["rank"], r.player_id, r.span_average_value) for r in sorted(board, key=lambda r: r["rank"])] == [
        (1, 101, 7.0),
        (2, 103, 3.25),
    ]
    third = by_player(L.full_leaderboard(span_rows(spark), "wowy"))[103]
    assert [(p.season, p.value) for p in third.points] == [("2022-23", None), ("2023-24", 6.5)]
    assert by_player(L.full_leaderboard(span_rows(spark), "wowy"))[102]["rank"] == 3
    assert L.leaderboard(span_rows(spark), "wowy", 0).count() == 0


def test_full_span_series_divides_by_season_ids(spark):
    ids = ["2022-23:REGULAR", "2023-24:REGULAR", "2024-25:REGULAR"]
    rows = by_player(L.full_span_series(span_rows(spark), ids, "value"))
    assert rows[101].span_average_value == pytest.approx(14 / 3)
    assert [(p.season_id, p.value) for p in rows[103].points_by_season] == [("2023-24:REGULAR", 6.5)]
    assert rows[102].rank_order == 3


def test_export_text(spark):
    values = [(1, 1234567.0), (2, 0.00001234), (3, 12.5), (4, 0.0), (5, None), (6, -3.14159265), (7, 999999.5)]
    df = spark.createDataFrame(values, "rank bigint, span_average_value double")
    got = {r["Rank"]: r["WOWY"] for r in L.export_columns(df, "wowy").collect()}
    expected = {str(n): "—" if v is None else f"{v:.6g}" for n, v in values}
    assert got == expected


def test_export_csv_has_headings_and_points(spark, tmp_path):
    L.export_csv(L.full_leaderboard(span_rows(spark), "wowy"), "wowy", str(tmp_path / "board"))
    back = spark.read.csv(str(tmp_path / "board"), header=True, escape='"')
    assert back.columns[:4] == ["Rank", "Player ID", "Player", "WOWY"]
    assert '{"season":"2022-23","value":null}' in back.filter("`Player ID` = 103").first()["Points"]


def test_positions_over_one_large_group(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), F.lit("hot").alias("k"))
    got = positions(df, ["k"], [F.asc("v")], "n").collect()
    assert len(got) == 5000
    assert all(r.n == r.v + 1 for r in got)


def test_average_ranks_of_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 5.0), ("b", 3.0)], "k string, v double")
    got = sorted((r.k, r.v, r.r) for r in average_ranks(df, ["k"], "v", "r").collect())
    assert got == [("a", 1.0, 1.0), ("a", 2.0, 2.5), ("a", 2.0, 2.5), ("a", 5.0, 4.0), ("b", 3.0, 1.0)]
