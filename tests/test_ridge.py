import datetime as dt

import numpy as np
import pytest
from builders import games, players
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from impactframe.operators import block_solve as S
from impactframe.operators import gram as G
from impactframe.operators import ridge as R
from impactframe.operators import tuning as T

BOS, MIL, NYK, LAL = 1, 2, 3, 4


def two_sides(rows):
    out = []
    for game, home, away, margin, *day in rows:
        out += [(game, home, away, True, margin, *day), (game, away, home, False, -margin, *day)]
    return out


def sample(spark, rows):
    """Observations and unit weights: rows of (game, home, away, margin, home players, away players)."""
    g = games(spark, two_sides([r[:4] for r in rows]))
    p = players(
        spark,
        [(r[0], r[1], i, 48.0) for r in rows for i in r[4]] + [(r[0], r[2], i, 48.0) for r in rows for i in r[5]],
    )
    obs = R.observations(g, p)
    # The expected values are for plain +1/-1 lineups.
    weights = R.exposure_weights(obs, p).withColumn("weight", F.signum("weight"))
    return obs, weights


def terms(df):
    return {(r.kind, r.entity_id): r.coefficient for r in df.collect()}


THREE = [
    ("g1", BOS, MIL, 2, [101], [201]),
    ("g2", NYK, BOS, -2, [202], [102]),
    ("g3", BOS, LAL, 0, [101, 102], [201, 202]),
]


def test_fit_of_three_games(spark):
    got = terms(R.fit(*sample(spark, THREE), [R.Setting(1.0)]))
    assert got["intercept", None] == pytest.approx(0.0, abs=1e-9)
    assert got["home_court", None] == pytest.approx(-0.967742, abs=1e-6)
    assert got["player", 101] == pytest.approx(0.580645, abs=1e-6)
    assert got["player", 201] == pytest.approx(-0.580645, abs=1e-6)
    assert got["player", 102] == pytest.approx(-0.064516, abs=1e-6)
    assert got["player", 202] == pytest.approx(0.064516, abs=1e-6)
    assert got["team", BOS] == pytest.approx(0.580645, abs=1e-6)
    assert got["opponent", BOS] == pytest.approx(-0.580645, abs=1e-6)


@pytest.mark.parametrize("players", [6, 1500])
def test_narrow_and_wide_systems_alike(players):
    rng = np.random.default_rng(players)
    x = rng.normal(size=(2 * players, players))
    matrix, target = x.T @ x, rng.normal(size=players)
    assert np.allclose(S.solve_system(matrix, target), np.linalg.solve(matrix, target), rtol=1e-9, atol=1e-12)
    x[:, 1] = x[:, 0]
    assert S.solve_system(x.T @ x, target) is None


def test_home_term_alone(spark):
    rows = [("g1", BOS, MIL, 2, [101], [201]), ("g2", MIL, BOS, 3, [201], [101])]
    got = terms(R.fit(*sample(spark, rows), [R.Setting(1.0)]))
    assert got.pop(("home_court", None)) == pytest.approx(2.5)
    # Each side wins at home by a little more or less; what is left cancels in the pairs.
    assert got["intercept", None] == pytest.approx(0.0, abs=1e-9)


def test_unpenalised_fit_is_singular(spark):
    rows = [("g1", BOS, MIL, 2, [101], [201]), ("g2", BOS, MIL, 3, [101], [201])]
    with pytest.raises(PythonException, match="singular"):
        R.fit(*sample(spark, rows), [R.Setting(0.0)]).collect()


def test_exposure_shares(spark):
    g = games(spark, two_sides([("g1", BOS, MIL, 5)]))
    p = players(spark, [("g1", BOS, 101, 30.0), ("g1", BOS, 103, 18.0), ("g1", BOS, 102, None), ("g1", MIL, 201, 24.0), ("g1", MIL, 202, 24.0)])
    obs = R.observations(g, p)
    got = {r.player_id: r.weight for r in R.exposure_weights(obs, p).collect()}
    assert got == {101: 3.125, 103: 1.875, 201: -2.5, 202: -2.5}


def test_player_on_both_sides_counts_as_visitor(spark):
    g = games(spark, two_sides([("g1", BOS, MIL, 5)]))
    p = players(spark, [("g1", BOS, 7, 10.0), ("g1", BOS, 8, 10.0), ("g1", MIL, 7, 40.0)])
    obs = R.observations(g, p)
    got = {r.player_id: (r.weight, r.minutes) for r in R.exposure_weights(obs, p).collect()}
    assert got == {7: (-5.0, 40.0), 8: (2.5, 10.0)}


def test_broken_games_are_reported(spark):
    rows = two_sides([("1", BOS, MIL, 5), ("2", BOS, MIL, 5)]) + [("3", BOS, MIL, True, 5)]
    p = players(spark, [("1", BOS, 1, 10.0), ("1", MIL, 2, 10.0), ("2", BOS, 1, 10.0), ("2", MIL, 2, 0.0), ("3", BOS, 1, 9.0)])
    g = games(spark, rows)
    assert [r.game_id for r in R.observations(g, p).collect()] == ["1"]
    got = {r.key: r.message for r in R.observation_issues(g, p).collect()}
    assert got == {"game_id=2": "no away player with positive minutes", "game_id=3": "expected two team rows, found 1"}


def test_penalties_by_games_and_minutes(spark):
    exposure = spark.createDataFrame(
        [("s", 101, 2, 10.0), ("s", 201, 1, 40.0)], "season_id string, player_id bigint, games bigint, minutes double"
    )
    settings = [R.Setting(10.0, "uniform"), R.Setting(10.0, "game-count"), R.Setting(10.0, "minutes")]
    got = {(r.setting_id, r.code // 8): r.penalty for r in R.penalties(exposure, settings).collect()}
    assert got == {(0, 101): 10.0, (0, 201): 10.0, (1, 101): 5.0, (1, 201): 10.0, (2, 101): 48.0, (2, 201): 12.0}
    with pytest.raises(ValueError):
        R.Setting(mode="other")


def random_season(spark, n=80, seed=5):
    rng = np.random.default_rng(seed)
    g_rows, p_rows = [], []
    for i in range(n):
        home, away = rng.choice(4, 2, replace=False) + 1
        day = dt.date(2022, 11, 1) + dt.timedelta(days=int(i % 40))
        g_rows.append((f"{i:04d}", int(home), int(away), int(rng.integers(-20, 20)), day))
        for team in (home, away):
            for k in rng.choice(6, 4, replace=False):
                p_rows.append((f"{i:04d}", int(team), int(team * 10 + k), float(rng.integers(5, 40))))
    return games(spark, two_sides(g_rows)), players(spark, p_rows), g_rows, p_rows


def test_fit_equals_a_dense_solve(spark):
    g, p, g_rows, p_rows = random_season(spark)
    ids = sorted({i for _, _, i, _ in p_rows})
    names = ["intercept", "home_court", *ids, *[("team", t) for t in range(1, 5)], *[("opponent", t) for t in range(1, 5)]]
    at = {name: i for i, name in enumerate(names)}
    x, y = [], []
    for game, home, away, margin, _ in g_rows:
        weight = {}
        for team, sign in ((home, 1), (away, -1)):
            mine = [(i, m) for gid, t, i, m in p_rows if gid == game and t == team]
            total = sum(m for _, m in mine)
            weight.update({i: sign * 5 * m / total for i, m in mine})
        for sign, own, other in ((1, home, away), (-1, away, home)):
            row = np.zeros(len(names))
            row[0], row[1], row[at["team", own]], row[at["opponent", other]] = 1, sign, 1, 1
            for i, w in weight.items():
                row[at[i]] = sign * w
            x.append(row)
            y.append(sign * margin)
    x, y = np.array(x), np.array(y)
    penalty = np.diag([0, 0] + [3.0] * (len(names) - 2))
    expected = np.linalg.solve(x.T @ x + penalty, x.T @ y)
    obs = R.observations(g, p)
    weights = R.exposure_weights(obs, p)
    # As one block, and as blocks of which the last one is smaller.
    for block in (G.BLOCK, 7):
        got = terms(R.fit(obs, weights, [R.Setting(3.0)], block=block))
        assert len(got) == len(names)
        for name, value in zip(names, expected):
            key = (name, None) if isinstance(name, str) else ("player", name) if isinstance(name, int) else name
            assert got[key] == pytest.approx(value, abs=1e-9)


def entries_of(spark, x, y, season="s"):
    """The rows of a sparse matrix in long form; the code of a column is its number."""
    rows = []
    for r in range(len(x)):
        rows.append((season, str(r), 1, -1, float(y[r])))
        rows += [(season, str(r), 1, int(c), float(x[r, c])) for c in np.flatnonzero(x[r])]
    return spark.createDataFrame(rows, "season_id string, game_id string, mirror int, code long, x double")


def test_blocks_of_cross_products(spark):
    rng = np.random.default_rng(8)
    x = np.where(rng.random((120, 23)) < 0.2, rng.normal(size=(120, 23)), 0.0)
    x[:, 5], x[0] = np.where(np.arange(120) < 3, 1.0, 0.0), 1.0
    y = rng.normal(size=120)
    entries = entries_of(spark, x, y)
    places = G.layout(entries)
    for block in (G.BLOCK, 10, 4):
        blocks = G.gram_blocks(entries, places, block)
        got = {(r.first, r.second): r.value for r in G.cells(blocks, block).collect()}
        whole = x.T @ x
        for i in range(23):
            assert got[i, -1] == pytest.approx(x[:, i] @ y)
            assert all(got.get((i, j), 0.0) == pytest.approx(whole[i, j]) for j in range(i + 1))
    # A task sends a block once, however many rows it has read.
    twice = entries.unionByName(entries.withColumn("game_id", F.concat("game_id", F.lit("b"))))
    rows = [G.gram_blocks(e, G.layout(e), 10).count() for e in (entries, twice)]
    assert rows[0] == rows[1] == 3 * 4 // 2 + 3


def test_many_columns_in_blocks(spark):
    rng = np.random.default_rng(9)
    n, wide = 700, 5000
    # Random sparse rows: 5,000 columns of which each game has a few.
    rows = [("s", str(g), 1, -1, float(rng.normal())) for g in range(n)]
    design, target = np.zeros((n, wide)), np.array([r[4] for r in rows])
    for g in range(n):
        chosen = np.unique(np.append(rng.choice(wide, 12, replace=False), [(g * 8 + k) % wide for k in range(8)]))
        values = rng.normal(size=len(chosen))
        design[g, chosen] = values
        rows += [("s", str(g), 1, int(c), float(v)) for c, v in zip(chosen, values)]
    entries = spark.createDataFrame(rows, "season_id string, game_id string, mirror int, code long, x double")
    places = G.layout(entries)
    assert places.columns == {"s": wide} and places.rows == {"s": n}
    alphas = F.explode(F.create_map(F.lit(0), F.lit(2.0), F.lit(1), F.lit(30.0))).alias("setting_id", "penalty")
    penalties = places.places.filter("position >= 0").select("season_id", "position", alphas)
    solved = S.solve(G.gram_blocks(entries, places), places, penalties)
    got = solved.toPandas().pivot(index="code", columns="setting_id", values="coefficient").loc[range(wide)].to_numpy()
    for s, alpha in ((0, 2.0), (1, 30.0)):
        # By the smaller system of the rows.
        expected = design.T @ np.linalg.solve(design @ design.T + alpha * np.eye(n), target)
        assert np.abs(got[:, s] - expected).max() < 1e-9


def test_singular_blocks_are_an_error(spark):
    x = np.eye(9)[:, [0, 1, 2, 3, 4, 5, 6, 7, 7]]
    entries = entries_of(spark, x, np.ones(9))
    places = G.layout(entries)
    penalties = places.places.filter("position >= 0").select("season_id", F.lit(0).alias("setting_id"), "position", F.lit(0.0).alias("penalty"))
    for block in (G.BLOCK, 4):
        with pytest.raises(PythonException, match="singular"):
            S.solve(G.gram_blocks(entries, places, block), places, penalties, block).collect()


def test_weights_sum_to_five_per_side(spark):
    g, p, *_ = random_season(spark)
    obs = R.observations(g, p)
    sums = R.exposure_weights(obs, p).groupBy("game_id", F.signum("weight").alias("side")).agg(F.sum("weight").alias("s"))
    assert all(abs(abs(r.s) - 5.0) < 1e-9 for r in sums.collect())


def test_tuning_keeps_the_last_games_for_validation(spark):
    g, p, *_ = random_season(spark, n=5)
    obs = R.observations(g, p)
    result = T.tune_ridge(obs, R.exposure_weights(obs, p), [0.1, 1.0, 10.0]).collect()
    assert sorted(r.alpha for r in result) == [0.1, 1.0, 10.0]
    assert all(r.validation_games == 1 and r.validation_mse >= 0 for r in result)
    assert sum(r.is_best for r in result) == 1


def test_setting_grid_size():
    grid = T.setting_grid([1.0, 2.0], ["uniform", "minutes"], [0.5, 1.0], [24.0, 48.0, 96.0])
    assert len(grid) + 3 == 19


def test_scores_of_constant_and_ranked_pairs(spark):
    pairs = spark.createDataFrame(
        [("a", 1, 1.0, 2.0), ("a", 2, 2.0, 4.0), ("a", 3, 3.0, 9.0), ("b", 1, 1.0, 1.0), ("b", 2, 1.0, 2.0), ("c", 1, 1.0, 1.0)],
        "k string, player_id bigint, value double, target double",
    )
    got = {r.k: r for r in T.correlations(pairs, ["k"], "value", "target").collect()}
    assert got["a"].pearson == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 9])[0][1])
    assert got["a"].spearman == pytest.approx(1.0)
    assert got["b"].pearson is None and got["b"].spearman is None
    assert got["c"].players == 1 and got["c"].pearson is None


def test_latest_season_wins(spark):
    rows = spark.createDataFrame(
        [("2021-22", "Regular Season", 1, 4.0), ("2022-23", "Regular Season", 1, 6.0), ("2022-23", "Playoffs", 1, 9.0)],
        "season string, season_type string, player_id bigint, value double",
    ).withColumn("season_id", F.concat_ws(":", "season", "season_type")).withColumn("player_name", F.lit("P"))
    assert T.training_scores(rows, "value", "latest").first().value == 6.0
    assert T.training_scores(rows, "value", "max").first().value == 9.0
