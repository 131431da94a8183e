import numpy as np
import pyarrow as pa
import pytest
from builders import games, players
from pyspark.errors import PythonException
from test_ridge import random_season, terms, two_sides

from impactframe.operators import block_solve as S
from impactframe.operators import row_solve as C
from impactframe.operators import ridge as R


def system(rng, n, wide):
    """Sparse rows as the arrays of a batch, the dense rows, and how often each counts."""
    dense, codes, values = np.zeros((n, wide)), [], []
    for r in range(n):
        at = rng.choice(wide, 5, replace=False)
        dense[r, at] = rng.normal(size=5)
        codes.append(at)
        values.append(dense[r, at])
    factor, target = rng.integers(1, 4, n) * 0.5, rng.normal(size=n)
    return np.concatenate(codes), np.concatenate(values), np.full(n, 5), dense, factor, target


@pytest.mark.parametrize("held", [C.MOST_HELD, 3000])
def test_solution_from_rows_in_memory_or_in_a_file(monkeypatch, held):
    monkeypatch.setattr(C, "MOST_HELD", held)
    monkeypatch.setattr(C, "CHUNK", 400)
    rng = np.random.default_rng(3)
    codes, values, sizes, dense, factor, target = system(rng, 500, 90)
    found = C._System()
    found.codes = np.arange(90) * 8 + 2
    found.penalties = {0: np.full(90, 1e-3), 2: rng.random(90) + 0.1}
    for k in range(0, 500, 50):
        part, rows = slice(k * 5, (k + 50) * 5), slice(k, k + 50)
        found.take(codes[part] * 8 + 2, values[part], sizes[rows], target[rows], factor[rows])
    got = pa.Table.from_batches(found.solutions("s")).to_pandas().pivot(index="code", columns="setting_id", values="coefficient")
    gram, right = dense.T @ (dense * factor[:, None]), dense.T @ (target * factor)
    for s, penalty in found.penalties.items():
        assert np.abs(got[s].to_numpy() - np.linalg.solve(gram + np.diag(penalty), right)).max() < 1e-9


def test_normal_equations_are_those_of_the_mirrored_rows(spark):
    g, p, *_ = random_season(spark)
    obs = R.observations(g, p)
    weights = R.exposure_weights(obs, p)
    rows = R.game_rows(obs, weights).toPandas().pivot(index=["game_id", "mirror"], columns="code", values="x").fillna(0.0)
    x, y = rows.drop(columns=R.TARGET), rows[R.TARGET]
    whole, codes = x.T.to_numpy() @ x.to_numpy(), list(x.columns)
    gram, target = R.normal_equations(obs, weights)
    cells = {(r.code_1, r.code_2): r.value for r in gram.collect()}
    for i, a in enumerate(codes):
        for j, b in enumerate(codes[i:], i):
            assert cells.get((a, b), 0.0) == pytest.approx(whole[i, j], abs=1e-9)
    assert {r.code: r.value for r in target.collect()} == pytest.approx(dict(zip(codes, x.T.to_numpy() @ y.to_numpy())), abs=1e-9)
    # Half the entries of the mirrored rows, and no more rows of sums than pairs of teams.
    assert R.game_vectors(obs, weights).count() <= 80 + 6


def test_wide_seasons_need_no_matrix(spark, monkeypatch):
    g, p, *_ = random_season(spark)
    obs = R.observations(g, p)
    weights = R.exposure_weights(obs, p)
    settings = [R.Setting(3.0), R.Setting(3.0, "game-count"), R.Setting(0.5, "minutes", 0.5)]

    def fitted(**options):
        return {(r.setting_id, r.kind, r.entity_id): r.coefficient for r in R.fit(obs, weights, settings, min_games=20, **options).collect()}

    expected = fitted()

    def wide(*_):
        raise AssertionError("a matrix of blocks")

    monkeypatch.setattr(S, "_wide", wide)
    got = fitted(block=7)
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k], abs=1e-9) for k in expected)


def test_wide_season_without_a_penalty_is_still_singular(spark):
    rows = [("g1", 1, 2, 2.0), ("g2", 1, 2, 3.0)]
    g = games(spark, two_sides(rows))
    p = players(spark, [(r[0], t, t * 10, 48.0) for r in rows for t in r[1:3]])
    obs = R.observations(g, p)
    weights = R.exposure_weights(obs, p)
    with pytest.raises(PythonException, match="singular"):
        R.fit(obs, weights, [R.Setting(0.0)], block=4).collect()
    assert len(terms(R.fit(obs, weights, [R.Setting(1.0)], block=4))) == 8
