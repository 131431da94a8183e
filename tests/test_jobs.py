from collections import Counter
from datetime import datetime
from pathlib import Path

import pytest
from builders import dimension, games, players
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from impactframe.functions import keys as K
from impactframe.operators import quality as Q
from impactframe.operators import ridge as R
from impactframe.plans import jobs as J
from impactframe.sources.csv_files import Ingested
from impactframe.sources.request_log import RequestLog
from impactframe.sources.snapshots import MANIFEST, Snapshots
from impactframe.sources.store import Store

YEARS = range(2020, 2025)


def season_tables(spark, season="2022-23", margin=4, count=12):
    """Two teams with six players each, so that every check passes."""
    g_rows, p_rows = [], []
    for n in range(count):
        game = f"{season[:4]}{n:03d}"
        home, away = (1, 2) if n % 2 == 0 else (2, 1)
        value = margin + n - 6
        g_rows += [(game, home, away, True, value), (game, away, home, False, -value)]
        for team in (1, 2):
            bench = n % 6
            p_rows += [(game, team, team * 10 + k, None if k == bench and n % 3 == 0 else 45.0 + k / 4) for k in range(6)]
    return games(spark, g_rows, season), players(spark, p_rows, season)


def loads_of(spark, g, p):
    scope = ["team_id", "season", "season_type"]
    counts = g.groupBy(*scope).agg(F.count("*").alias("games_row_count"))
    rows = p.groupBy(*scope).agg(F.count("*").alias("game_players_row_count"))
    return counts.join(rows, scope).select(
        *scope,
        F.lit("folder").alias("source_path"),
        F.lit("snapshot").alias("source_snapshot"),
        F.lit("test").alias("source_kind"),
        F.lit("v1").alias("build_version"),
        F.current_timestamp().alias("refreshed_at"),
        "games_row_count",
        "game_players_row_count",
        F.col("games_row_count").alias("expected_games_row_count"),
        F.lit(0).cast("bigint").alias("skipped_games_row_count"),
    )


@pytest.fixture()
def store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for season in ("2021-22", "2022-23"):
        g, p = season_tables(spark, season)
        store.replace_scopes(g, p, loads_of(spark, g, p))
    return store


def query(metric, **extra):
    options = {"min_games": 1, "min_games_with": 1, "min_games_without": 1, "min_average_minutes": 1, "min_total_minutes": 1}
    return J.MetricQuery(metric, ["2022-23:REGULAR", "2021-22:REGULAR"], [2, 1], **{**options, **extra})


def test_replacing_a_team_season_keeps_the_others(spark, store):
    g, p = season_tables(spark, "2022-23", margin=9)
    g, p = g.filter("team_id = 1 and game_id < '2022006'"), p.filter("team_id = 1 and game_id < '2022006'")
    store.replace_scopes(g, p, loads_of(spark, g, p))
    counts = {(r.team_id, r.season): r["count"] for r in store.games().groupBy("team_id", "season").count().collect()}
    assert counts == {(1, "2021-22"): 12, (2, "2021-22"): 12, (1, "2022-23"): 6, (2, "2022-23"): 12}
    loads = {(r.team_id, r.season): r.games_row_count for r in store.loads().collect()}
    assert loads == counts


@pytest.mark.parametrize("metric", ["wowy", "wowy_shrunk", "ridge"])
def test_stored_rows_equal_live_rows(spark, store, metric):
    q = query(metric)
    names = dimension(spark, [1, 2], YEARS)
    live, source = J.resolve(store, names, q)
    assert source == "live"
    before = {(r.season_id, r.player_id): r.asDict() for r in live.collect()}
    assert before
    assert J.ensure_cached(store, names, q)[0] == "built"
    assert J.ensure_cached(store, names, q)[0] == "cached"
    cached, source = J.resolve(store, names, q)
    assert source == "cache"
    after = {(r.season_id, r.player_id): r.asDict() for r in cached.collect()}
    assert after.keys() == before.keys()
    value = "coefficient" if metric == "ridge" else "value"
    for key, row in after.items():
        assert row[value] == pytest.approx(before[key][value], abs=1e-9)
    board, source = J.resolved_leaderboard(store, names, q)
    assert source == "cache" and board.count() > 0
    g, p = season_tables(spark, "2022-23")
    store.upsert_loads(loads_of(spark, g, p).withColumn("source_snapshot", F.lit("newer")))
    assert J.resolve(store, names, q)[1] == "live"


@pytest.mark.parametrize("metric", ["wowy", "wowy_shrunk", "ridge"])
@pytest.mark.parametrize("first, then", [(9, 1), (1, 9)])
def test_stored_rows_answer_every_minimum(spark, store, metric, first, then):
    names = dimension(spark, [1, 2], YEARS)
    limits = lambda n: {"min_games": 1, "min_games_with": n, "min_games_without": 1}
    J.ensure_cached(store, names, query(metric, **limits(first)))
    asked = query(metric, **limits(then))
    cached, source = J.resolve(store, names, asked)
    assert source == "cache"
    live = J.live_rows(store, names, asked)
    keys = lambda df: {(r.season_id, r.player_id) for r in df.collect()}
    assert keys(cached) == keys(live)


def test_refresh_keeps_pinned_and_used_keys_only(spark, store):
    names = dimension(spark, [1, 2], YEARS)
    used = J.MetricQuery("wowy_shrunk", ["2022-23:REGULAR"], [1], prior_games=5.0)
    store.record_request("wowy_shrunk", used.key)
    store.record_request("wowy_shrunk", "metric=wowy_shrunk|variant=wowy_shrunk|team_ids=9|season_ids=2022-23:REGULAR|shrinkage_prior_games=5.00")
    stale = query("wowy_shrunk", prior_games=77.0)
    J.ensure_cached(store, names, stale)
    results = J.refresh_metric(store, names, "wowy_shrunk")
    kept = {r.metric_cache_key for r in store.keys("wowy_shrunk").collect()}
    assert kept == {key for key, _, _ in results}
    assert used.key in kept and stale.key not in kept
    assert store.values("wowy_shrunk").filter(F.col("metric_cache_key") == stale.key).count() == 0


def test_request_log_opens_few_files(spark, tmp_path):
    log = RequestLog(spark, str(tmp_path), fanout=3)
    assert log.counts().count() == 0
    schema = "metric_id string, metric_cache_key string, requested_at timestamp"
    expected = Counter()
    for i in range(11):
        keys = ["a", f"k{i % 4}"] + [None] * (i % 5 == 0)
        stamp = datetime(2024, 1, 1 + i)
        log.add(spark.createDataFrame([("wowy", k, stamp) for k in keys], schema))
        expected.update(keys)
        assert len(log.runs()) <= 2 * 3
    assert log.runs() == [(0, 9), (9, 10), (10, 11)]
    got = {r.metric_cache_key: (r.query_count, r.last_requested_at) for r in log.counts().collect()}
    assert {k: n for k, (n, _) in got.items()} == expected
    assert got["a"][1] == datetime(2024, 1, 11) and got["k1"][1] == datetime(2024, 1, 10)


def test_request_log_outlives_a_fold_that_dies(spark, tmp_path):
    log = RequestLog(spark, str(tmp_path), fanout=3)
    rows = spark.createDataFrame([("wowy", "a", datetime(2024, 1, 1))], "metric_id string, metric_cache_key string, requested_at timestamp")
    total = lambda: log.counts().collect()[0].query_count
    for _ in range(2):
        log.add(rows)
    # Dead after writing files, before the switch: the folder has no mark and does not count.
    (tmp_path / "runs" / "0-3").mkdir()
    assert log.runs() == [(0, 1), (1, 2)] and total() == 2
    # The numbers of that fold stay taken.
    log.add(rows)
    assert total() == 3 and log.runs() == [(0, 4)]
    # Dead after the switch: what the fold replaces is still there and hidden.
    log._write(log._read([(0, 4)]), (2, 3))
    assert total() == 3 and log.runs() == [(0, 4)]
    log.add(rows)
    assert total() == 4 and sorted(p.name for p in (tmp_path / "runs").iterdir()) == ["0-4", "4-5"]


def test_rebuild_runs_all_stages_and_stops_at_failures(spark, tmp_path):
    names = dimension(spark, [1, 2], YEARS)
    # Enough games for the default minimums.
    g, p = season_tables(spark, count=60)
    ingested = Ingested(g, p, loads_of(spark, g, p), None)
    done = J.rebuild(Store(spark, str(tmp_path / "good")), names, ingested, ["wowy", "ridge"])
    assert done.failed_stage is None, done.message
    assert set(done.metrics) == {"wowy", "ridge"}
    broken = Ingested(g.withColumn("source", F.lit(" ")), p, loads_of(spark, g, p), None)
    done = J.rebuild(Store(spark, str(tmp_path / "bad")), names, broken, ["wowy"])
    assert done.failed_stage == "audit" and "source must not be empty" in done.message


def test_audit_finds_tampered_store(spark, store):
    names = dimension(spark, [1, 2], YEARS)
    J.ensure_cached(store, names, query("wowy"))
    assert J.audit_store(store, names).count() == 0
    store.replace_metric("wowy", query("wowy").key, store.values("wowy").drop("metric_id", "key_hash").limit(1), build_version="x", fingerprint="old")
    messages = {r.message for r in J.audit_store(store, names).collect()}
    assert messages == {"source_fingerprint does not match the current source tables"}


def test_audit_survives_a_key_that_no_query_has(spark, store):
    names = dimension(spark, [1, 2], YEARS)
    J.ensure_cached(store, names, query("wowy"))
    rows = store.values("wowy").drop("metric_id", "key_hash").limit(1)
    store.replace_metric("wowy", "no key at all", rows, build_version="x", fingerprint="old")
    messages = " ".join(r.message for r in J.audit_store(store, names).collect())
    assert "parseable" in messages


def test_keys_are_canonical():
    key = K.cache_key("ridge", ["2022-23:PLAYOFFS", "2022-23:REGULAR", "2021-22:REGULAR"], [3, 1, 3], {"ridge_alpha": 10.005, "shrinkage_mode": "uniform", "shrinkage_strength": 10, "shrinkage_minute_scale": 10.004, "min_games": 35})
    assert key == (
        "metric=ridge|variant=default|team_ids=1,3|season_ids=2021-22:REGULAR,2022-23:REGULAR,2022-23:PLAYOFFS"
        "|ridge_alpha=10.01|shrinkage_mode=uniform|shrinkage_strength=10.00|shrinkage_minute_scale=10.00|min_games=35"
    )
    q = J.query_of_key(key)
    assert q.key == key and q.setting == R.Setting(10.01, "uniform", 10.0, 10.0)
    with pytest.raises(ValueError):
        K.parse_key("metric=ridge|variant=default|team_ids=1")


def test_failing_fast_shows_a_preview(spark):
    issues = spark.createDataFrame([("games", f"k{i}", f"bad {i}") for i in range(7)], "table string, key string, message string")
    with pytest.raises(ValueError, match=r"7 issue\(s\).*2 more"):
        Q.require_clean(issues)
    assert "games x7: bad <num>" in Q.summary_text(issues)


def test_unusable_games_stop_a_live_query(spark, store):
    games_, players_ = season_tables(spark, "2022-23")
    lone = players_.filter("not (game_id = '2022003' and team_id = 2)")
    store.replace_scopes(games_, lone, loads_of(spark, games_, lone))
    dim = dimension(spark, [1, 2], YEARS)
    with pytest.raises(Py4JJavaError, match=r"1 issue\(s\): games\[game_id=2022003,team_id=2\]: no appeared players"):
        J.live_rows(store, dim, query("wowy")).collect()
    with pytest.raises(Py4JJavaError, match=r"games\[game_id=2022003\]"):
        J.live_rows(store, dim, query("ridge")).collect()
    done = J.rebuild(store, dim, Ingested(games_, lone, loads_of(spark, games_, lone), None, None), ["wowy"])
    assert done.failed_stage == "wowy" and "no appeared players" in done.message


def test_issues_of_all_kinds_in_one_preview(spark):
    issues = spark.createDataFrame(
        [("games", f"k{i:02d}", f"bad {i}") for i in range(40)] + [("loads", "l", t) for t in "abcdef"],
        "table string, key string, message string",
    )
    rows = spark.range(3)
    assert Q.enforced(rows, issues.filter("key = 'none'")).count() == 3
    with pytest.raises(Py4JJavaError, match=r"46 issue\(s\): games\[k00\]: bad 0 x40; loads\[l\]: a x1; .* 2 more kinds"):
        Q.enforced(rows, issues).collect()


def test_a_batch_must_be_whole_team_seasons(spark, store):
    g, p = season_tables(spark, "2022-23", margin=9)
    before = sorted(map(tuple, store.games().collect()))
    with pytest.raises(ValueError, match="24 issue.*outside the written team-seasons"):
        store.replace_scopes(g, p, loads_of(spark, g, p).filter("team_id = 1").withColumn("season", F.lit("2021-22")))
    with pytest.raises(ValueError, match="6 issue.*refers to a game that is not written"):
        store.replace_scopes(g.filter("not (team_id = 1 and game_id = '2022001')"), p, loads_of(spark, g, p))
    assert sorted(map(tuple, store.games().collect())) == before


def test_a_killed_commit_leaves_the_old_state(spark, store, monkeypatch):
    before = sorted(map(tuple, store.games().collect()))
    g, p = season_tables(spark, "2022-23", margin=9)

    def killed(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as patched:
        patched.setattr(Snapshots, "publish", killed)
        with pytest.raises(RuntimeError, match="killed"):
            store.replace_scopes(g, p, loads_of(spark, g, p))
    assert sorted(map(tuple, store.games().collect())) == before
    # A manifest without its mark of completeness is not read either.
    number = store.snapshots.version()
    spark.createDataFrame([], MANIFEST).write.parquet(f"{store.root}/manifest/{number + 1}")
    Path(store.root, "manifest", str(number + 1), "_SUCCESS").unlink()
    assert store.snapshots.version() == number
    store.replace_scopes(g, p, loads_of(spark, g, p))
    assert store.snapshots.version() == number + 2
    assert sorted(map(tuple, store.games().collect())) != before
    assert any("version=" in x for x in store.vacuum())
    assert store.games().count() == len(before)


def test_no_players_of_an_emptied_team_season_stay(spark, store):
    g, p = season_tables(spark, "2022-23")
    one = F.col("team_id") == 1
    store.replace_scopes(g.filter(one), p.filter("false"), loads_of(spark, g, p).filter(one))
    left = {(r.team_id, r.season): r["count"] for r in store.game_players().groupBy("team_id", "season").count().collect()}
    assert left.keys() == {(1, "2021-22"), (2, "2021-22"), (2, "2022-23")}
    before = sorted(map(tuple, store.games().collect()))
    store.compact("games")
    assert sorted(map(tuple, store.games().collect())) == before
    assert store.vacuum() and sorted(map(tuple, store.games().collect())) == before


def test_fingerprints_of_all_entries_in_one_plan(spark, store):
    queries = [J.MetricQuery("wowy", ["2022-23:REGULAR"], teams) for teams in ([], [1], [1, 2])]
    queries.append(J.MetricQuery("ridge", ["2022-23:REGULAR", "2021-22:REGULAR"], [2]))
    rows = [(q.metric, q.key) for q in queries] + [("wowy", "no key at all")]
    entries = spark.createDataFrame(rows, "metric_id string, metric_cache_key string")
    got = {(r.metric_id, r.metric_cache_key): r.source_fingerprint for r in J.entry_fingerprints(entries, store.loads()).collect()}
    assert got == {(q.metric, q.key): J.current_fingerprint(store, q) for q in queries}
