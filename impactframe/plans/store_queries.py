"""Registered queries over a store: written, replaced, pruned and read back in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactframe.operators import quality
from impactframe.operators import with_without as M
from impactframe.plans import jobs as J
from impactframe.plans.margin_queries import MINUTES, rounded, tables
from impactframe.plans.quality_queries import LOADS
from impactframe.plans.reference_sql import WITH_WITHOUT, over
from impactframe.plans.table_queries import USAGE, usage_log
from impactframe.session import ensure_checkpoint_dir, keep
from impactframe.sources.request_log import RequestLog
from impactframe.sources.sample_tables import loads_view
from impactframe.sources.store import Store

BATCHES = 10
SEASONS = ["1995-96", "1996-97", "1997-98", "1998-99"]


def _filled(spark, folder) -> tuple[Store, DataFrame, DataFrame, DataFrame]:
    """A new store with the sample tables in it, and these tables."""
    ensure_checkpoint_dir(spark)
    store = Store(spark, f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}")
    games, players = map(keep, tables(spark, folder))
    loads = loads_view(games, players)
    store.replace_scopes(games, players, loads)
    return store, games, players, loads


def _query(season: str) -> J.MetricQuery:
    return J.MetricQuery("wowy", [f"{season}:REGULAR"], [])


def _with_metrics(spark, folder) -> tuple[Store, DataFrame]:
    """A store with one stored calculation a season, without filters."""
    store, games, players, loads = _filled(spark, folder)
    rows = keep(M.wowy(games, players, min_games_with=0, min_games_without=0, min_average_minutes=None, min_total_minutes=None))
    for season in SEASONS:
        query = _query(season)
        fingerprint = J.current_fingerprint(store, query)
        store.replace_metric("wowy", query.key, rows.filter(F.col("season") == season), build_version="v1", fingerprint=fingerprint)
    return store, loads


def store_after_replace(spark, folder):
    """Odd teams are stored again with other margins and fewer players, the third without players."""
    store, games, players, loads = _filled(spark, folder)
    odd = F.col("team_id") % 2 == 1
    fewer = odd & (F.col("team_id") != 3) & (F.col("player_id") % 5 != 0)
    store.replace_scopes(games.filter(odd).withColumn("margin", F.col("margin") + 1), players.filter(fewer), loads.filter(odd))
    store.compact("games")
    store.vacuum()
    scope = ["team_id", "season", "season_type"]
    counted = store.games().groupBy(*scope).agg(F.count("*").alias("games"), F.sum("margin").alias("margin"))
    rows = store.game_players().groupBy(*scope).agg(F.count("*").alias("players"), F.sum("minutes").alias("minutes"))
    return counted.join(rows, scope, "left").join(store.loads().select(*scope, "games_row_count"), scope)


def store_after_prune(spark, folder):
    """All but two calculations of a metric are dropped; what is left is read by key, with its entry."""
    store, _ = _with_metrics(spark, folder)
    store.prune("wowy", [_query(s).key for s in SEASONS[1:3]])
    store.vacuum()
    rows = store.values("wowy").groupBy("metric_cache_key").agg(F.count("*").alias("rows"), F.sum("value").alias("value"))
    entries = store.cache_entries().select("metric_cache_key", "row_count", "build_version")
    return rounded(entries.join(rows, "metric_cache_key", "full"))


def cached_rows(spark, folder):
    """A query with minimums, answered from rows that were stored without them."""
    store, _ = _with_metrics(spark, folder)
    query = _query(SEASONS[0])
    rows = store.stored_rows(
        "wowy", query.key, query.season_ids, min_games={"games_with": 15, "games_without": 2}, **MINUTES
    )
    return rounded(rows.drop("metric_id", "key_hash", "metric_cache_key", "raw_wowy_score"))


def store_audit(spark, folder):
    """The load rows of one stored season change, and the entry of another counts a row too many."""
    store, loads = _with_metrics(spark, folder)
    changed = loads.filter(F.col("season") == SEASONS[1])
    store.upsert_loads(changed.withColumn("source_snapshot", F.lit("sample-v2")))
    entries = store.cache_entries().drop("key_hash")
    miscounted = F.col("row_count") + F.when(F.col("metric_cache_key") == _query(SEASONS[2]).key, 1).otherwise(0)
    entries = keep(entries.withColumn("row_count", miscounted))
    stored = store.values("wowy").select("metric_id", "metric_cache_key", "season_id")
    prints = J.entry_fingerprints(entries, store.loads())
    return quality.store_relation_issues(stored, entries, prints)


def recorded_requests(spark, folder):
    """All requests, recorded in batches: the first eight are folded into one run on the way."""
    ensure_checkpoint_dir(spark)
    log = RequestLog(spark, f"{spark.sparkContext.getCheckpointDir()}/requests-{uuid.uuid4().hex}")
    requests = keep(usage_log(spark, folder))
    for batch in range(BATCHES):
        log.add(requests.filter(F.pmod(F.hash("requested_at", "metric_cache_key"), F.lit(BATCHES)) == batch))
    return log.counts().withColumn("last_requested_at", F.date_format("last_requested_at", "yyyy-MM-dd HH:mm:ss"))


QUERIES = {
    "recorded_requests": recorded_requests,
    "store_after_replace": store_after_replace,
    "store_after_prune": store_after_prune,
    "cached_rows": cached_rows,
    "store_audit": store_audit,
}


def _key_sql() -> str:
    # The text of a key up to its season is the same for all of them.
    head, tail = _query(SEASONS[0]).key.split(SEASONS[0])
    return f"'{head}' || season || '{tail}'"


ORACLES = {
    "recorded_requests": "WITH "
    + USAGE
    + """ SELECT metric_id, metric_cache_key, query_count,
      strftime(last_requested_at, '%Y-%m-%d %H:%M:%S') AS last_requested_at FROM counts""",
    "store_after_replace": over(
        LOADS,
        select="""SELECT g.team_id, g.season, g.season_type, g.games, g.margin, p.players, p.minutes, l.games_row_count
          FROM (SELECT team_id, season, season_type, count(*) AS games, sum(margin + team_id % 2) AS margin FROM games GROUP BY ALL) g
          LEFT JOIN (
            SELECT team_id, season, season_type, count(*) AS players, sum(minutes) AS minutes FROM players
            WHERE team_id % 2 = 0 OR (team_id <> 3 AND player_id % 5 <> 0) GROUP BY ALL) p
            ON p.team_id = g.team_id AND p.season = g.season
          JOIN loads l ON l.team_id = g.team_id AND l.season = g.season""",
    ),
    "store_after_prune": over(
        WITH_WITHOUT,
        select=f"""SELECT {_key_sql()} AS metric_cache_key, count(*) AS row_count, 'v1' AS build_version, count(*) AS rows,
          round(sum(value), 6) + 0.0 AS value
          FROM margins WHERE season IN ('1996-97', '1997-98') AND value IS NOT NULL GROUP BY season""",
    ),
    "cached_rows": over(
        WITH_WITHOUT,
        select="""SELECT season_id, player_id, player_name, round(value, 6) + 0.0 AS value, games_with, games_without,
          round(avg_margin_with, 6) + 0.0 AS avg_margin_with, round(avg_margin_without, 6) + 0.0 AS avg_margin_without,
          round(average_minutes, 6) AS average_minutes, total_minutes FROM kept WHERE season = '1995-96'""",
    ),
    "store_audit": over(
        WITH_WITHOUT,
        select=f"""SELECT 'cache_entries' AS "table", 'metric=''wowy'',metric_cache_key=''' || {_key_sql()} || '''' AS key,
          CASE season WHEN '1996-97' THEN 'source_fingerprint does not match the current source tables'
            ELSE 'row_count does not match the stored rows: ' || (count(*) + 1) || ' != ' || count(*) END AS message
          FROM margins WHERE season IN ('1996-97', '1997-98') AND value IS NOT NULL GROUP BY season""",
    ),
}
