"""Jobs over the store: answer a query from stored rows or live, refresh, rebuild."""

from __future__ import annotations

from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactframe.functions.keys import cache_key, key_seasons, key_teams, parse_key
from impactframe.functions.seasons import parse_season_id, season_text, type_text
from impactframe.operators import quality, ridge, scopes, usage, with_without
from impactframe.operators.leaderboard import leaderboard
from impactframe.sources.store import Store

BUILD_VERSIONS = {"wowy": "wowy-v1", "wowy_shrunk": "wowy-shrunk-v1", "ridge": "ridge-v1"}
METRICS = ["wowy", "wowy_shrunk", "ridge"]


@dataclass(frozen=True)
class MetricQuery:
    """What to calculate, and which of the calculated rows to show."""

    metric: str
    season_ids: list[str]
    team_ids: list[int]
    setting: ridge.Setting = field(default_factory=ridge.Setting)
    prior_games: float = 10.0
    min_games: int = 35
    min_games_with: int = 15
    min_games_without: int = 2
    min_average_minutes: float | None = 30.0
    min_total_minutes: float | None = 600.0
    top_n: int = 30

    def __post_init__(self) -> None:
        if self.metric not in METRICS:
            raise ValueError(f"unknown metric {self.metric!r}")
        if not self.season_ids:
            raise ValueError("at least one season is required")
        if self.top_n < 0 or min(self.min_games, self.min_games_with, self.min_games_without) < 0:
            raise ValueError("limits must be non-negative")

    @property
    def key(self) -> str:
        settings: dict[str, object] = {}
        if self.metric == "wowy_shrunk":
            settings = {"shrinkage_prior_games": self.prior_games}
        elif self.metric == "ridge":
            settings = {
                "ridge_alpha": self.setting.alpha,
                "shrinkage_mode": self.setting.mode,
                "shrinkage_strength": self.setting.strength,
                "shrinkage_minute_scale": self.setting.minute_scale,
                "min_games": self.min_games,
            }
        return cache_key(self.metric, self.season_ids, self.team_ids, settings)

    @property
    def minutes(self) -> dict[str, float | None]:
        return {"min_average_minutes": self.min_average_minutes, "min_total_minutes": self.min_total_minutes}

    def unfiltered(self) -> MetricQuery:
        """The same calculation as it is stored: without the filters that are not part of its key."""
        return MetricQuery(
            self.metric,
            self.season_ids,
            self.team_ids,
            self.setting,
            self.prior_games,
            self.min_games,
            min_games_with=0,
            min_games_without=0,
            min_average_minutes=None,
            min_total_minutes=None,
        )


def query_of_key(key: str) -> MetricQuery:
    """The calculation a cache key stands for."""
    parts = parse_key(key)
    settings = parts["settings"]
    extra: dict[str, object] = {}
    if parts["metric"] == "ridge":
        extra = {
            "setting": ridge.Setting(
                float(settings["ridge_alpha"]),
                settings["shrinkage_mode"],
                float(settings["shrinkage_strength"]),
                float(settings["shrinkage_minute_scale"]),
            ),
            "min_games": int(settings["min_games"]),
        }
    elif "shrinkage_prior_games" in settings:
        extra = {"prior_games": float(settings["shrinkage_prior_games"])}
    return MetricQuery(parts["metric"], parts["season_ids"], parts["team_ids"], **extra)


def _query_loads(store: Store, query: MetricQuery) -> DataFrame:
    loads = scopes.scan(store.loads(), teams=query.team_ids)
    return loads.filter(scopes.season_id(F.col("season"), F.col("season_type")).isin(query.season_ids))


def current_fingerprint(store: Store, query: MetricQuery) -> str | None:
    """Digest of the load rows the query depends on; None if there are none."""
    row = scopes.source_fingerprint(_query_loads(store, query).withColumn("_all", F.lit(1)), ["_all"]).first()
    return row["source_fingerprint"] if row else None


def entry_fingerprints(entries: DataFrame, loads: DataFrame) -> DataFrame:
    """The current digest of the load rows that every cache entry depends on, all entries in one plan.

    A key that cannot be parsed, or without load rows, has none.
    """
    by = ["metric_id", "metric_cache_key"]
    key = F.col("metric_cache_key")
    seasons = entries.select(*by, key_teams(key).alias("_teams"), F.explode(key_seasons(key)).alias("_season_id")).distinct()
    identity = scopes.season_id(F.col("season"), F.col("season_type"))
    rows = seasons.join(loads.withColumn("_season_id", identity), "_season_id")
    wanted = (F.size("_teams") == 0) | F.array_contains("_teams", F.col("team_id"))
    return scopes.source_fingerprint(rows.filter(wanted), by)


def live_rows(store: Store, dimension: DataFrame, query: MetricQuery) -> DataFrame:
    """Calculate the player-season rows of a query from the game tables.

    Reading them raises if a game cannot be used: nobody appeared for a team, or a ridge game lacks a side or minutes.
    """
    wanted = scopes.requested(store.loads(), dimension, query.team_ids, query.season_ids)
    if query.metric == "ridge":
        wanted = scopes.complete_only(wanted, store.loads(), dimension)
    if wanted.isEmpty():
        raise ValueError("no loaded team-seasons match the query")
    if query.metric == "ridge":
        games, players = scopes.whole_games(store.games(), store.game_players(), wanted)
        rows = ridge.ridge(
            games,
            players,
            teams=query.team_ids or None,
            min_games=query.min_games,
            settings=[query.setting],
            **query.minutes,
        )
        return quality.enforced(rows.drop("setting_id"), ridge.observation_issues(games, players))
    games, players = scopes.own_sides(store.games(), store.game_players(), wanted)
    filters = {
        "min_games_with": query.min_games_with,
        "min_games_without": query.min_games_without,
        **query.minutes,
    }
    if query.metric == "wowy_shrunk":
        rows = with_without.wowy_shrunk(games, players, prior_games=query.prior_games, **filters)
    else:
        rows = with_without.wowy(games, players, **filters)
    return quality.enforced(rows, with_without.lineup_issues(games, players))


def _with_season(rows: DataFrame) -> DataFrame:
    parsed = parse_season_id(F.col("season_id"))
    return rows.withColumn("season", season_text(parsed["start_year"])).withColumn(
        "season_type", type_text(parsed["season_type"])
    )


def _is_current(store: Store, query: MetricQuery, fingerprint: str | None) -> DataFrame:
    entries = store.entry(query.metric, query.key)
    return entries.filter((F.col("source_fingerprint") == (fingerprint or "")) & (F.col("row_count") > 0))


def resolve(
    store: Store, dimension: DataFrame, query: MetricQuery, *, recalculate: bool = False
) -> tuple[DataFrame, str]:
    """(rows, 'cache' or 'live'). Stored rows are used while their sources have not changed."""
    store.record_request(query.metric, query.key)
    if not recalculate and not _is_current(store, query, current_fingerprint(store, query)).isEmpty():
        minimums = (
            {"games": query.min_games}
            if query.metric == "ridge"
            else {"games_with": query.min_games_with, "games_without": query.min_games_without}
        )
        rows = store.stored_rows(query.metric, query.key, query.season_ids, min_games=minimums, **query.minutes)
        return _with_season(rows.drop("metric_id", "key_hash", "metric_cache_key")), "cache"
    return live_rows(store, dimension, query), "live"


def resolved_leaderboard(store: Store, dimension: DataFrame, query: MetricQuery, **options) -> tuple[DataFrame, str]:
    rows, source = resolve(store, dimension, query, **options)
    return leaderboard(rows, query.metric, query.top_n), source


def ensure_cached(store: Store, dimension: DataFrame, query: MetricQuery) -> tuple[str, int]:
    """('cached' or 'built', row count) of a calculation; it is stored without the filters of a query."""
    query = query.unfiltered()
    fingerprint = current_fingerprint(store, query)
    if fingerprint is None:
        raise ValueError("cannot store a metric without loaded games")
    version = BUILD_VERSIONS[query.metric]
    current = _is_current(store, query, fingerprint).filter(F.col("build_version") == version).first()
    if current:
        return "cached", current["row_count"]
    rows = live_rows(store, dimension, query)
    return "built", store.replace_metric(query.metric, query.key, rows, build_version=version, fingerprint=fingerprint)


def pinned_queries(store: Store, metric: str) -> list[MetricQuery]:
    """All loaded teams over all regular seasons, all playoffs, and the years with both."""
    loaded = scopes.available(store.loads())
    identity = scopes.season_id(F.col("season"), F.col("season_type"))
    code = scopes.type_code(F.col("season_type"))
    both = scopes.combined_scopes(loaded)
    queries = []
    for group in (loaded.filter(code == "REGULAR"), loaded.filter(code == "PLAYOFFS"), both):
        # As many ids as there are seasons and teams.
        row = group.agg(F.collect_set(identity).alias("seasons"), F.collect_set("team_id").alias("teams")).first()
        if row["seasons"]:
            queries.append(MetricQuery(metric, row["seasons"], row["teams"]))
    return queries


def retained_queries(store: Store, metric: str) -> list[MetricQuery]:
    """The pinned calculations and then the most requested others, up to the limit."""
    pinned = pinned_queries(store, metric)
    used = usage.refreshable(usage.keys_by_usage(store.usage_counts(), metric), metric, store.loads())
    keys = F.array(*[F.lit(q.key) for q in pinned]) if pinned else F.array().cast("array<string>")
    pinned_keys = store.spark.range(1).select(F.explode(keys).alias("metric_cache_key")).distinct()
    rows = usage.retained_keys(pinned_keys, used).collect()
    by_key = {q.key: q for q in pinned}
    return [by_key.get(r["metric_cache_key"]) or query_of_key(r["metric_cache_key"]) for r in rows]


def refresh_metric(store: Store, dimension: DataFrame, metric: str) -> list[tuple[str, str, int]]:
    """Build every retained calculation of a metric and drop the others: (key, status, rows) each."""
    results = []
    for query in retained_queries(store, metric):
        status, rows = ensure_cached(store, dimension, query)
        results.append((query.key, status, rows))
    store.prune(metric, [key for key, _, _ in results])
    return results


def audit_store(store: Store, dimension: DataFrame) -> DataFrame:
    """All checks of the game tables and the stored metrics."""
    issues = quality.audit(store.games(), store.game_players(), store.loads(), dimension)
    entries = store.cache_entries().drop("key_hash")
    for metric in METRICS:
        rows = store.values(metric)
        numbers = ["coefficient"] if metric == "ridge" else ["value", "avg_margin_with", "avg_margin_without"]
        counts = ["games"] if metric == "ridge" else ["games_with", "games_without"]
        issues = issues.unionByName(quality.metric_row_issues(rows, entries, metric, numbers, counts))
    stored = None
    for metric in METRICS:
        part = store.values(metric).select("metric_id", "metric_cache_key", "season_id")
        stored = part if stored is None else stored.unionByName(part)
    fingerprints = entry_fingerprints(entries, store.loads())
    return issues.unionByName(quality.store_relation_issues(stored, entries, fingerprints))


@dataclass(frozen=True)
class Rebuilt:
    """What a rebuild did; ``failed_stage`` is None if every stage passed."""

    metrics: dict[str, list[tuple[str, str, int]]]
    failed_stage: str | None
    message: str | None


def rebuild(store: Store, dimension: DataFrame, ingested, metrics: list[str] | None = None, *, strict: bool = True) -> Rebuilt:
    """Store ingested tables, refresh the metrics in order, audit; stop at the first stage that fails.

    Team-seasons that could be ingested are stored even if others failed.
    """
    failures = getattr(ingested, "failures", None)
    failed = failures is not None and not failures.isEmpty()
    if failed:
        store.append_failures(failures)
    if not ingested.loads.isEmpty():
        store.replace_scopes(ingested.games, ingested.game_players, ingested.loads)
    if failed:
        return Rebuilt({}, "ingest", "some team-seasons could not be ingested")
    done: dict[str, list[tuple[str, str, int]]] = {}
    for metric in metrics or METRICS:
        try:
            done[metric] = refresh_metric(store, dimension, metric)
        except (ValueError, Py4JJavaError) as error:
            return Rebuilt(done, metric, quality.raised_text(error))
    issues = audit_store(store, dimension)
    if strict and not issues.isEmpty():
        return Rebuilt(done, "audit", quality.summary_text(issues, 3))
    return Rebuilt(done, None, None)
