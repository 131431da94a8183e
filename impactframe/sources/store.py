"""Canonical and metric tables as versioned parquet under one root folder.

Every table has keys that its rows are replaced and dropped by: a team-season, or a metric and cache key. A commit
replaces the keys of all its tables at once (see `snapshots`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from impactframe import schemas
from impactframe.operators import quality, usage
from impactframe.operators.with_without import minute_filter
from impactframe.sources.request_log import RequestLog
from impactframe.sources.snapshots import Part, Snapshots

SCOPE_FOLDERS = ("season_type", "season")
KEY_FOLDERS = ("metric_id", "key_hash")
SCOPED = ("games", "game_players", "loads")


def scope_key() -> Column:
    return F.concat_ws("|", "season_type", "season", "team_id")


def metric_key() -> Column:
    return F.concat_ws("|", "metric_id", "key_hash")


def key_hash(key: Column) -> Column:
    """Folder name of a cache key."""
    return F.concat(F.lit("k"), F.substring(F.sha2(key, 256), 1, 32))


_ENTRIES = schemas.CACHE_ENTRIES + ", key_hash string"


def _value_table(metric: str) -> str:
    return "ridge_values" if metric == "ridge" else "wowy_values"


def _value_schema(metric: str) -> str:
    return (schemas.RIDGE_VALUES if metric == "ridge" else schemas.WOWY_VALUES) + ", metric_id string, key_hash string"


def _names(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(",")]


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    @property
    def snapshots(self) -> Snapshots:
        return Snapshots(self.spark, self.root)

    # --- reading ----------------------------------------------------------

    def _read(self, name: str, schema: str) -> DataFrame:
        """A log with its fixed schema; empty if nothing was written yet."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def games(self) -> DataFrame:
        return self.snapshots.read("games", schemas.GAMES, scope_key())

    def game_players(self) -> DataFrame:
        return self.snapshots.read("game_players", schemas.GAME_PLAYERS, scope_key())

    def loads(self) -> DataFrame:
        return self.snapshots.read("loads", schemas.LOADS, scope_key())

    def cache_entries(self) -> DataFrame:
        return self.snapshots.read("cache_entries", _ENTRIES, metric_key())

    def values(self, metric: str) -> DataFrame:
        return self.snapshots.read(_value_table(metric), _value_schema(metric), metric_key()).filter(F.col("metric_id") == metric)

    @property
    def requests(self) -> RequestLog:
        return RequestLog(self.spark, f"{self.root}/requests")

    def usage_counts(self) -> DataFrame:
        """How often and when last each key was asked for, with the plain log that older stores have."""
        older = usage.usage_counts(self._read("usage_log", schemas.USAGE_LOG))
        return usage.added_counts(self.requests.counts().unionByName(older))

    def entry(self, metric: str, key: str) -> DataFrame:
        """The cache entry of one key, or no row."""
        return self.cache_entries().filter(
            (F.col("metric_id") == metric) & (F.col("key_hash") == key_hash(F.lit(key))) & (F.col("metric_cache_key") == key)
        )

    def keys(self, metric: str) -> DataFrame:
        return self.cache_entries().filter(F.col("metric_id") == metric).select("metric_cache_key").orderBy("metric_cache_key")

    def stored_rows(
        self,
        metric: str,
        key: str,
        season_ids: list[str],
        *,
        min_average_minutes: float | None = None,
        min_total_minutes: float | None = None,
        min_games: dict[str, int] | None = None,
    ) -> DataFrame:
        """Stored rows of one key that pass the filters; unknown minutes fail a minimum, as in a live query."""
        rows = self.values(metric).filter(
            (F.col("key_hash") == key_hash(F.lit(key)))
            & (F.col("metric_cache_key") == key)
            & F.col("season_id").isin(season_ids)
            & minute_filter(min_average_minutes, min_total_minutes)
        )
        for column, minimum in (min_games or {}).items():
            rows = rows.filter(F.col(column) >= minimum)
        entries = self.entry(metric, key).select("metric_id", "metric_cache_key")
        return rows.join(entries, ["metric_id", "metric_cache_key"], "left_semi")

    # --- writing ----------------------------------------------------------

    def replace_scopes(self, games: DataFrame, players: DataFrame, loads: DataFrame) -> None:
        """Replace the team-seasons that these rows belong to, in all three tables; other team-seasons stay.

        Games outside the team-seasons of ``loads`` or players without a game are an error, found in the written files
        before the switch, so that the sources are read once and the old state stays.
        """

        def check(staged: dict[str, DataFrame]) -> None:
            quality.require_clean(quality.write_issues(staged["games"], staged["game_players"], staged["loads"]))

        self._commit_scopes({"games": games, "game_players": players, "loads": loads}, SCOPED, check)

    def upsert_loads(self, loads: DataFrame) -> None:
        """Insert load rows, replacing those of the same team, season and type."""
        self._commit_scopes({"loads": loads}, ("loads",))

    def _commit_scopes(
        self,
        frames: dict[str, DataFrame],
        tables: tuple[str, ...],
        check: Callable[[dict[str, DataFrame]], None] | None = None,
    ) -> None:
        layout = {"games": schemas.GAMES, "game_players": schemas.GAME_PLAYERS, "loads": schemas.LOADS}
        parts = {
            name: Part(df.select(*_names(layout[name])), scope_key(), () if name == "loads" else SCOPE_FOLDERS)
            for name, df in frames.items()
        }
        snapshots = self.snapshots
        version = snapshots.stage(parts)
        staged = {name: snapshots.staged(version, name, layout[name]) for name in parts}
        if check is not None:
            check(staged)
        added = None
        for name in parts:
            keys = staged[name].select(F.lit(name).alias("table_name"), scope_key().alias("live_key")).distinct()
            added = keys if added is None else added.unionByName(keys)
        # A team-season without rows in one of the tables loses its old ones there, too.
        scopes = added.select("live_key").distinct()
        snapshots.publish(version, added, lambda lines: lines.filter(F.col("table_name").isin(*tables)).join(scopes, "live_key", "left_semi"))

    def replace_metric(self, metric: str, key: str, rows: DataFrame, *, build_version: str, fingerprint: str) -> int:
        """Replace the rows of one key and its entry; returns the number of rows."""
        table, schema = _value_table(metric), _value_schema(metric)
        hashed = key_hash(F.lit(key))
        keyed = rows.withColumns({"metric_cache_key": F.lit(key), "metric_id": F.lit(metric), "key_hash": hashed}).select(*_names(schema))
        snapshots = self.snapshots
        version = snapshots.stage({table: Part(keyed, metric_key(), KEY_FOLDERS)})
        count = snapshots.staged(version, table, schema).count()
        entry = self.spark.range(1).select(
            F.lit(metric).alias("metric_id"),
            F.lit(key).alias("metric_cache_key"),
            F.lit(build_version).alias("build_version"),
            F.lit(fingerprint).alias("source_fingerprint"),
            F.lit(count).cast("bigint").alias("row_count"),
            F.current_timestamp().alias("updated_at"),
            hashed.alias("key_hash"),
        )
        snapshots.write_part(version, "cache_entries", entry)
        own = F.concat_ws("|", F.lit(metric), hashed)
        names = [table, "cache_entries"] if count else ["cache_entries"]
        added = self.spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("table_name"), own.alias("live_key"))
        snapshots.publish(version, added, lambda lines: lines.filter(F.col("table_name").isin(table, "cache_entries") & (F.col("live_key") == own)))
        return count

    def prune(self, metric: str, keys: list[str]) -> None:
        """Drop every key of a metric that is not listed, rows and entries at once."""
        kept = [F.concat_ws("|", F.lit(metric), key_hash(F.lit(k))) for k in keys]
        listed = F.lit(False)
        for own in kept:
            listed = listed | (F.col("live_key") == own)
        of_metric = F.col("table_name").isin(_value_table(metric), "cache_entries") & F.col("live_key").startswith(f"{metric}|")
        self.snapshots.publish(None, None, lambda lines: lines.filter(of_metric & ~listed))

    def compact(self, table: str) -> None:
        """Write the live rows of a scoped table once more, so that few folders hold them."""
        frame = {"games": self.games, "game_players": self.game_players, "loads": self.loads}[table]()
        self._commit_scopes({table: frame}, (table,))

    def vacuum(self) -> list[str]:
        """Delete files that no reader of the current state needs."""
        return self.snapshots.vacuum()

    def record_request(self, metric: str, key: str) -> None:
        """Add one request to the log."""
        row = self.spark.range(1).select(
            F.lit(metric).alias("metric_id"), F.lit(key).alias("metric_cache_key"), F.current_timestamp().alias("requested_at")
        )
        self.requests.add(row)

    def append_failures(self, failures: DataFrame) -> None:
        """Add ingest failures to the log, one JSON object per line."""
        failures.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(f"{self.root}/ingest_failures")
