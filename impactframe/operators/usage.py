"""Which cached calculations are asked for, and which to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from impactframe.functions.keys import is_canonical_key, key_field, key_seasons, key_teams
from impactframe.functions.seasons import season_id
from impactframe.operators.scopes import available

RETAINED_KEYS = 10


def usage_counts(log: DataFrame) -> DataFrame:
    """How often and when last each key was asked for."""
    return log.groupBy("metric_id", "metric_cache_key").agg(
        F.count("*").alias("query_count"), F.max("requested_at").alias("last_requested_at")
    )


def added_counts(counts: DataFrame) -> DataFrame:
    """Counts of several parts of a log as those of the whole."""
    return counts.groupBy("metric_id", "metric_cache_key").agg(
        F.sum("query_count").alias("query_count"), F.max("last_requested_at").alias("last_requested_at")
    )


def keys_by_usage(counts: DataFrame, metric: str) -> DataFrame:
    order = [F.desc("query_count"), F.desc("last_requested_at"), F.asc("metric_cache_key")]
    return counts.filter(F.col("metric_id") == metric).orderBy(*order)


def refreshable(keys: DataFrame, metric: str, loads: DataFrame) -> DataFrame:
    """Keys that are canonical and whose seasons and teams are all loaded. Keys for all teams are not rebuilt."""
    key = F.col("metric_cache_key")
    candidates = keys.filter((key_field(key, "metric") == metric) & is_canonical_key(key, metric)).filter(
        F.size(key_teams(key)) > 0
    )

    def season_part(season: Column) -> Column:
        return F.concat(F.lit("season "), season)

    def team_part(team: Column) -> Column:
        return F.concat(F.lit("team "), team.cast("string"))

    loaded_season = season_id(F.col("season"), F.col("season_type"))
    known = (
        available(loads)
        .select(F.explode(F.array(season_part(loaded_season), team_part(F.col("team_id")))).alias("part"))
        .distinct()
        .withColumn("_known", F.lit(True))
    )
    parts = F.concat(F.transform(key_seasons(key), season_part), F.transform(key_teams(key), team_part))
    return (
        candidates.withColumn("part", F.explode(parts))
        .join(known, "part", "left")
        .groupBy(*keys.columns)
        .agg(F.bool_and(F.col("_known").isNotNull()).alias("_covered"))
        .filter("_covered")
        .drop("_covered")
    )


def retained_keys(pinned: DataFrame, used: DataFrame, limit: int = RETAINED_KEYS) -> DataFrame:
    """All pinned keys, then the most used others until ``limit`` keys are kept."""
    pinned = pinned.select(
        "metric_cache_key", F.lit(0).alias("tier"), F.lit(0).cast("bigint").alias("query_count"),
        F.lit(None).cast("timestamp").alias("last_requested_at"),
    )
    others = used.join(pinned.select("metric_cache_key"), "metric_cache_key", "left_anti").select(
        "metric_cache_key", F.lit(1).alias("tier"), "query_count", "last_requested_at"
    )
    order = [F.asc("tier"), F.desc("query_count"), F.desc("last_requested_at"), F.asc("metric_cache_key")]
    # Not more than ``limit`` others can be kept; the pinned keys before them use up some of it.
    places = pinned.agg(F.greatest(F.lit(limit) - F.count("*"), F.lit(0)).alias("_places"))
    best = others.orderBy(*order).limit(limit)
    ranked = best.select("*", F.row_number().over(W.orderBy(*order)).alias("_n")).join(F.broadcast(places), F.col("_n") <= F.col("_places"))
    return pinned.unionByName(ranked.drop("_n", "_places")).orderBy(*order)
