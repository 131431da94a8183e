"""Fixed schemas (DDL text) of the canonical tables, and their keys."""

from __future__ import annotations

GAMES = (
    "game_id string, season string, season_type string, game_date date, team_id bigint, "
    "opponent_team_id bigint, is_home boolean, margin double, source string"
)
GAME_PLAYERS = (
    "game_id string, season string, season_type string, team_id bigint, player_id bigint, "
    "player_name string, appeared boolean, minutes double"
)
LOADS = (
    "team_id bigint, season string, season_type string, source_path string, source_snapshot string, "
    "source_kind string, build_version string, refreshed_at timestamp, games_row_count bigint, "
    "game_players_row_count bigint, expected_games_row_count bigint, skipped_games_row_count bigint"
)
CACHE_ENTRIES = (
    "metric_id string, metric_cache_key string, build_version string, source_fingerprint string, "
    "row_count bigint, updated_at timestamp"
)
RIDGE_VALUES = (
    "metric_cache_key string, season_id string, player_id bigint, player_name string, "
    "coefficient double, games bigint, average_minutes double, total_minutes double"
)
WOWY_VALUES = (
    "metric_cache_key string, season_id string, player_id bigint, player_name string, value double, "
    "games_with bigint, games_without bigint, avg_margin_with double, avg_margin_without double, "
    "average_minutes double, total_minutes double, raw_wowy_score double"
)
USAGE_LOG = ("metric_id string, metric_cache_key string, requested_at timestamp")
USAGE_COUNTS = "metric_id string, metric_cache_key string, query_count bigint, last_requested_at timestamp"
ISSUES = ("table string, key string, message string")
TEAM_HISTORY = (
    "team_id bigint, season string, abbreviation string, franchise_id string, lookup_abbreviation string"
)

# A scope is one team in one season of one type.
SCOPE = ["team_id", "season", "season_type"]
SEASON = ["season", "season_type"]
# One team's side of one game.
SIDE = ["season", "season_type", "game_id", "team_id"]
# One game, both sides.
GAME = ["season", "season_type", "game_id"]
