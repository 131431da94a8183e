"""Game-level ridge regression of the margin on who played.

Every game gives two mirrored rows: the home side with weights +w and margin m,
the away side with weights -w and margin -m. Columns are the intercept, the home
court, the players (exposure share of the team's minutes, five per side), a team
effect and an opponent effect. Players, teams and opponents are penalised.

The cross products are summed inside each task into matrix blocks of a fixed size (`gram`), so the pairs of a game
are never shuffled, and the systems are solved from these blocks (`block_solve`). Seasons of more columns than a block
has are solved from their rows (`row_solve`), unless a penalty is so small that the system may be singular.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactframe.functions.scores import PENALTY_MODES, player_penalty
from impactframe.functions.seasons import season_id
from impactframe.operators import block_solve, gram, row_solve
from impactframe.operators.with_without import game_number, minute_filter, positive_minutes
from impactframe.schemas import GAME, SEASON, SIDE
from impactframe.session import keep

LINEUP_WEIGHT = 5.0

# A regression column is one number: entity id * 8 + kind.
KINDS = {"intercept": 0, "home_court": 1, "player": 2, "team": 3, "opponent": 4}
TARGET = gram.TARGET


@dataclass(frozen=True)
class Setting:
    """One way to penalise a fit."""

    alpha: float = 10.0
    mode: str = "uniform"
    strength: float = 1.0
    minute_scale: float = 48.0

    def __post_init__(self) -> None:
        if self.alpha < 0:
            raise ValueError("alpha must be non-negative")
        if self.mode not in PENALTY_MODES:
            raise ValueError("mode must be 'uniform', 'game-count' or 'minutes'")
        if self.strength < 0:
            raise ValueError("strength must be non-negative")
        if self.minute_scale <= 0:
            raise ValueError("minute_scale must be positive")


def column_code(kind: str, entity: Column | None = None) -> Column:
    code = F.lit(KINDS[kind]).cast("bigint")
    return code if entity is None else entity * 8 + code


# --- observations ---------------------------------------------------------


def _sides(games: DataFrame, players: DataFrame) -> DataFrame:
    """Team-games with the team's positive minutes (null if it has none)."""
    totals = players.filter(positive_minutes()).groupBy(*SIDE).agg(F.sum("minutes").alias("team_minutes"))
    return games.select(*SIDE, "game_date", "is_home", "margin", "opponent_team_id").join(totals, SIDE, "left")


def _paired(games: DataFrame, players: DataFrame) -> DataFrame:
    home = F.col("is_home")
    return (
        _sides(games, players)
        .groupBy(*GAME)
        .agg(
            F.count("*").alias("rows"),
            F.count_if(home).alias("home_rows"),
            F.max(F.when(home, F.col("game_date"))).alias("game_date"),
            F.max(F.when(home, F.col("margin"))).alias("margin"),
            F.max(F.when(home, F.col("team_id"))).alias("home_team_id"),
            F.max(F.when(~home, F.col("team_id"))).alias("away_team_id"),
            F.max(F.when(home, F.col("team_minutes"))).alias("home_minutes"),
            F.max(F.when(~home, F.col("team_minutes"))).alias("away_minutes"),
        )
    )


def _is_observation() -> Column:
    return (
        (F.col("rows") == 2)
        & (F.col("home_rows") == 1)
        & F.col("home_minutes").isNotNull()
        & F.col("away_minutes").isNotNull()
    )


def observations(games: DataFrame, players: DataFrame) -> DataFrame:
    """One row per game that has one home side, one away side and minutes on both."""
    return (
        _paired(games, players)
        .filter(_is_observation())
        .withColumn("season_id", season_id(F.col("season"), F.col("season_type")))
        .drop("rows", "home_rows")
    )


def observation_issues(games: DataFrame, players: DataFrame) -> DataFrame:
    """Why a game cannot become an observation."""
    message = (
        F.when(F.col("rows") != 2, F.format_string("expected two team rows, found %d", "rows"))
        .when(F.col("home_rows") != 1, F.lit("expected one home row and one away row"))
        .when(F.col("home_minutes").isNull(), F.lit("no home player with positive minutes"))
        .otherwise(F.lit("no away player with positive minutes"))
    )
    return _paired(games, players).filter(~_is_observation()).select(
        F.lit("games").alias("table"), F.format_string("game_id=%s", "game_id").alias("key"), message.alias("message")
    )


def _minutes_in_games(obs: DataFrame, players: DataFrame) -> DataFrame:
    """Positive-minute player rows of the observed games, with the side they played on."""

    def side(team: str, minutes: str, sign: float) -> Column:
        return F.struct(
            F.col(team).alias("team_id"), F.col(minutes).alias("team_minutes"), F.lit(sign).alias("sign")
        )

    sides = obs.select(
        "season_id",
        *GAME,
        F.inline(
            F.array(side("home_team_id", "home_minutes", 1.0), side("away_team_id", "away_minutes", -1.0))
        ),
    )
    return players.filter(positive_minutes()).select(*SIDE, "player_id", "player_name", "minutes").join(sides, SIDE)


def exposure_weights(obs: DataFrame, players: DataFrame) -> DataFrame:
    """Signed share of the team's minutes per game and player, five shares per side.

    A player on both sides of a game counts for the away side.
    """
    share = F.col("minutes") / F.col("team_minutes") * LINEUP_WEIGHT
    home = F.col("sign") > 0
    return (
        _minutes_in_games(obs, players)
        .groupBy("season_id", "game_id", "player_id")
        .agg(
            F.max(F.when(home, share)).alias("_home"),
            F.max(F.when(~home, share)).alias("_away"),
            F.max(F.when(home, F.col("minutes"))).alias("_home_minutes"),
            F.max(F.when(~home, F.col("minutes"))).alias("_away_minutes"),
        )
        .select(
            "season_id",
            "game_id",
            "player_id",
            F.coalesce(-F.col("_away"), F.col("_home")).alias("weight"),
            F.coalesce("_away_minutes", "_home_minutes").alias("minutes"),
        )
    )


def player_exposure(weights: DataFrame) -> DataFrame:
    """Observed games and minutes per season and player."""
    return weights.groupBy("season_id", "player_id").agg(
        F.count("*").alias("games"), F.sum("minutes").alias("minutes")
    )


# --- cross products -------------------------------------------------------


def game_rows(obs: DataFrame, weights: DataFrame) -> DataFrame:
    """The two mirrored rows of every game in long form: season_id, game_id, mirror (1 home, -1 away), code, x."""

    def entry(mirror: int, code: Column, x: Column) -> Column:
        return F.struct(F.lit(mirror).alias("mirror"), code.alias("code"), x.cast("double").alias("x"))

    def side(mirror: int, own: str, other: str) -> list[Column]:
        return [
            entry(mirror, F.lit(TARGET).cast("bigint"), F.col("margin") * mirror),
            entry(mirror, column_code("intercept"), F.lit(1.0)),
            entry(mirror, column_code("home_court"), F.lit(mirror)),
            entry(mirror, column_code("team", F.col(own)), F.lit(1.0)),
            entry(mirror, column_code("opponent", F.col(other)), F.lit(1.0)),
        ]

    both = side(1, "home_team_id", "away_team_id") + side(-1, "away_team_id", "home_team_id")
    heads = obs.select("season_id", "game_id", F.inline(F.array(*both)))
    player = column_code("player", F.col("player_id"))
    shares = F.array(*[entry(sign, player, F.col("weight") * sign) for sign in (1, -1)])
    return heads.unionByName(weights.select("season_id", "game_id", F.inline(shares)))


def game_vectors(obs: DataFrame, weights: DataFrame) -> DataFrame:
    """The rows of ``game_rows`` with half the entries: season_id, codes, values, target, factor.

    A game's two mirrored rows give the same squares as half those of their difference and their sum. The difference
    has the players; the sum knows only which teams met, so one row stands for all games of a pair, counted.
    """
    players = weights.filter(F.col("player_id").isNotNull())
    entry = F.struct(column_code("player", F.col("player_id")).alias("code"), (F.col("weight") * 2.0).alias("x"))
    lineups = players.groupBy("season_id", "game_id").agg(F.collect_list(entry).alias("lineup"))
    # A game without a margin leaves its columns without a target.
    margin = F.coalesce("margin", F.lit(float("nan")))
    home, away = F.col("home_team_id"), F.col("away_team_id")
    sides = [column_code("home_court"), column_code("team", home), column_code("team", away), column_code("opponent", away), column_code("opponent", home)]
    signs = [F.lit(v) for v in (2.0, 1.0, -1.0, 1.0, -1.0)]
    differences = obs.join(lineups, ["season_id", "game_id"], "left").select(
        "season_id",
        F.concat(F.array(*sides), F.coalesce(F.col("lineup.code"), F.array().cast("array<bigint>"))).alias("codes"),
        F.concat(F.array(*signs), F.coalesce(F.col("lineup.x"), F.array().cast("array<double>"))).alias("values"),
        (margin * 2.0).alias("target"),
        F.lit(0.5).alias("factor"),
    )
    pairs = obs.groupBy("season_id", F.least(home, away).alias("low"), F.greatest(home, away).alias("high")).agg(
        F.count("*").alias("n"), (F.sum(margin) * 0.0).alias("target")
    )
    both = [column_code("intercept")] + [column_code(kind, F.col(team)) for kind in ("team", "opponent") for team in ("low", "high")]
    sums = pairs.select(
        "season_id",
        F.array(*both).alias("codes"),
        F.array(*[F.lit(v) for v in (2.0, 1.0, 1.0, 1.0, 1.0)]).alias("values"),
        "target",
        (F.col("n") * 0.5).alias("factor"),
    )
    return differences.unionByName(sums)


def normal_equations(obs: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(Gram matrix upper triangle, target vector) per season, cell by cell."""
    # The rows read the observations twice, and the weights read them once more.
    vectors = game_vectors(keep(obs), keep(weights))
    inner = gram.row_cells(vectors).withColumnsRenamed({"second": "code_1", "first": "code_2"})
    entries = vectors.select("season_id", F.inline(F.arrays_zip("codes", "values")), (F.col("target") * F.col("factor")).alias("y"))
    target = entries.groupBy("season_id", F.col("codes").alias("code")).agg(F.sum(F.col("values") * F.col("y")).alias("value"))
    return inner.select("season_id", "code_1", "code_2", "value"), target


# --- penalties and solve --------------------------------------------------


def eligible(exposure: DataFrame, min_games: int) -> DataFrame:
    """Only players with enough observed games become columns; the others still share the minutes."""
    return exposure.filter(F.col("games") >= min_games)


def penalties(exposure: DataFrame, settings: list[Setting]) -> DataFrame:
    """The penalty of every player column under every setting."""
    options = F.array(
        *[
            F.struct(F.lit(i).alias("setting_id"), *[F.lit(v).alias(k) for k, v in asdict(s).items()])
            for i, s in enumerate(settings)
        ]
    )
    penalty = player_penalty(
        F.col("alpha"), F.col("mode"), F.col("strength"), F.col("minute_scale"), F.col("games"), F.col("minutes")
    )
    return exposure.select("season_id", "player_id", "games", "minutes", F.inline(options)).select(
        "season_id",
        "setting_id",
        column_code("player", F.col("player_id")).alias("code"),
        penalty.alias("penalty"),
    )


def column_penalties(places: gram.Layout, exposure: DataFrame, settings: list[Setting]) -> DataFrame:
    """The penalty of every column under every setting: season_id, setting_id, position, penalty.

    A season without an eligible player has none and gives no fit.
    """
    kind = F.col("code") % 8
    own = F.coalesce("penalty", F.when(kind > KINDS["home_court"], F.col("alpha")).otherwise(0.0)).alias("penalty")
    options = F.array(
        *[F.struct(F.lit(i).alias("setting_id"), F.lit(float(s.alpha)).alias("alpha")) for i, s in enumerate(settings)]
    )
    every = places.places.filter(F.col("code") != TARGET).select("*", F.inline(options))
    of_players = penalties(exposure, settings)
    fitted = exposure.select("season_id").distinct()
    return (
        every.join(fitted, "season_id", "left_semi")
        .join(of_players, ["season_id", "setting_id", "code"], "left")
        .select("season_id", "setting_id", "position", own)
    )


def fit(
    obs: DataFrame, weights: DataFrame, settings: list[Setting], *, min_games: int = 1, block: int = gram.BLOCK
) -> DataFrame:
    """Coefficients of every column, season and setting: season_id, setting_id, kind, entity_id, coefficient."""
    # Both are read by the products and the penalties.
    obs, weights = keep(obs), keep(weights)
    exposure = keep(eligible(player_exposure(weights), min_games))
    kept = weights.join(exposure.select("season_id", "player_id"), ["season_id", "player_id"], "left_semi")
    rows = game_rows(obs, kept)
    places = gram.layout(rows)
    wanted = column_penalties(places, exposure, settings)
    wide = _regular_seasons(places, exposure, settings, block)
    in_rows = F.col("season_id").isin(wide)
    parts = []
    if len(wide) < len(places.columns):
        narrow = places.without(wide)
        rest = ~in_rows if wide else F.lit(True)
        blocks = gram.gram_blocks(rows.filter(rest), narrow, block)
        parts.append(block_solve.solve(blocks, narrow, wanted.filter(rest), block))
    if wide:
        vectors = game_vectors(obs, kept).filter(in_rows)
        parts.append(row_solve.solve(vectors, places, wanted.filter(in_rows), wide, len(settings)))
    return with_kinds(reduce(DataFrame.unionByName, parts))


def _regular_seasons(places: gram.Layout, exposure: DataFrame, settings: list[Setting], block: int) -> list[str]:
    """Seasons of more than one block whose penalties alone keep every pivot above the limit of a singular system.

    A pivot is at least its column's penalty, and no column has more squares than all rows have, of at most a whole
    line-up each. The intercept and the home court, which have no penalty, meet no other column before them.
    """
    wide = [s for s, n in places.columns.items() if s is not None and n > block]
    if not wide:
        return []
    least = penalties(exposure, settings).groupBy("season_id").agg(F.min("penalty")).collect()
    lowest = {s: min(float(p), *(float(x.alpha) for x in settings)) for s, p in least}
    return sorted(s for s in wide if lowest.get(s, 0.0) > block_solve.SINGULAR * LINEUP_WEIGHT**2 * places.rows[s])


def with_kinds(coefficients: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])
    return coefficients.select(
        "season_id",
        "setting_id",
        F.element_at(names, (F.col("code") % 8 + 1).cast("int")).alias("kind"),
        F.when(F.col("code") % 8 > KINDS["home_court"], F.shiftright("code", 3)).alias("entity_id"),
        "coefficient",
    )


def model_terms(coefficients: DataFrame) -> DataFrame:
    """Intercept, home court, team and opponent effects."""
    return coefficients.filter(F.col("kind") != "player")


# --- player-season records ------------------------------------------------


def player_context(obs: DataFrame, players: DataFrame) -> DataFrame:
    """Name and minutes per season and player over the observed games."""
    spellings = (
        _minutes_in_games(obs, players)
        .groupBy("season_id", *SEASON, "player_id", "player_name", "team_id")
        .agg(
            F.sum("minutes").alias("total_minutes"),
            F.count("*").alias("minute_games"),
            F.max(game_number()).alias("last_game"),
        )
    )
    return (
        spellings.groupBy("season_id", *SEASON, "player_id")
        .agg(
            F.sum("total_minutes").alias("total_minutes"),
            F.sum("minute_games").alias("minute_games"),
            F.max(F.struct("team_id", "last_game", "player_name"))["player_name"].alias("player_name"),
        )
        .withColumn("average_minutes", F.try_divide("total_minutes", "minute_games"))
        .drop("minute_games")
    )


def usable_games(games: DataFrame, players: DataFrame, teams: list[int] | None = None) -> DataFrame:
    """Rows of games where both teams have positive minutes and a requested team played."""
    minutes = players.filter(positive_minutes()).select(*SIDE).distinct().withColumn("_played", F.lit(True))
    requested = F.lit(True) if teams is None else F.col("team_id").isin(teams)
    opponents = minutes.select(
        *GAME, F.col("team_id").alias("opponent_team_id"), F.col("_played").alias("_opponent_played")
    )
    complete = (
        games.filter(requested)
        .join(minutes, SIDE, "left_semi")
        .join(opponents, [*GAME, "opponent_team_id"], "left_semi")
        .select(*GAME)
        .distinct()
    )
    return games.join(complete, GAME, "left_semi")


def ridge(
    games: DataFrame,
    players: DataFrame,
    *,
    teams: list[int] | None = None,
    min_games: int = 35,
    settings: list[Setting] | None = None,
    min_average_minutes: float | None = 30.0,
    min_total_minutes: float | None = 600.0,
) -> DataFrame:
    """Player-season ridge records that pass the filters, for every setting."""
    settings = settings or [Setting()]
    obs = observations(games, players)
    if teams is not None:
        obs = obs.filter(F.col("home_team_id").isin(teams) | F.col("away_team_id").isin(teams))
    weights = exposure_weights(obs, players)
    coefficients = fit(obs, weights, settings, min_games=min_games)
    context = player_context(obs, players)
    exposure = player_exposure(weights).select("season_id", "player_id", "games")
    return (
        coefficients.filter(F.col("kind") == "player")
        .withColumnRenamed("entity_id", "player_id")
        .join(exposure, ["season_id", "player_id"])
        .join(context, ["season_id", "player_id"])
        .filter(minute_filter(min_average_minutes, min_total_minutes))
        .select(
            "setting_id",
            "season_id",
            *SEASON,
            "player_id",
            "player_name",
            "coefficient",
            "games",
            "average_minutes",
            "total_minutes",
        )
    )
