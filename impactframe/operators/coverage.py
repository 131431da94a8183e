"""How far back the sources reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def earliest_with(df: DataFrame, time: str, conditions: dict[str, Column], keep: list[str]) -> DataFrame:
    """For each named condition, the earliest row that meets it: name, time and the kept columns."""
    row = F.struct(F.col(time), *keep)
    first = df.filter(F.col(time).isNotNull()).agg(
        *[F.min(F.when(condition, row)).alias(name) for name, condition in conditions.items()]
    )
    found = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("row")) for n in conditions])
    return first.select(F.inline(found)).select("name", "row.*").filter(F.col(time).isNotNull())


def quarter_coverage(team_statistics: DataFrame) -> DataFrame:
    """Earliest game with each quarter's score, and with all four."""
    quarters = [f"q{n}Points" for n in range(1, 5)]
    has = {q: F.col(q).isNotNull() for q in quarters}
    every = has[quarters[0]]
    for q in quarters[1:]:
        every = every & has[q]
    typed = team_statistics.withColumn("gameDateTimeEst", F.col("gameDateTimeEst").try_cast("timestamp"))
    return earliest_with(typed, "gameDateTimeEst", {**has, "all_quarters": every}, ["gameId", "teamCity", "teamName"])


def oldest_game(games: DataFrame) -> DataFrame:
    """The first game; reads only the id and the time."""
    return earliest_with(games, "gameDateTimeEst", {"oldest": F.lit(True)}, ["gameId"])


def earliest_per_group(df: DataFrame, group: str, time: str, identity: str) -> DataFrame:
    return df.groupBy(group).agg(
        F.min(time).alias(time), F.min_by(identity, F.struct(time, identity)).alias(identity)
    )
