"""Counts of requests in runs of growing size, so that reading them opens few files however many were recorded.

Every recorded batch is a run: a folder ``<first>-<end>`` of counts by key, named after its numbers. When a level
(runs of ``FANOUT ** level`` numbers and more) has ``FANOUT`` runs, these and all later ones are folded into one of
the next level. A run counts once its ``_SUCCESS`` file is there, and hides all runs within its numbers: that file is the
switch, so a fold that dies before or after it loses and repeats nothing. Folded runs are deleted, so counts are to be
taken before the next batch is added. One writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from impactframe import schemas
from impactframe.operators import usage
from impactframe.sources.snapshots import Snapshots

FANOUT = 8


@dataclass(frozen=True)
class RequestLog:
    spark: SparkSession
    root: str
    fanout: int = FANOUT

    @property
    def _files(self) -> Snapshots:
        return Snapshots(self.spark, self.root)

    def _numbers(self) -> list[tuple[int, int]]:
        """All folders, also unfinished ones."""
        return sorted(tuple(map(int, name.split("-"))) for name in self._files.names("runs"))

    def runs(self) -> list[tuple[int, int]]:
        """The numbers of the runs that count, in order; none is within another."""
        done = [r for r in self._numbers() if self._files.exists(f"runs/{r[0]}-{r[1]}/_SUCCESS")]
        live: list[tuple[int, int]] = []
        for run in sorted(done, key=lambda r: (r[0], -r[1])):
            if not live or run[1] > live[-1][1]:
                live.append(run)
        return live

    def _read(self, runs: list[tuple[int, int]]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], schemas.USAGE_COUNTS)
        paths = [f"{self.root}/runs/{low}-{end}" for low, end in runs]
        return self.spark.read.schema(schemas.USAGE_COUNTS).parquet(*paths)

    def counts(self) -> DataFrame:
        """(metric_id, metric_cache_key, query_count, last_requested_at) over all that was recorded."""
        return usage.added_counts(self._read(self.runs()))

    def add(self, requests: DataFrame) -> None:
        """Record requests (metric_id, metric_cache_key, requested_at)."""
        # Unfinished folders keep their numbers.
        number = max((end for _, end in self._numbers()), default=0)
        self._write(usage.usage_counts(requests), (number, number + 1))
        self._fold()

    def _write(self, counts: DataFrame, run: tuple[int, int]) -> None:
        counts.write.parquet(f"{self.root}/runs/{run[0]}-{run[1]}")

    def _level(self, run: tuple[int, int]) -> int:
        level, size = 0, run[1] - run[0]
        while size >= self.fanout:
            level, size = level + 1, size // self.fanout
        return level

    def _fold(self) -> None:
        live = self.runs()
        while True:
            levels = [self._level(r) for r in live]
            many = [level for level in sorted(set(levels)) if levels.count(level) >= self.fanout]
            if not many:
                break
            first = levels.index(many[0])
            old, run = live[first:], (live[first][0], live[-1][1])
            # What is left of a fold of the same numbers that died.
            self._files.delete(f"runs/{run[0]}-{run[1]}")
            self._write(usage.added_counts(self._read(old)), run)
            live = [*live[:first], run]
        # Only what a finished run hides goes; an unfinished folder within it, too.
        for low, end in self._numbers():
            if (low, end) not in live and any(a <= low and end <= b for a, b in live):
                self._files.delete(f"runs/{low}-{end}")
