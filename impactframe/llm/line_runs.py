"""Line dedup against levelled sorted runs of line hashes.

A run is a table of (key_a, key_b, n_docs, keeper), sorted by the key: how many documents of the run's batches
hold the line, and the largest id among them. A batch is merge-anti-joined with the runs (what they do not hold
is new), adds a run of its own at level 0, and when a level has ``FANOUT`` runs they are merged into one run of
the next level. So a key is in at most FANOUT - 1 runs of each level, and each key is rewritten once per level.

Batches are taken from the largest document ids down: the first batch that holds a line also holds its keeper.

Defined cases: a null or empty text is one empty line; lines whose key is shorter than ``min_chars`` are always
kept; a line repeated inside one document counts as one document; repeated rows (same id, same text) are one
document and give one row each; a null id is one id below all others; no documents give no rows; more columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from impactframe.llm import textblock as tb
from impactframe.llm.tables import Scratch, read

FANOUT = 3
BATCHES = 4
MIN_CHARS = 20
MIN_DOCS = 3
#: Stands for a null id; below every id.
NO_ID = -(2**63)

_NEWLINE = 10


def line_spans(block: tb.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (without the newline) and owners of all lines; an empty text has one empty line."""
    breaks = np.flatnonzero(block.data == _NEWLINE)
    owner = np.concatenate([np.arange(len(block)), block.owner(breaks)])
    starts = np.concatenate([block.bounds[:-1], breaks + 1])
    order = np.argsort(owner, kind="stable")
    starts, owner = starts[order], owner[order]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    last = np.append(owner[1:] != owner[:-1], True)
    ends[last] = block.bounds[1:][owner[last]]
    return starts, ends, owner


def line_keys(block: tb.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every line: owner, length of its key in code points, and the key's 128-bit hash in two halves."""
    starts, ends, owner = line_spans(block)
    solid = np.flatnonzero(~tb.SPACE[block.data])
    first, last = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
    has = last >= first
    if len(solid):
        starts = np.where(has, solid[np.minimum(first, len(solid) - 1)], starts)
        ends = np.where(has, solid[np.maximum(last, 0)] + 1, starts)
    else:
        ends = starts
    lead = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    lower = tb.lower_ascii(block.data)
    halves = [tb.span_hash(lower, starts, ends, seed).view(np.int64) for seed in (1, 2)]
    return owner, lead[ends] - lead[starts], halves[0], halves[1]


def _doc_keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches):
            owner, size, a, b = line_keys(block)
            long = size >= min_chars
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").take(pa.array(owner[long])), pa.array(a[long]), pa.array(b[long])],
                names=["doc_id", "key_a", "key_b"],
            )

    return run


class LineRuns:
    """The levelled runs; ``add`` takes the distinct (doc_id, key_a, key_b) of one batch."""

    def __init__(self, scratch: Scratch, fanout: int = FANOUT):
        self.scratch, self.fanout = scratch, fanout
        self.levels: list[list[DataFrame]] = []

    def _sorted_run(self, df: DataFrame) -> DataFrame:
        return self.scratch.write(df.sortWithinPartitions("key_a", "key_b"))

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        union = runs[0]
        for run in runs[1:]:
            union = union.unionByName(run)
        return union.groupBy("key_a", "key_b").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def _unseen(self, batch: DataFrame) -> tuple[DataFrame, Column]:
        """The batch merge-joined with all runs, and whether none of them holds the key."""
        unseen = F.lit(True)
        for i, run in enumerate(run for level in self.levels for run in level):
            batch = batch.join(run.select("key_a", "key_b", F.lit(True).alias(f"_in{i}")), ["key_a", "key_b"], "left")
            unseen = unseen & F.col(f"_in{i}").isNull()
        return batch, unseen

    def add(self, doc_keys: DataFrame) -> None:
        """Add the run of a batch whose ids are below those of all earlier batches; compact the full levels.

        A key that an earlier run holds has its keeper there; here it only adds to the count.
        """
        batch = doc_keys.groupBy("key_a", "key_b").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("_largest"))
        batch, unseen = self._unseen(batch)
        carried = [self._sorted_run(batch.select("key_a", "key_b", "n_docs", F.when(unseen, F.col("_largest")).alias("keeper")))]
        for level in self.levels:
            level.extend(carried)
            if len(level) < self.fanout:
                return
            carried = [self._sorted_run(self._merged(level))]
            level.clear()
        self.levels.append(carried)

    def table(self) -> DataFrame:
        return self._merged([run for level in self.levels for run in level])


def _drop_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in tb.blocks(batches):
        starts, ends, owner = line_spans(block)
        _, _, a, b = line_keys(block)
        drops = block.column("_drops")
        keys = drops.flatten()
        drop_owner = np.repeat(np.arange(len(block)), drops.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        gone = np.isin(
            _with_owner(owner, a, b),
            _with_owner(drop_owner, keys.field("key_a").to_numpy(zero_copy_only=False), keys.field("key_b").to_numpy(zero_copy_only=False)),
        )
        kept = ~gone
        k_starts, k_ends, k_owner = starts[kept], ends[kept], owner[kept]
        later = np.concatenate([[False], k_owner[1:] == k_owner[:-1]]) if len(k_owner) else np.empty(0, bool)
        text = tb.cut(block, k_starts - later, k_ends)
        old = block.column("text")
        if old.null_count:
            text = pc.if_else(old.is_null(), pa.scalar(None, pa.string()), text)
        batch = block.batch.set_column(block.batch.schema.get_field_index("text"), "text", text).drop_columns(["_drops"])
        batch = batch.append_column("_n_lines", pa.array(block.counts(owner), pa.int64()))
        yield batch.append_column("_n_dropped", pa.array(block.counts(owner[gone]), pa.int64()))


def _with_owner(owner: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return tb.mix(a.astype(np.int64).view(np.uint64) + tb.mix(b.astype(np.int64).view(np.uint64) + tb.mix(owner.astype(np.uint64))))


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...), the text without the dropped lines, plus _n_lines and _n_dropped."""
    scratch = Scratch(docs.sparkSession, "line-runs")
    ids = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    lines = scratch.write(ids.mapInArrow(_doc_keys(min_chars), "doc_id long, key_a long, key_b long").distinct())
    cuts = sorted(set(ids.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)))
    edges = [None, *(int(x) for x in cuts), None]
    runs = LineRuns(scratch, fanout)
    for low, high in reversed(list(zip(edges, edges[1:], strict=False))):
        batch = lines if low is None else lines.where(F.col("doc_id") >= low)
        runs.add(batch if high is None else batch.where(F.col("doc_id") < high))
    common = scratch.write(runs.table().where(F.col("n_docs") >= min_docs).select("key_a", "key_b", "keeper"))
    drops = (
        lines.join(common, ["key_a", "key_b"])
        .where(F.col("doc_id") < F.col("keeper"))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.collect_list(F.struct("key_a", "key_b")).alias("_drops"))
    )
    joined = docs.join(drops, F.coalesce(docs["doc_id"], F.lit(NO_ID)) == F.col("_id"), "left").drop("_id")
    schema = T.StructType([*docs.schema.fields, T.StructField("_n_lines", T.LongType()), T.StructField("_n_dropped", T.LongType())])
    return joined.mapInArrow(_drop_lines, schema)


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    kept = dedup_lines(docs).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), "text")
    return kept.withColumn("kept_sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).drop("text")


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (
  SELECT doc_id, line, pos, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id < keeper) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keeper IS NULL OR doc_id >= keeper), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (k) GROUP BY doc_id
"""
