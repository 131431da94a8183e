"""Quality rules: plain limits first, then robust multivariate outliers.

Texts that pass the limits have a vector of transformed statistics. Each group of language and source gets a
minimum-covariance-determinant estimate: starting from medians, concentration steps take the mean and covariance of
the closer three quarters of the group (by the distances of the step before) until the steps are done, and the
covariance is then scaled to the median distance. Texts farther than ``CUT`` (squared Mahalanobis distance) go.

A step is one aggregation of sums and one approximate percentile by group over the small table of vectors, so a
source with a third of all rows is never gathered. Variances have floors, since most texts have no symbol and no
repeated line at all and any first one would otherwise be infinitely far out. Sources with fewer than
``LEAST_GROUP`` usable texts share one group per language, and what is still too few one group of all.

Defined cases: null or empty texts have no words and fail; null language or source is a value like others; groups
of fewer than ten vectors reject nothing; repeated rows are judged alike; no documents give no rows; other columns
are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from impactframe.llm import textblock as tb
from impactframe.llm.line_runs import line_spans
from impactframe.llm.tables import Scratch, read

#: Fixed: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
REPEAT_WORDS = 5
LEAST_WORDS = 10
MOST_REPEATED = (20, 100)
LEAST_GROUP = 200
STEPS = 6
KEPT_SHARE = 0.75
#: The median of the chi-square distribution with five degrees of freedom.
MEDIAN_DISTANCE = 4.3515
#: Squared distance; of vectors of five independent normal statistics about one in 68,000 is farther.
CUT = 30.0
#: Least standard deviations of the five statistics.
FLOORS = (0.5, 0.3, 0.05, 0.12, 0.12)

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_X = [f"_x{i}" for i in range(5)]


def _covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    edge = np.zeros(n + width + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge)[:n] > 0


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys stand earlier too, and which occur twice or more."""
    distinct, first, number = tb.factorize(keys)
    return first[number] != np.arange(len(keys)), np.bincount(number, minlength=len(distinct))[number] > 1


def counts(block: tb.Block) -> dict[str, np.ndarray]:
    """The base statistics of every text."""
    data, n = block.data, len(block)
    inside = tb.WORD[data]
    starts, ends = block.spans(inside)
    owner = block.owner(starts)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    h = tb.span_hash(data, starts, ends, 1)
    symbol = np.zeros(256, dtype=bool)
    symbol[[ord(c) for c in SYMBOLS]] = True

    repeated = np.zeros(len(h), dtype=bool)
    size = len(h) - REPEAT_WORDS + 1
    if size > 0:
        window = tb.mix(owner[:size].astype(np.uint64))
        for k in range(REPEAT_WORDS):
            window = window * np.uint64(0x9E3779B97F4A7C15) + h[k : k + size]
        whole = np.flatnonzero(owner[:size] == owner[REPEAT_WORDS - 1 :])
        _, twice = _again(tb.mix(window[whole]))
        repeated = _covered(whole[twice], REPEAT_WORDS, len(h))

    l_starts, l_ends, l_owner = line_spans(block)
    words_before = np.concatenate([[0], np.cumsum(inside)])
    solid = np.flatnonzero(words_before[l_ends] > words_before[l_starts])
    lines = tb.mix(tb.span_hash(data, l_starts[solid], l_ends[solid], 1) + tb.mix(l_owner[solid].astype(np.uint64)))
    earlier, _ = _again(lines)
    return {
        "n_words": block.counts(owner),
        "word_chars": np.bincount(owner, weights=lead[ends] - lead[starts], minlength=n).astype(np.int64),
        "n_symbols": block.counts(block.owner(np.flatnonzero(symbol[data]))),
        "n_lines": block.counts(l_owner),
        "n_dup_lines": block.counts(l_owner[solid][earlier]),
        "n_repeat_words": block.counts(owner[repeated]),
    }


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in tb.blocks(batches):
        batch = block.batch.drop_columns(["text"])
        for name, values in counts(block).items():
            batch = batch.append_column(f"_{name}", pa.array(values, pa.int64()))
        yield batch


def _vector() -> list[Column]:
    """Shares are drawn towards the usual for short texts, where a single word moves them far."""
    n, chars, symbols, lines, dups, repeats = (F.col(f"_{k}").cast("double") for k in _COUNTS)
    return [
        F.log(n + 1),
        (chars + 180) / (n + 30),
        F.sqrt(symbols / (chars + 100)),
        F.sqrt(dups / (lines + 5)),
        F.sqrt(repeats / (n + 20)),
    ]


def _grouped(usable: DataFrame, least: int) -> DataFrame:
    """(lang, source, _group): groups that are large enough to be estimated on their own, or the shared ones."""
    sizes = usable.groupBy("lang", "source").agg(F.count("*").alias("_n"))
    own = F.to_json(F.struct("lang", "source"))
    rest = sizes.where(F.col("_n") < least).groupBy("lang").agg(F.sum("_n").alias("_rest")).withColumnRenamed("lang", "_lang")
    both = sizes.join(rest, sizes["lang"].eqNullSafe(F.col("_lang")), "left")
    shared = F.when(F.col("_rest") >= least, F.to_json(F.struct("lang"))).otherwise(F.lit("all"))
    group = F.when(F.col("_n") >= least, own).otherwise(shared)
    return both.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), group.alias("_group"))


def _distance() -> Column:
    """Squared distance from `_mean` under `_inverse` (five rows one after the other)."""
    off = [F.col(x) - F.element_at("_mean", i + 1) for i, x in enumerate(_X)]
    return reduce(add, (F.element_at("_inverse", 5 * i + j + 1) * off[i] * off[j] for i in range(5) for j in range(5)))


_ESTIMATE = T.StructType(
    [
        T.StructField("_group", T.StringType()),
        T.StructField("_mean", T.ArrayType(T.DoubleType())),
        T.StructField("_inverse", T.ArrayType(T.DoubleType())),
    ]
)


def _invert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for row in frame.itertuples(index=False):
            mean = np.array(row.sums) / row.n
            cross = np.array(row.products).reshape(5, 5) / row.n - np.outer(mean, mean)
            spread = np.sqrt(np.maximum(np.diag(cross), 0) + np.array(FLOORS) ** 2)
            cross = (cross + cross.T) / 2
            np.fill_diagonal(cross, spread**2)
            rows.append((row.group, mean.tolist(), np.linalg.inv(cross).ravel().tolist()))
        yield pd.DataFrame(rows, columns=["_group", "_mean", "_inverse"])


def _estimate(rows: DataFrame) -> DataFrame:
    products = [F.sum(F.col(a) * F.col(b)) for a in _X for b in _X]
    sums = rows.groupBy(F.col("_group").alias("group")).agg(
        F.count("*").alias("n"), F.array(*(F.sum(x) for x in _X)).alias("sums"), F.array(*products).alias("products")
    )
    return sums.mapInPandas(_invert, _ESTIMATE)


def judge(docs: DataFrame, steps: int = STEPS, cut: float = CUT, least_group: int = LEAST_GROUP) -> DataFrame:
    """The columns of ``docs`` (text, lang, source, ...) but the text, the base statistics (with `_` before their
    names), _base_failed, _distance (null where there is no estimate) and _kept."""
    scratch = Scratch(docs.sparkSession, "robust-quality")
    kinds = [T.StructField(f"_{k}", T.LongType()) for k in _COUNTS]
    schema = T.StructType([f for f in docs.schema.fields if f.name != "text"] + kinds)
    share, whole = MOST_REPEATED
    stats = docs.mapInArrow(_statistics, schema)
    failed = (F.col("_n_words") < LEAST_WORDS) | (whole * F.col("_n_repeat_words") > share * F.col("_n_words"))
    stats = scratch.write(stats.withColumns({"_base_failed": failed} | dict(zip(_X, _vector(), strict=True))))
    groups = scratch.write(_grouped(stats.where(~F.col("_base_failed")), least_group))
    of_group = stats["lang"].eqNullSafe(F.col("_l")) & stats["source"].eqNullSafe(F.col("_s"))
    usable = scratch.write(stats.where(~F.col("_base_failed")).join(groups, of_group).select("_group", *_X))

    medians = usable.groupBy("_group").agg(*(F.percentile_approx(x, 0.5, 1000).alias(f"_m{x}") for x in _X))
    spread = usable.join(medians, "_group").groupBy("_group").agg(
        *(F.percentile_approx(F.abs(F.col(x) - F.col(f"_m{x}")), 0.5, 1000).alias(f"_d{x}") for x in _X)
    )
    start = medians.join(spread, "_group")
    scale = [1 / (F.pow(1.4826 * F.col(f"_d{x}"), 2) + floor**2) for x, floor in zip(_X, FLOORS, strict=True)]
    diagonal = F.array(*(scale[i] if i == j else F.lit(0.0) for i in range(5) for j in range(5)))
    model = scratch.write(start.select("_group", F.array(*(F.col(f"_m{x}") for x in _X)).alias("_mean"), diagonal.alias("_inverse")))
    for _ in range(steps):
        measured = usable.join(model, "_group").withColumn("_d", _distance()).select("_group", "_d", *_X)
        near = measured.groupBy("_group").agg(F.percentile_approx("_d", KEPT_SHARE, 1000).alias("_near"))
        closer = measured.join(near, "_group").where(F.col("_d") <= F.col("_near"))
        model = scratch.write(_estimate(closer))
    measured = usable.join(model, "_group").withColumn("_d", _distance())
    scales = measured.groupBy("_group").agg(F.percentile_approx("_d", 0.5, 1000).alias("_middle"), F.count("*").alias("_size"))
    scales = scales.where("_size >= 10").withColumn("_scale", F.greatest(F.lit(1.0), F.col("_middle") / MEDIAN_DISTANCE))
    final = groups.join(model.join(scales.select("_group", "_scale"), "_group"), "_group").drop("_group")
    judged = stats.join(final, of_group, "left").withColumn("_distance", _distance() / F.col("_scale"))
    kept = ~F.col("_base_failed") & F.coalesce(F.col("_distance") <= cut, F.lit(True))
    return judged.withColumn("_kept", kept).drop("_l", "_s", "_mean", "_inverse", "_scale", *_X)


def op3_robust_quality(spark: SparkSession, folder: str) -> DataFrame:
    judged = judge(read(spark, folder, "documents").select("doc_id", "text", "lang", "source"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"]
    return judged.select("doc_id", *(F.col(f"_{k}").alias(k) for k in names))
