"""Quality classifier on random-indexing word vectors.

Every hash bucket of words has a fixed sparse random index vector. A word's vector is the sum of the index vectors
of its neighbours, over the whole corpus, scaled to length 1; buckets bound the table whatever the vocabulary. A
text is the mean of its words' vectors with the length of that mean (long if few words make up the text), the
logarithm of the number of words, and how far the means of the text's quarters are from it. A network of two layers
gives the probability, whose logit is divided by a temperature fitted on labelled texts that the weights were not
fitted on.

The word vectors learn from all texts and no label; the network learns from about ``SAMPLE`` labelled texts chosen
by a hash of the id, so that what the driver collects is bounded.

Defined cases: null and empty texts are the zero vector and get the network's score for it; without labelled texts
every score is 0.5; several labels of one document count by their mean, null labels not at all; repeated rows get
the same score each; no documents give no rows; other columns are carried along unread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from impactframe.llm import textblock as tb
from impactframe.llm.blocks import pack_array, unpack_array
from impactframe.llm.tables import Scratch, fold, hashed_share, read

BUCKETS = 1 << 14
DIMENSIONS = 32
#: Neighbours on each side.
REACH = 2
SAMPLE = 20_000
HIDDEN = 48
EPOCHS = 30
THRESHOLD = 0.7
#: Rows of the word-vector table that are summed as one.
_STRIP = 1 << 8
_PARTS = 4
WIDTH = DIMENSIONS + 2 + _PARTS

#: Letters and digits, and everything else that is no white space, are tokens apart.
_KIND = np.ones(256, dtype=np.uint8)
_KIND[[b for b in range(128) if not chr(b).isalnum()]] = 2
_KIND[tb.SPACE] = 0


def index_vectors(buckets: int = BUCKETS, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Per bucket a vector with two entries +1, two -1 and zeros."""
    rng = np.random.default_rng(11)
    vectors = np.zeros((buckets, dimensions), dtype=np.float32)
    chosen = np.argsort(rng.random((buckets, dimensions)), axis=1)[:, :4]
    np.put_along_axis(vectors, chosen, np.array([1, 1, -1, -1], dtype=np.float32), axis=1)
    return vectors


def word_buckets(block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and the owner of every token."""
    kind = _KIND[block.data]
    border = np.ones(len(kind), dtype=bool)
    border[1:] = kind[1:] != kind[:-1]
    border[block.bounds[:-1][block.bounds[:-1] < len(kind)]] = True
    starts = np.flatnonzero(border)
    ends = np.append(starts[1:], len(kind))
    solid = kind[starts] != 0
    starts, ends = starts[solid], ends[solid]
    h = tb.span_hash(block.data, starts, ends, 5)
    return (h % np.uint64(BUCKETS)).astype(np.int32), block.owner(starts)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's sums of index vectors by word bucket, in strips of the table."""
    index = index_vectors()
    sums = np.zeros((BUCKETS, DIMENSIONS), dtype=np.float64)
    for block in tb.blocks(batches):
        buckets, owner = word_buckets(block)
        if not len(buckets):
            continue
        vectors = index[buckets]
        near = np.zeros_like(vectors)
        for gap in range(1, REACH + 1):
            same = (owner[gap:] == owner[:-gap])[:, None]
            near[gap:] += vectors[:-gap] * same
            near[:-gap] += vectors[gap:] * same
        order = np.argsort(buckets, kind="stable")
        begins = np.flatnonzero(np.append(True, np.diff(buckets[order]) != 0))
        sums[buckets[order[begins]]] += np.add.reduceat(near[order], begins, axis=0)
    strips = [pack_array(sums[at : at + _STRIP].astype(np.int64)) for at in range(0, BUCKETS, _STRIP)]
    task = np.full(len(strips), TaskContext.get().partitionId())
    columns = [pa.array(range(len(strips)), pa.int32()), pa.array(task, pa.int64()), pa.array(strips, pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, names=["strip", "task", "sums"])


def _add_strips(table: pa.Table) -> pa.Table:
    # Whole numbers: the same in any order.
    total = sum(unpack_array(x, np.int64) for x in table["sums"].to_pylist())
    return table.slice(0, 1).select(["strip", "task"]).append_column("sums", pa.array([pack_array(total)], pa.binary()))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors; its size does not depend on the corpus."""
    schema = "strip int, task long, sums binary"
    strips = docs.select("text").mapInArrow(_contexts, schema)
    # In two steps, so that no task adds up what all tasks send.
    parts = max(1, math.isqrt(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    strips = strips.withColumn("task", F.col("task") % parts).groupBy("strip", "task").applyInArrow(_add_strips, schema)
    rows = strips.groupBy("strip").applyInArrow(_add_strips, schema).select("strip", "sums").collect()
    if not rows:
        return np.zeros((BUCKETS, DIMENSIONS), dtype=np.float32)
    table = np.concatenate([unpack_array(r["sums"], np.int64) for r in sorted(rows, key=lambda r: r["strip"])]).reshape(BUCKETS, DIMENSIONS)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(block: tb.Block, vectors: np.ndarray) -> np.ndarray:
    """One row per text: mean vector, its length, log of the size, and the distance of each quarter's mean from it."""
    buckets, owner = word_buckets(block)
    n = len(block)
    rows = np.zeros((n, WIDTH), dtype=np.float32)
    if not len(buckets):
        return rows
    sizes = np.bincount(owner, minlength=n)
    place = np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]
    cell = owner * _PARTS + place * _PARTS // sizes[owner]
    begins = np.flatnonzero(np.append(True, np.diff(cell) != 0))
    parts = np.zeros((n * _PARTS, DIMENSIONS), dtype=np.float32)
    parts[cell[begins]] = np.add.reduceat(vectors[buckets], begins, axis=0)
    parts = parts.reshape(n, _PARTS, DIMENSIONS)
    held = np.maximum(np.bincount(cell, minlength=n * _PARTS), 1).reshape(n, _PARTS, 1)
    mean = parts.sum(axis=1) / np.maximum(sizes, 1)[:, None]
    rows[:, :DIMENSIONS] = mean
    rows[:, DIMENSIONS] = np.linalg.norm(mean, axis=1)
    rows[:, DIMENSIONS + 1] = np.log1p(sizes)
    rows[:, DIMENSIONS + 2 :] = np.linalg.norm(parts / held - mean[:, None, :], axis=2)
    rows[sizes == 0] = 0
    return rows


@dataclass
class Network:
    center: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, rows: np.ndarray) -> np.ndarray:
        hidden = np.maximum((rows - self.center) / self.scale @ self.first + self.first_bias, 0)
        return hidden @ self.second + self.second_bias

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(rows) / self.temperature, -30, 30)))


def fit_network(rows: np.ndarray, target: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS) -> Network:
    """Adam on the logistic loss over four fifths of the rows; the temperature on the rest."""
    rng = np.random.default_rng(5)
    order = rng.permutation(len(rows))
    cut = max(1, len(rows) * 4 // 5)
    train, rest = order[:cut], order[cut:] if cut < len(rows) else order
    center, scale = rows[train].mean(axis=0), rows[train].std(axis=0) + 1e-3
    net = Network(
        center, scale, rng.normal(0, np.sqrt(2 / rows.shape[1]), (rows.shape[1], hidden)), np.zeros(hidden),
        rng.normal(0, np.sqrt(1 / hidden), hidden), 0.0,
    )
    x, y = (rows - center) / scale, target
    values = [net.first, net.first_bias, net.second, np.zeros(1)]
    mean, square = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step = 0
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(train), max(1, len(train) // 128)):
            step += 1
            active = x[part] @ values[0] + values[1]
            shown = np.maximum(active, 0)
            error = (1 / (1 + np.exp(-np.clip(shown @ values[2] + values[3], -30, 30))) - y[part]) / len(part)
            back = np.outer(error, values[2]) * (active > 0)
            for i, slope in enumerate((x[part].T @ back + 1e-5 * values[0], back.sum(axis=0), shown.T @ error, error.sum(keepdims=True))):
                mean[i] = 0.9 * mean[i] + 0.1 * slope
                square[i] = 0.999 * square[i] + 0.001 * slope**2
                rate = 3e-3 / (1 + epoch / 10) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                values[i] = values[i] - rate * mean[i] / (np.sqrt(square[i]) + 1e-8)
    net.first, net.first_bias, net.second, net.second_bias = values[0], values[1], values[2], float(values[3][0])
    logits, truth = net.logits(rows[rest]), target[rest]
    options = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    losses = [np.mean(np.logaddexp(0, logits / t) - truth * logits / t) for t in options]
    net.temperature = float(options[int(np.argmin(losses))])
    return net


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The columns of ``docs`` (doc_id, text, ...) without the text, and _score; learns from ``labels`` (doc_id, quality)."""
    spark = docs.sparkSession
    # The table has a fixed size: BUCKETS x DIMENSIONS numbers.
    vectors = spark.sparkContext.broadcast(word_vectors(docs))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches):
            packed = tb.binary_lists(pooled(block, vectors.value).ravel(), np.full(len(block), WIDTH))
            yield block.batch.drop_columns(["text"]).append_column("_row", packed)

    schema = [f for f in docs.schema.fields if f.name != "text"]
    rows = Scratch(spark, "random-indexing").write(docs.mapInArrow(pool, T.StructType([*schema, T.StructField("_row", T.BinaryType())])))
    labels = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("_target"))
    known = labels.count()
    chosen = labels.where(hashed_share("doc_id", 10) < sample / max(1, known)).withColumnRenamed("doc_id", "_id")
    got = rows.join(chosen, rows["doc_id"] == F.col("_id")).select("doc_id", "_row", "_target").toArrow()
    network = None
    if got.num_rows:
        got = got.sort_by("doc_id")
        x = np.stack([np.frombuffer(r, np.float32) for r in got["_row"].to_pylist()]).astype(np.float64)
        network = fit_network(x, got["_target"].to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("_row").to_pylist()), np.float32).reshape(-1, WIDTH).astype(np.float64)
            chances = network.probabilities(x) if network else np.full(len(x), 0.5)
            yield batch.drop_columns(["_row"]).append_column("_score", pa.array(chances, pa.float64()))

    return rows.mapInArrow(run, T.StructType([*schema, T.StructField("_score", T.DoubleType())]))


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    labels = read(spark, folder, "labels").select("doc_id", "quality").where(fold("doc_id", 4) != 2)
    scored = score(docs, labels)
    return scored.select(
        "doc_id",
        (fold("doc_id", 4) == 2).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
