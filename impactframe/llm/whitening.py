"""Whitening of embeddings by shifted CholeskyQR: principal components without an explicit covariance matrix.

Every entry c becomes the integer x = floor(1024 * c) + 100000, so counts and sums are exact. The centred rows A,
divided by the root of their number, are made orthogonal in passes: a pass applies the triangular solves of the
passes before it to its rows, sums the Gram matrix of what comes out (one small matrix per task, added up by matrix
row), and factors it into a triangle R. The first Gram matrix is shifted by a multiple of the identity that rounding
cannot outweigh, so that its factorisation never breaks down; the passes after it take the shift out again. When the
rows are orthogonal, the composed triangle R = R_k ... R_1 holds A's singular values and right singular vectors, and
the small SVD of R gives the components without ever squaring the condition of A.

What reaches the driver is d x d numbers a pass, whatever the number of vectors.

Defined cases: a null vector, and one with null or non-finite entries, is dropped; so is one whose length is not the
most frequent length (of equally frequent ones the largest), since it has no covariance with the others. No vectors
left, or vectors without entries, give no rows. A component along which the vectors do not vary (fewer vectors than
dimensions, constant or dependent dimensions) cannot be scaled to one: its ``whitened`` is null, and the identity
error is that of the others (null if there are none). Repeated vectors and ids count every time; a null id stays null.
Entries so large that x, a deviation or its sum leaves 64 bits are an error. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from impactframe.llm.tables import Scratch, read

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
#: Rows of a task that are worked on at once.
ROWS = 4096
#: The rows count as orthogonal when their Gram matrix is this close to the identity.
ORTHOGONAL = 1e-10
#: One shifted pass and two more are enough for any full-rank input; dependent columns never become orthogonal.
MOST_PASSES = 6


def integers(df: DataFrame, vector: str, id_column: str) -> DataFrame:
    """(id, x) of the vectors without null or non-finite entries."""

    def broken(entry: Column) -> Column:
        return entry.isNull() | F.isnan(entry) | (F.abs(entry) == F.lit(float("inf")))

    entries = F.col(vector).cast("array<double>")
    whole = df.where(F.col(vector).isNotNull()).select(F.col(id_column).alias("id"), entries.alias("v"))
    whole = whole.where(~F.exists("v", broken))
    # A cast of a number beyond 64 bits is an error in ANSI mode.
    scaled = F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + OFFSET)
    return whole.select("id", scaled.alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


@dataclass(frozen=True)
class Centre:
    """The number of vectors and the sums of their entries."""

    n: int
    sums: list[int]

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: whole parts are subtracted as integers, so that nothing is lost next to the offset."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """sum (n * x - S)^2, exactly."""
        most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
        spread = self.n * most + max(map(abs, self.sums))
        if spread**2 * x.shape[1] < 2**63:
            gaps = x * np.int64(self.n) - np.array(self.sums, dtype=np.int64)
            return np.einsum("ij,ij->i", gaps, gaps)
        out = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        if max(out) >= 2**63:
            raise ArithmeticError("a deviation needs more than 64 bits")
        return np.array(out, dtype=np.int64)


def centre(vectors: DataFrame, size: int) -> Centre:
    """Count and sums, added up by dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(size, dtype=np.int64)
        for _, x in _matrices(batches):
            n += len(x)
            sums += x.sum(axis=0)
        if n:
            columns = [pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(columns, names=["dimension", "n", "total"])

    parts = vectors.mapInArrow(partial, "dimension int, n long, total long")
    rows = parts.groupBy("dimension").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("dimension").collect()
    return Centre(rows[0]["n"], [r["total"] for r in rows])


def solve_triangle(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """rows @ inverse(upper), column by column."""
    out = np.empty_like(rows)
    for j in range(upper.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


_GRAM = "row int, task int, numbers array<double>"


def _partial_gram(size: int, rows_of: Callable[[np.ndarray], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, seen = np.zeros((size, size)), False
        for _, x in _matrices(batches):
            block = rows_of(x)
            gram += block.T @ block
            seen = True
        if seen:
            task = TaskContext.get().partitionId()
            columns = [pa.array(range(size), pa.int32()), pa.array([task] * size, pa.int32()), pa.array(gram.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "task", "numbers"])

    return run


def _sum_rows(group: pa.Table) -> pa.Table:
    # In the order of the tasks, so that a repeated run adds in the same order.
    group = group.sort_by("task")
    total = np.add.reduce(np.array(group["numbers"].to_pylist()), axis=0)
    return pa.table({"row": group["row"].slice(0, 1), "task": group["task"].slice(0, 1), "numbers": pa.array([total.tolist()], pa.list_(pa.float64()))})


def gram_matrix(vectors: DataFrame, size: int, rows_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    parts = vectors.mapInArrow(_partial_gram(size, rows_of), _GRAM)
    summed = parts.groupBy("row").applyInArrow(_sum_rows, _GRAM).orderBy("row").collect()
    gram = np.array([r["numbers"] for r in summed])
    return (gram + gram.T) / 2


def _upper(gram: np.ndarray, shift: float) -> np.ndarray:
    return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T


def triangle(vectors: DataFrame, about: Centre) -> np.ndarray:
    """R with R^T R = A^T A, where A are the centred rows over the root of n."""
    size, root = len(about.sums), np.sqrt(about.n)
    # What rounding can make of a Gram matrix of norm one.
    noise = 11 * (about.n * size + size * (size + 1)) * np.finfo(float).eps / 2
    composed, solves = np.eye(size), []
    for k in range(MOST_PASSES):
        earlier = list(solves)

        def rows_of(x: np.ndarray, earlier: list = earlier) -> np.ndarray:
            block = about.rows(x) / root
            for upper in earlier:
                block = solve_triangle(block, upper)
            return block

        gram = gram_matrix(vectors, size, rows_of)
        if not gram.any():
            return np.zeros((size, size))
        if np.abs(gram - np.eye(size)).max() < ORTHOGONAL or k == MOST_PASSES - 1:
            break
        shift = min(noise, 1e-3) * np.trace(gram)
        try:
            upper = _upper(gram, shift if k == 0 else 0.0)
        except np.linalg.LinAlgError:
            upper = _upper(gram, shift)
        solves.append(upper)
        composed = upper @ composed
    values, vectors_of = np.linalg.eigh(gram)
    # The last Gram matrix's own root; dependent columns leave it without a Cholesky factor.
    return (np.sqrt(values.clip(0))[:, None] * vectors_of.T) @ composed


@dataclass(frozen=True)
class Model:
    """Means, unit components (one a column) and their shares of the variance; ``scale`` is 0 where nothing varies."""

    about: Centre
    components: np.ndarray
    scale: np.ndarray
    explained: np.ndarray

    def whiten(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            out = self.about.rows(x) @ self.components / self.scale
        out[:, self.scale == 0] = np.nan
        return out


def fit(vectors: DataFrame, size: int, components: int = COMPONENTS) -> Model:
    """Fit on all vectors (id, x) of ``size`` entries."""
    about = centre(vectors, size)
    _, singular, right = np.linalg.svd(triangle(vectors, about))
    total = float((singular**2).sum())
    kept = right[: min(components, size)].T
    # Either sign will do; the largest entry is positive, so that runs agree.
    kept = kept * np.sign(kept[np.abs(kept).argmax(axis=0), range(kept.shape[1])])
    scale = singular[: kept.shape[1]].copy()
    scale[scale <= singular[0] * size * np.finfo(float).eps] = 0.0
    share = scale**2 / total if total else np.zeros(len(scale))
    return Model(about, kept, scale, share)


def vectors_of(df: DataFrame, scratch: Scratch, vector: str, id_column: str) -> tuple[DataFrame, int]:
    """The vectors of the most frequent length, written once for all passes, and that length (0: none)."""
    written = scratch.write(integers(df, vector, id_column))
    lengths = written.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    size = first["size"] if first else 0
    return written.where(F.size("x") == size), size


def whiten(df: DataFrame, vector: str = "embedding", id_column: str = "vec_id", components: int = COMPONENTS) -> tuple[DataFrame, Model | None]:
    """(id, deviation, whitened array) of every remaining vector, and the model; None without vectors."""
    scratch = Scratch(df.sparkSession, "whitening")
    vectors, size = vectors_of(df, scratch, vector, id_column)
    kind = df.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, deviation long, whitened array<double>"
    if not size:
        return df.sparkSession.createDataFrame([], schema), None
    model = fit(vectors, size, components)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches):
            whitened = [[None if v != v else v for v in row] for row in model.whiten(x).tolist()]
            columns = [part.column("id"), pa.array(model.about.deviations(x)), pa.array(whitened, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "deviation", "whitened"])

    return scratch.write(vectors.mapInArrow(apply, schema)), model


def identity_error(whitened: DataFrame, model: Model) -> float | None:
    """Largest entry of the covariance of the whitened values minus the identity, over what varies."""
    live = np.flatnonzero(model.scale).tolist()
    pairs = [(i, j) for i in live for j in live if i <= j]
    if not pairs:
        return None
    # covar_pop keeps centred sums and merges them; one row comes back.
    sums = whitened.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(sums, pairs, strict=True))


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows, model = whiten(read(spark, folder, "embeddings"))
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    explained = F.array(*[F.lit(float(e)) for e in model.explained])
    error = identity_error(rows, model)
    each = rows.select("id", "deviation", F.posexplode("whitened").alias("at", "value"))
    return each.select(
        F.col("id").alias("vec_id"),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.about.n).cast("long").alias("n"),
        "deviation",
        F.col("value").alias("whitened"),
        explained[F.col("at")].alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
