"""Language ID by error-correcting output codes.

Every language gets a codeword of +1 and -1 bits; for each bit a logistic classifier over hashed byte n-grams of
the whole text predicts the bit. A text gets the language whose codeword costs the least logistic loss, every bit
weighted by how well its classifier does on training texts, and is flagged as ambiguous if the next language costs
hardly more.

Fitting uses a sample of labelled texts chosen by a hash of the id, about ``sample`` texts evenly over the
languages (``SAMPLE`` by default); a text's features have a fixed size, so what the driver collects is bounded.

Defined cases: null texts and texts without a letter are `und` with score 0, and so is everything when no labelled
text exists; with a single learned language every other text is that language with score 1; null labels are not
learned from; repeated rows get the same prediction each; other columns are carried along unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from impactframe.llm import textblock as tb
from impactframe.llm.pretokens import LETTER, classes_of, code_points
from impactframe.llm.tables import fold, hashed_share, read

#: Texts to fit on, in expectation.
SAMPLE = 6000
BUCKETS = 2048
BITS = 12
EPOCHS = 12
#: Texts whose features are worked out at once: these have a fixed size for every text, however short.
FEATURE_ROWS = 256
#: A text is ambiguous if the loss per bit of the second language is less than this above that of the first.
MARGIN = 0.02
UNDETERMINED = "und"


def _folded(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII and Latin-1 letters in lower case and everything but letters as spaces."""
    folded = _FOLD[data]
    after_c3 = np.concatenate([[False], data[:-1] == 0xC3])
    capital = after_c3 & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    folded[capital] += 0x20
    return folded


_FOLD = tb.lower_ascii(np.arange(256, dtype=np.uint8))
_FOLD[[x for x in range(128) if not chr(x).isalpha()]] = 32


def features(block: tb.Block, buckets: int = BUCKETS) -> np.ndarray:
    """Square roots of the counts of hashed 1- to 4-grams, scaled to length 1; one row per text."""
    data = _folded(block.data).astype(np.uint32)
    owner = np.repeat(np.arange(len(block), dtype=np.int64), np.diff(block.bounds))
    counts = np.zeros(len(block) * buckets, dtype=np.int64)
    gram = np.zeros(len(data), dtype=np.uint32)
    for n in range(1, 5):
        size = len(data) - n + 1
        if size <= 0:
            break
        gram = gram[:size] * np.uint32(0x01000193) + data[n - 1 :]
        h = gram * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        own = owner[:size]
        inside = own == owner[n - 1 :]
        at = own * buckets + (h % np.uint32(buckets))
        counts += np.bincount(at[inside], minlength=len(counts))
    rows = np.sqrt(counts.reshape(len(block), buckets)).astype(np.float32)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def _has_letter(block: tb.Block) -> np.ndarray:
    letters = np.zeros(len(block), dtype=bool)
    ascii_letter = _FOLD[block.data] != 32
    ascii_letter &= block.data < 128
    letters[np.unique(block.owner(np.flatnonzero(ascii_letter)))] = True
    if not letters.all():
        at, points = code_points(block.data)
        letters[np.unique(block.owner(at[classes_of(points) == LETTER]))] = True
    return letters


def codewords(languages: int, bits: int = BITS) -> np.ndarray:
    """Rows of +1 and -1; every column has both; the rows are far apart."""
    rng = np.random.default_rng(7)
    best, distance = None, -1
    width = max(bits, 2 * int(np.ceil(np.log2(max(2, languages)))) + 1)
    for _ in range(400):
        words = rng.choice([-1.0, 1.0], (languages, width))
        for column in np.flatnonzero(np.abs(words.sum(axis=0)) == languages):
            words[rng.integers(languages), column] *= -1
        apart = languages if languages < 2 else min((words[i] != words[j]).sum() for i in range(languages) for j in range(i))
        if apart > distance:
            best, distance = words, apart
    return best


@dataclass
class Model:
    languages: list[str]
    words: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, rows: np.ndarray) -> np.ndarray:
        """The mean weighted loss per bit of every text (row) and language (column)."""
        margins = rows @ self.weights + self.bias
        return (np.logaddexp(0, -margins[:, None, :] * self.words) * self.trust).sum(axis=2) / self.trust.sum()


def _fit_bits(rows: np.ndarray, target: np.ndarray, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(3)
    weights, bias = np.zeros((rows.shape[1], target.shape[1]), np.float32), np.zeros(target.shape[1], np.float32)
    speed = np.zeros_like(weights)
    for epoch in range(epochs):
        step = 8.0 / (1 + epoch)
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            x, y = rows[part], target[part]
            pull = y / (1 + np.exp(np.clip(y * (x @ weights + bias), -30, 30)))
            speed = 0.8 * speed + (x.T @ pull) / len(part) - 1e-6 * weights
            weights += step * speed
            bias += step * 0.1 * pull.mean(axis=0)
    return weights, bias


def fit(labelled: DataFrame, sample: int = SAMPLE, bits: int = BITS, epochs: int = EPOCHS) -> Model | None:
    """Fit on rows (doc_id, text, lang); None if no label is known."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    share = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, sample / len(languages) / sizes[k]))))
    chosen = labelled.where(hashed_share("doc_id", 9) < share[F.col("lang")]).select("lang", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, max_rows=FEATURE_ROWS):
            x = features(block).astype(np.float16)
            packed = tb.binary_lists(x.ravel(), np.full(len(block), x.shape[1]))
            yield pa.RecordBatch.from_arrays([block.column("lang"), packed], names=["lang", "row"])

    got = chosen.mapInArrow(rows, "lang string, row binary").toArrow()
    if not got.num_rows:
        return None
    order = np.argsort(np.array(got["lang"].to_pylist()), kind="stable")
    x = np.stack([np.frombuffer(r, np.float16) for r in got["row"].to_pylist()]).astype(np.float32)[order]
    y = np.array([languages.index(k) for k in got["lang"].to_pylist()])[order]
    # The order of collected rows is not fixed; that of their contents is.
    order = np.lexsort((x @ np.arange(x.shape[1], dtype=np.float32), y))
    x, y = x[order], y[order]
    words = codewords(len(languages), bits)
    weights, bias = _fit_bits(x, words[y].astype(np.float32), epochs)
    right = ((x @ weights + bias) * words[y] > 0).mean(axis=0)
    return Model(languages, words, weights, bias, np.clip(2 * right - 1, 0.05, 1))


def predict(docs: DataFrame, model: Model | None, margin: float = MARGIN) -> DataFrame:
    """All columns of ``docs`` (text, ...) with _lang_pred, _score and _ambiguous."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, max_rows=FEATURE_ROWS):
            n = len(block)
            usable = _has_letter(block) & (model is not None)
            if model is None:
                names, score, unsure = np.full(n, UNDETERMINED, object), np.zeros(n), np.zeros(n, bool)
            else:
                losses = model.losses(features(block))
                best = losses.argmin(axis=1)
                ordered = np.sort(losses, axis=1)
                chance = np.exp(-(losses - ordered[:, :1]) * model.words.shape[1])
                score = np.where(usable, 1 / chance.sum(axis=1), 0.0)
                names = np.where(usable, np.array(model.languages, object)[best], UNDETERMINED)
                gap = ordered[:, 1] - ordered[:, 0] if losses.shape[1] > 1 else np.full(n, np.inf)
                unsure = usable & (gap < margin)
            batch = block.batch.append_column("_lang_pred", pa.array(names, pa.string()))
            batch = batch.append_column("_score", pa.array(score, pa.float64()))
            yield batch.append_column("_ambiguous", pa.array(unsure))

    extra = [("_lang_pred", T.StringType()), ("_score", T.DoubleType()), ("_ambiguous", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in extra)]))


def learned(docs: DataFrame) -> Model | None:
    """The model of the rows outside the held-out fold."""
    return fit(docs.select("doc_id", "text", "lang").where(fold("doc_id", 5) != 0))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    predicted = predict(docs.select("doc_id", "text"), learned(docs))
    return predicted.select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        F.col("_lang_pred").alias("lang_pred"),
        F.col("_score").alias("score"),
        F.col("_ambiguous").alias("ambiguous"),
    )
