"""The corpus pipeline: documents go through the stages in order, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents, but for the last one, which returns
the token ids. A text that a stage changes has its n_chars changed with it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactframe.llm import byte_bpe, codeword_language, decontaminate, line_runs, ngram_jaccard
from impactframe.llm.tables import Scratch, read
from impactframe.session import configure

#: Bytes of a batch that goes to or from Python: texts are long, so the usual ten thousand rows take tens of MB in
#: every task and worker.
BATCH_BYTES = 4 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a determinable or with an ambiguous language go; `lang` stays as it was labelled."""
    judged = codeword_language.predict(docs, codeword_language.learned(docs))
    sure = (F.col("_lang_pred") != codeword_language.UNDETERMINED) & ~F.col("_ambiguous")
    return judged.where(sure).select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least three documents share stay only in the document with the largest id."""
    kept = line_runs.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id (null first) stays, once. Rows are told apart
    by id and text, so an id that different texts share, or null, collapses nothing; ties go by hashes of the row."""
    keyed = docs.withColumns({"_key": F.xxhash64("doc_id", "text"), "_order": F.xxhash64(*docs.columns)})
    groups = ngram_jaccard.jaccard_components(keyed.select(F.col("_key").alias("doc_id"), "text"), count_links=False)
    groups = groups.select(F.col("doc_id").alias("_key"), "component_id").distinct()
    rows = keyed.select("_key", "_order", "doc_id").distinct().join(groups, "_key")
    first = rows.groupBy("component_id").agg(F.min(F.struct("doc_id", "_key", "_order")).alias("_first"))
    kept = keyed.join(first.select("_first._key", "_first._order"), ["_key", "_order"], "left_semi")
    return kept.dropDuplicates(["_key", "_order"]).select(docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one word in twenty stands in passages of the benchmark go."""
    return decontaminate.remove_documents(docs, read(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with digests of the ids and of what they decode to.

    The ids are written before they are decoded: in one plan every task would hold two Python workers, one for each
    step, and an executor keeps as many as it once had at the same time, with the memory of all they have done.
    """
    encoded = Scratch(spark, "tokens").write(byte_bpe.encode(docs))
    return byte_bpe.digests(byte_bpe.decode(encoded), "ids")


def _configured(stage: Stage) -> Stage:
    """A stage that sets what it is written for, whoever calls it."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        configure(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("language_id", _configured(language_stage)),
    ("line_dedup", _configured(line_stage)),
    ("ngram_jaccard", _configured(duplicate_stage)),
    ("decontamination", _configured(benchmark_stage)),
    ("byte_bpe", _configured(token_stage)),
]

#: A learned language decision is part of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
