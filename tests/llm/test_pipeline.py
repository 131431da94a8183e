"""The whole pipeline against its stages done plainly, one after the other."""

import re

import brute
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from impactframe.llm import byte_bpe, codeword_language


@pytest.fixture(scope="module")
def folder(docs, pairs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.drop("node").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{path}/documents.parquet")
    items = [(0, pairs[9][1]), (1, None), (2, " ".join(pairs[-3][1].split()[:40]) if pairs[-3][1] else "x y")]
    docs.sparkSession.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_run_equals_plain_stages(spark, folder):
    read = spark.read.parquet(f"{folder}/documents.parquet")
    judged = codeword_language.predict(read, codeword_language.learned(read)).collect()
    left = [(r.doc_id, r.text) for r in judged if r._lang_pred != "und" and not r._ambiguous]
    assert 40 < len(left) < len(judged)
    left = [(d, "\n".join(kept)) for d, _, kept in brute.kept_lines(left)]
    groups = {d: c for d, _, c in brute.components(left)}
    left = sorted({(d, t) for d, t in left if groups[d] == d})
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = {row[0] for row in brute.contamination(left, bench) if row[-1]}
    assert bad
    left = [(d, t) for d, t in left if d not in bad]
    ranks = byte_bpe.ranks(open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb").read())
    encoder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = sorted((d, encoder.encode_ordinary(t), brute.sha(t)) for d, t in left)
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, list(r.ids), r.decoded_sha256) for r in got) == expected


def test_only_similar_texts_are_duplicates(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(None, text(0)), (None, text(1)), (7, text(2)), (7, text(3)), (None, "short"), (None, "brief")]
    # Copies: of another id, of the same row, of a null id, and of one of the texts under id 7.
    copies = [(9, text(4)), (8, text(4)), (8, text(4)), (3, text(0)), (5, text(3) + " more")]
    docs = spark.createDataFrame([(d, t, "en") for d, t in rows + copies], "doc_id long, text string, lang string")
    expected = {(None, text(0)), (None, text(1)), (7, text(2)), (5, text(3) + " more"), (None, "short"), (None, "brief"), (8, text(4))}
    for parts in (1, 5):
        got = [(r.doc_id, r.text) for r in corpus_pipeline.duplicate_stage(spark, docs.repartition(parts), "").collect()]
        assert len(got) == len(expected) and set(got) == expected


def test_stages_keep_the_columns_and_bear_no_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < -1")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == 0


def test_tasks_hold_one_python_worker(spark, folder):
    """Python steps of one plan without an exchange between them run in workers of their own at the same time."""
    python = r"(MapInArrow|FlatMap\w*InArrow)"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        plan = stage(spark, docs, folder)._jdf.queryExecution().sparkPlan()
        assert len(re.findall(python, plan.toString())) <= 1, name
