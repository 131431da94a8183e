"""Benchmark decontamination with DataFrame functions only.

Every n-gram of a benchmark item is found by its longest word, the anchor: documents are scanned for anchors, and
only where one stands, the window around it is compared (by a 128-bit hash of its words) with the benchmark's
n-gram. The anchors are broadcast if the benchmark has at most ``MOST_BROADCAST`` n-grams, which bounds their
size; a larger benchmark is joined by a shuffle on the word instead, with the same result.

Defined cases: null texts have no words; an item with fewer words than ``n`` (but not none) is one window; several
items with the same window all count; rows that repeat an item id add to one item, and a null item id is the text
`null`; rows with the same doc_id share their candidates and are judged on their own words; null ids are one id; an
empty benchmark hits nothing; no documents give no rows; more columns of ``docs`` are carried along, but names that
begin with `_` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from impactframe.llm.tables import read

N = 13
#: A document is contaminated if one word in SHARE is hit.
SHARE = 20
#: N-grams of the benchmark whose anchors may be broadcast: about 200 bytes each.
MOST_BROADCAST = 1_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words, after lower-casing.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, GAP), "")


def _hashes(words: Column) -> tuple[Column, Column]:
    return F.xxhash64(words), F.xxhash64(F.lit(1), words)


def benchmark_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(anchor, offset, length, h1, h2, items): one row per distinct n-gram, found by its longest word."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words_of(F.col("text")).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (n - 1), F.lit(1)))
    windows = items.where(F.size("words") > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, n))).alias("window"))
    windows = windows.groupBy("window").agg(F.collect_set("item").alias("items"))
    longest = F.array_max(F.transform("window", lambda w, i: F.struct(F.length(w).alias("size"), w.alias("word"), i.alias("at"))))
    h1, h2 = _hashes(F.col("window"))
    return windows.select("items", F.size("window").alias("length"), h1.alias("h1"), h2.alias("h2"), longest.alias("a")).select(
        F.col("a.word").alias("anchor"), F.col("a.at").alias("offset"), "length", "h1", "h2", "items"
    )


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, share: int = SHARE, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...) with _n_words, _spans (array of (a, b): hit words a <= i < b),
    _n_hit, _items (sorted) and _contaminated."""
    windows = benchmark_windows(benchmark, n)
    anchors = F.broadcast(windows) if windows.count() <= most_broadcast else windows
    found = (
        docs.select("doc_id", F.posexplode(words_of(F.col("text"))).alias("_at", "anchor"))
        .join(anchors, "anchor")
        .where(F.col("_at") >= F.col("offset"))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.collect_set(F.struct((F.col("_at") - F.col("offset")).alias("start"), "length", "h1", "h2", "items")).alias("_found"))
    )
    judged = docs.join(found, docs["doc_id"].eqNullSafe(F.col("_id")), "left").drop("_id")
    judged = judged.withColumn("_words", words_of(F.col("text")))

    def same(c: Column) -> Column:
        h1, h2 = _hashes(F.slice("_words", c["start"] + 1, c["length"]))
        return (h1 == c["h1"]) & (h2 == c["h2"])

    judged = judged.withColumn("_hits", F.when(F.col("_found").isNotNull(), F.filter("_found", same)))
    bounds = F.array_sort(F.transform("_hits", lambda c: F.struct(c["start"].alias("a"), (c["start"] + c["length"]).alias("b"))))

    def merged(spans: Column, s: Column) -> Column:
        last = F.element_at(spans, -1)
        apart = (F.size(spans) == 0) | (s["a"] > F.when(F.size(spans) > 0, last["b"]))
        longer = F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))
        return F.when(apart, F.concat(spans, F.array(s))).otherwise(
            F.concat(F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))), F.array(longer))
        )

    none = F.array().cast("array<struct<a:int,b:int>>")
    judged = judged.withColumn("_spans", F.when(F.size("_hits") > 0, F.aggregate(bounds, none, merged)).otherwise(none))
    n_hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda total, s: total + s["b"] - s["a"])
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("_hits", lambda c: c["items"]))))
    result = F.struct(
        F.size("_words").cast("long").alias("_n_words"),
        F.col("_spans"),
        n_hit.alias("_n_hit"),
        F.coalesce(items, F.array().cast("array<string>")).alias("_items"),
    )
    # Through a generator: a filter on the verdict would otherwise be pushed below all this and split the text again
    # for every candidate.
    judged = judged.select(*docs.columns, F.inline(F.array(result)))
    return judged.withColumn("_contaminated", (F.col("_n_hit") > 0) & (share * F.col("_n_hit") >= F.col("_n_words")))


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated ones."""
    return find_contamination(docs, benchmark, **options).where(~F.col("_contaminated")).select(docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with the hit words (and what stands before each) cut from the texts."""
    judged = find_contamination(docs, benchmark, **options)
    word = r"[\x30-\x39\x41-\x5A\x61-\x7A\x80-\x{10FFFF}]"
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pieces = F.regexp_extract_all("text", F.lit(f"({gap}*{word}+)"), F.lit(1))
    kept = F.filter(pieces, lambda p, i: ~F.exists("_spans", lambda s: (i >= s["a"]) & (i < s["b"])))
    tail = F.regexp_extract("text", f"({gap}*)$", 1)
    text = F.when(F.size("_spans") > 0, F.concat(F.array_join(kept, ""), tail)).otherwise(F.col("text"))
    return judged.withColumn("text", text).select(docs.columns)


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    judged = find_contamination(docs, read(spark, folder, "benchmark"))
    return judged.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        F.col("_contaminated").alias("contaminated"),
    )


OP1_SQL = r"""
WITH split_items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
item_starts AS (SELECT item, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i FROM split_items WHERE len(words) > 0),
windows AS (SELECT DISTINCT item, list_slice(words, i, least(i + 12, len(words))) AS gram FROM item_starts),
sizes AS (SELECT DISTINCT len(gram) AS size FROM windows),
split_docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
doc_starts AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM split_docs),
grams AS (SELECT doc_id, i, size, list_slice(words, i, i + size - 1) AS gram FROM doc_starts, sizes WHERE i + size - 1 <= len(words)),
hits AS (SELECT doc_id, i, size, item FROM grams JOIN windows USING (gram)),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM split_docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
