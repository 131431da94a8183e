"""A Merkle manifest of the documents: a content-addressed DAG, proofs by descent from its root, and their checking.

Every document is a leaf. The leaves of a language ascend by id; every two consecutive nodes become the digest of
their digests, level by level, until one remains, the language's subroot; the subroots give the root likewise.

The DAG is stored as records digest -> children. A record stands for ``DIGIT_BITS`` binary levels at once: its
children are the up to 1,024 nodes so many levels below its digest, so a tree of 10**12 leaves has four rounds of
records. Equal subtrees have equal digests and are one record. A request for a leaf descends from the root: each
digit of its rank (base 1,024) picks a child of a record, the nodes that are not on the way are collected, and the
collected segment is reversed, since a proof is read from the leaf up. Requests below one node descend together:
what is carried down is one row per node, so the root is no hot key; the last step joins at most 1,024 requests with
the record above them.

Texts are hashed where they are read and never shuffled; what moves are ids, ranks and digests.

Defined cases: a null field is written "-"; null ids come first in their language, equal ids are ordered by leaf
digest, repeated rows are leaves of their own; a null language is a tree of its own, before the others; a single
leaf is its subroot, and an empty list of siblings has the digest of nothing; no documents give no rows. Only the
five columns of a leaf are read, so further columns, whatever their names, change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from impactframe.llm.tables import Scratch, read
from impactframe.operators.ranking import positions

#: Binary levels that a record stands for: the bits of a digit of a rank.
DIGIT_BITS = 10
SIZE = 32


# --- leaves -------------------------------------------------------------------


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(n_chars: Column | None = None) -> Column:
    """The digest of a row of documents, with another ``n_chars`` if one is given."""
    chars = F.col("n_chars") if n_chars is None else n_chars
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), chars, F.col("text")]
    return F.unhex(F.sha2(F.concat(*map(_field, fields)), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered): the digest of each row, and what it would be with one more character counted."""
    more = leaf_digest(F.col("n_chars").cast("decimal(20,0)") + 1)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return docs.select("doc_id", "lang", leaf_digest().alias("leaf"), F.when(chosen, more).alias("tampered"))


# --- one tree -----------------------------------------------------------------


def parent(*digests: bytes) -> bytes:
    return sha256(b"".join(digests).hex().encode()).digest()


def levels_above(nodes: list[bytes], height: int) -> list[list[bytes]]:
    """The nodes and the ``height`` levels above them."""
    levels = [nodes]
    for _ in range(height):
        below = levels[-1]
        levels.append([parent(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def split_digests(packed: bytes) -> list[bytes]:
    return [packed[i : i + SIZE] for i in range(0, len(packed), SIZE)]


def collected(levels: list[list[bytes]], digit: int) -> bytes:
    """What a request for one child leaves aside on its way down, reversed: lowest first."""
    aside = []
    for level in range(len(levels) - 2, -1, -1):
        other = (digit >> level) ^ 1
        if other < len(levels[level]):
            aside.append(levels[level][other])
    return b"".join(reversed(aside))


def tree_height(n: int) -> int:
    return (n - 1).bit_length()


def rounds_of(n: int) -> int:
    """Rounds of records that a tree of ``n`` leaves needs."""
    return max(1, -(-tree_height(n) // DIGIT_BITS))


_RECORD = "tree long, rank long, n long, digest binary, height int, children binary"


def _build(level: int) -> Callable[[pa.Table], pa.Table]:
    """Combine the nodes of one digit, ``level`` binary levels above the leaves, into their record."""

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("rank")
        nodes, n = group["digest"].to_pylist(), group["n"][0].as_py()
        height = min(DIGIT_BITS, tree_height(n) - level)
        top = levels_above(nodes, height)[-1][0]
        row = [group["tree"][0].as_py(), group["rank"][0].as_py() >> DIGIT_BITS, n, top, height, b"".join(nodes)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
        names = ["tree", "rank", "n", "digest", "height", "children"]
        return pa.table({k: pa.array([x], t) for k, x, t in zip(names, row, kinds, strict=True)})

    return build


@dataclass(frozen=True)
class Forest:
    """Trees over numbered leaves: the records of each round, lowest first, and (tree, n, digest) of the tops."""

    rounds: list[DataFrame]
    tops: DataFrame


def _prefix(rank: str = "rank") -> Column:
    return F.shiftright(rank, DIGIT_BITS)


def build_forest(nodes: DataFrame, largest: int, scratch: Scratch) -> Forest:
    """Build the trees of ``nodes`` (tree, rank, n, digest), where n is the number of leaves of the tree."""
    rounds, tops = [], []
    for r in range(rounds_of(largest)):
        grouped = nodes.withColumn("_digit", _prefix()).groupBy("tree", "_digit")
        made = scratch.write(grouped.applyInArrow(_build(r * DIGIT_BITS), _RECORD))
        # Where nothing was combined, the node is its own record.
        rounds.append(made.where("height > 0").select("digest", "height", "children").dropDuplicates(["digest"]))
        finished = F.col("n") <= F.lit(1 << DIGIT_BITS * (r + 1)).cast("long")
        tops.append(made.where(finished).select("tree", "n", "digest"))
        nodes = made.where(~finished).select("tree", "rank", "n", "digest")
    every = tops[0]
    for more in tops[1:]:
        every = every.unionByName(more)
    return Forest(rounds, every)


_NODE = "tree long, rank long, n long, digest binary, path binary"


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From nodes with their records to the nodes below, each with the path down to it."""
    for batch in batches:
        for row in batch.to_pylist():
            levels = levels_above(split_digests(row["children"] or row["digest"]), row["height"] or 0)
            below = levels[0]
            out = {
                "tree": pa.array([row["tree"]] * len(below), pa.int64()),
                "rank": pa.array([row["rank"] << DIGIT_BITS | i for i in range(len(below))], pa.int64()),
                "n": pa.array([row["n"]] * len(below), pa.int64()),
                "digest": pa.array(below, pa.binary()),
                "path": pa.array([collected(levels, i) + row["path"] for i in range(len(below))], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(out)


def _levels(n: Column, r: int) -> Column:
    """Whether a tree of n leaves has its highest record in round ``r``."""
    above = n <= F.lit(1 << DIGIT_BITS * (r + 1)).cast("long")
    return above if r == 0 else above & (n > F.lit(1 << DIGIT_BITS * r).cast("long"))


def descend(forest: Forest, tops: DataFrame, requests: DataFrame, scratch: Scratch) -> DataFrame:
    """From the ``tops`` (tree, n, digest, path) of the requested trees down to the records just above the requested leaves (tree, rank):
    (tree, rank, n, digest, path, height, children), where rank is that of the leaves without the last digit."""
    below = None
    for r in range(len(forest.rounds) - 1, -1, -1):
        begun = tops.where(_levels(F.col("n"), r)).select("tree", F.lit(0).cast("long").alias("rank"), "n", "digest", "path")
        nodes = begun
        if below is not None:
            wanted = requests.select("tree", F.shiftright("rank", DIGIT_BITS * (r + 1)).alias("rank")).distinct()
            nodes = begun.unionByName(below.join(wanted, ["tree", "rank"], "left_semi"))
        found = nodes.join(forest.rounds[r], "digest", "left").select("tree", "rank", "n", "digest", "path", "height", "children")
        if r == 0:
            return found
        below = scratch.write(found.mapInArrow(_expand, _NODE))
    raise AssertionError("a forest has at least one round")


# --- the manifest -------------------------------------------------------------


@dataclass(frozen=True)
class Manifest:
    """``entries`` are the leaves in their places: (tree, rank, n, doc_id, leaf, tampered); ``trees`` the languages
    with their subroots: (tree, lang, n, digest); ``top`` is the tree over the subroots."""

    entries: DataFrame
    languages: Forest
    trees: DataFrame
    top: Forest
    n_trees: int
    scratch: Scratch


def write_manifest(docs: DataFrame) -> Manifest | None:
    """Build and store the DAG; None if there are no documents."""
    scratch = Scratch(docs.sparkSession, "merkle")
    # Hashing reads every text; the range partitioning below reads its input twice.
    hashed = scratch.write(leaves(docs))
    sizes = hashed.groupBy("lang").agg(F.count("*").alias("n"))
    trees = scratch.write(positions(sizes, [], [F.asc_nulls_first("lang")], "_place").select("lang", "n", (F.col("_place") - 1).alias("tree")))
    n_trees, largest = trees.agg(F.count("*"), F.max("n")).first()
    if not n_trees:
        return None
    order = [F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("tampered")]
    placed = positions(hashed, ["lang"], order, "_place")
    numbered = placed.join(trees.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")))
    entries = scratch.write(numbered.select("tree", (F.col("_place") - 1).alias("rank"), "n", "doc_id", "leaf", "tampered"))
    languages = build_forest(entries.select("tree", "rank", "n", F.col("leaf").alias("digest")), largest, scratch)
    subroots = scratch.write(trees.join(languages.tops.select("tree", "digest"), "tree"))
    one = F.lit(0).cast("long").alias("tree")
    top = build_forest(subroots.select(one, F.col("tree").alias("rank"), F.lit(n_trees).cast("long").alias("n"), "digest"), n_trees, scratch)
    return Manifest(entries, languages, subroots, top, n_trees, scratch)


_PROOF = "doc_id long, leaf binary, tampered binary, tree long, rank long, n long, path binary"


def _answer(requests: pa.Table, records: pa.Table) -> pa.Table:
    """The last step down, for the requests below one record."""
    row = records.to_pylist()[0]
    levels = levels_above(split_digests(row["children"] or row["digest"]), row["height"] or 0)
    mask = (1 << DIGIT_BITS) - 1
    found = {}
    for rank in set(requests["rank"].to_pylist()):
        found[rank] = (levels[0][rank & mask], collected(levels, rank & mask) + row["path"])
    pairs = [found[rank] for rank in requests["rank"].to_pylist()]
    out = {name: requests[name] for name in ("doc_id", "tampered", "tree", "rank", "n")}
    out["leaf"] = pa.array([leaf for leaf, _ in pairs], pa.binary())
    out["path"] = pa.array([path for _, path in pairs], pa.binary())
    return pa.table({name.split()[0]: out[name.split()[0]] for name in _PROOF.split(", ")})


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """Proofs of the requested entries (all of them unless given): (doc_id, leaf, tampered, tree, rank, n, path).

    ``leaf`` is the digest that the descent arrives at and ``path`` the siblings from it up to the root.
    """
    scratch, requests = manifest.scratch, manifest.entries if requests is None else requests
    zero = F.lit(0).cast("long").alias("tree")
    start = manifest.top.tops.withColumn("path", F.lit(b""))
    asked = requests.select(zero, F.col("tree").alias("rank")).distinct()
    above = descend(manifest.top, start, asked, scratch).mapInArrow(_expand, _NODE)
    subroots = above.select(F.col("rank").alias("tree"), "digest", "path").join(asked.select(F.col("rank").alias("tree")), "tree", "left_semi")
    tops = scratch.write(manifest.trees.select("tree", "n").join(subroots, "tree"))
    records = descend(manifest.languages, tops, requests.select("tree", "rank"), scratch)
    left = requests.withColumn("_digit", _prefix()).groupBy("tree", "_digit")
    right = records.withColumnRenamed("rank", "_digit").groupBy("tree", "_digit")
    return left.cogroup(right).applyInArrow(_answer, _PROOF)


def fold(leaf: bytes, path: bytes, *places: tuple[int, int]) -> list[bytes]:
    """Recompute the top of each tree that a proof leads through; ``places`` are (rank, leaves) of each."""
    siblings, digest, tops = iter(split_digests(path)), leaf, []
    for rank, n in places:
        while n > 1:
            if rank ^ 1 >= n:
                digest = parent(digest)
            elif rank & 1:
                digest = parent(next(siblings), digest)
            else:
                digest = parent(digest, next(siblings))
            rank, n = rank >> 1, (n + 1) >> 1
        tops.append(digest)
    return tops


def folded(proofs: DataFrame, n_trees: int) -> DataFrame:
    """Add ``folded_root``: the root that follows from the tampered leaf, or the original one, and the siblings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = (batch.column(k).to_pylist() for k in ("leaf", "tampered", "path", "rank", "n", "tree"))
            roots = [fold(t or leaf, path, (rank, n), (tree, n_trees))[-1] for leaf, t, path, rank, n, tree in zip(*named, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], names=[*batch.schema.names, "folded_root"])

    return proofs.mapInArrow(run, f"{_PROOF}, folded_root binary")


def _hex(name: str) -> Column:
    return F.lower(F.hex(name))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    manifest = write_manifest(read(spark, folder, "documents"))
    if manifest is None:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    proofs = folded(prove(manifest), manifest.n_trees)
    subroots = manifest.trees.select("tree", F.col("digest").alias("subroot"))
    # One row.
    root = manifest.top.tops.first()["digest"]
    return proofs.join(subroots, "tree").select(
        "doc_id",
        _hex("leaf").alias("leaf"),
        _hex("subroot").alias("subroot"),
        F.lit(root.hex()).alias("root"),
        F.sha2(_hex("path"), 256).alias("proof_sha256"),
        _hex("folded_root").alias("folded_root"),
        (F.col("folded_root") == F.lit(bytes(root))).alias("verified"),
    )


OP11_SQL = """
WITH RECURSIVE hashed AS (
  SELECT doc_id, lang,
    sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || tail) AS leaf,
    CASE WHEN crc % 7 = 0
      THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR, '-') || tail) END AS tampered
  FROM (
    SELECT doc_id, lang, n_chars,
      coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
        || coalesce(strlen(lang) || ':' || lang, '-') AS head,
      coalesce(strlen(text) || ':' || text, '-') AS tail,
      xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda a, b: list_reduce(
          list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
          lambda v, bit: xor(v >> 1, (v & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) AS crc
    FROM documents)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r,
    count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS k FROM hashed),
up AS (
  SELECT lang, 0 AS lvl, r AS pos, leaf AS d, n AS m FROM placed
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (m + 1) // 2
  FROM up WHERE m > 1 GROUP BY lang, lvl, pos // 2, m),
trees AS (
  SELECT lang, d AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree, count(*) OVER () AS nt
  FROM up WHERE m = 1),
over AS (
  SELECT 0 AS lvl, tree AS pos, subroot AS d, nt AS m FROM trees
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (m + 1) // 2 FROM over WHERE m > 1 GROUP BY lvl, pos // 2, m),
siblings AS (
  SELECT p.k, u.lvl AS step, u.d FROM placed p JOIN up u
    ON u.lang IS NOT DISTINCT FROM p.lang AND u.m > 1 AND u.pos = xor(p.r >> u.lvl, 1)
  UNION ALL
  SELECT p.k, 1000 + o.lvl, o.d FROM placed p JOIN trees t ON t.lang IS NOT DISTINCT FROM p.lang
    JOIN over o ON o.m > 1 AND o.pos = xor(t.tree >> o.lvl, 1)),
folded AS (
  SELECT p.k, 0 AS step, p.r AS pos, p.n AS m, t.tree, t.nt, coalesce(p.tampered, p.leaf) AS d
  FROM placed p JOIN trees t ON t.lang IS NOT DISTINCT FROM p.lang
  UNION ALL
  SELECT f.k, CASE WHEN f.m = 1 THEN 1000 ELSE f.step + 1 END, CASE WHEN f.m = 1 THEN f.tree ELSE f.pos // 2 END,
    CASE WHEN f.m = 1 THEN f.nt ELSE (f.m + 1) // 2 END, f.tree, f.nt,
    CASE WHEN f.m = 1 THEN f.d WHEN s.d IS NULL THEN sha256(f.d) WHEN f.pos % 2 = 1 THEN sha256(s.d || f.d)
      ELSE sha256(f.d || s.d) END
  FROM folded f LEFT JOIN siblings s ON s.k = f.k AND s.step = f.step AND f.m > 1
  WHERE f.m > 1 OR f.step < 1000)
SELECT p.doc_id, p.leaf, t.subroot, o.d AS root, sha256(coalesce(g.path, '')) AS proof_sha256, f.d AS folded_root,
  f.d = o.d AS verified
FROM placed p JOIN trees t ON t.lang IS NOT DISTINCT FROM p.lang JOIN over o ON o.m = 1
  JOIN folded f ON f.k = p.k AND f.m = 1 AND f.step >= 1000
  LEFT JOIN (SELECT k, string_agg(d, '' ORDER BY step) AS path FROM siblings GROUP BY k) g ON g.k = p.k
"""
