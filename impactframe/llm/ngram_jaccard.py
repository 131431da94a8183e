"""Jaccard join on word shingles with adaptive multi-match prefixes.

All shingles have one global order: those of a hash zone before the others, then by the number of texts that hold
them, then by hash. If two sets of sizes r and s have a Jaccard similarity of t or more, their overlap is at least
ceil(t r) and ceil(t s), so for every l their prefixes of n - ceil(t n) + l shingles share l shingles or more. Each
set takes the l with the least estimated cost of its candidates (reading the lists of its prefix, and verifying:
at most a 1/l of what was read can share l); if a prefix has fewer than l shingles that anybody else holds, the set
has no partner at all. Pairs that share min(l, l') prefix shingles are verified on the whole sets.

Only the zone is shipped and counted, since a prefix hardly ever leaves it; sets whose prefix does send the rest.

Texts with the same set are one class. Classes are first linked with one leader each, in a few turns; what that
joins needs no further pairs among itself, so a group of thousands of near copies costs about one pair a member.
Lists lose the entries that no other component of the list can be similar to: an overlap is at most what a set
shares with anybody, so a passage that thousands of otherwise different texts hold gives no pairs. Only what is
left of the lists then is joined with itself. When the components are known, every link inside them is counted: the
sets of a component meet tile by tile, so a text's number of links is of all that reach the limit, not of those that
led to the component.

Defined cases: a text of fewer words than a shingle is one shingle, a text without words (null, empty) has none and
no links; rows with the same id are one document, whatever texts they have: these are compared one by one, and all
their components are one; a null id is one id below all others, given back as null; no
documents give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactframe.llm import textblock as tb
from impactframe.llm.blocks import gather, send, sent_schema
from impactframe.llm.components import components
from impactframe.llm.tables import Scratch, read

WORDS = 5
#: Similarity as a fraction.
SIMILARITY = (3, 4)
#: Share of all hashes whose shingles are counted.
ZONE = 0.36
#: Cost of verifying a candidate, in list entries read.
VERIFY_COST = 50.0
#: Times that every class tries a leader.
LEADER_TURNS = 2
#: Times that lists lose the entries without a possible partner, before each use.
PRUNE_TURNS = 2
#: Matches that the last join asks of a pair at most: what leaders left makes fewer rows in short prefixes.
LAST_MATCHES = 2
#: Bytes of hashes in a bucket, and in a tile of a component.
BUCKET_BYTES = 4 << 20
#: Sets in a tile.
TILE_SETS = 512
#: Shingles of a tile that are compared at once.
TILE_COLUMNS = 4096
#: Prefix extensions to choose from.
MATCHES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128)
NO_ID = -(2**63)

_ENTRIES = "shingle long, node long, n long, matches long, place long"

_LIMIT = np.uint64(int(ZONE * 2**64))


def least_overlap(n, similarity=SIMILARITY):
    num, den = similarity
    return (n * num + den - 1) // den


def shingle_sets(block: tb.Block, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    data = tb.lower_ascii(block.data)
    starts, ends = block.spans(tb.WORD[data])
    h = tb.span_hash(data, starts, ends, 1)
    sets = []
    for own in tb.segments(h, block.counts(block.owner(starts))):
        width = min(words, len(own))
        if width == 0:
            sets.append(own)
            continue
        total = np.zeros(len(own) - width + 1, dtype=np.uint64)
        for k in range(width):
            total = total * np.uint64(0x9E3779B97F4A7C15) + own[k : k + len(total)]
        sets.append(np.unique(tb.mix(total + np.uint64(width))))
    return sets


def _sent(x: np.ndarray, similarity) -> tuple[np.ndarray, int]:
    """What a set ships, and how many of these are of the zone."""
    n = len(x)
    zone = int(np.searchsorted(x, _LIMIT))
    enough = n - least_overlap(n, similarity) + 1 + n // 25
    return (x[:zone] if zone >= enough else x), zone


def _key(x: np.ndarray) -> tuple[int, int]:
    return int(x.sum(dtype=np.uint64).view(np.int64)), int(tb.mix(x * np.uint64(3)).sum(dtype=np.uint64).view(np.int64))


def _signatures(words: int, similarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches):
            sets = shingle_sets(block, words)
            keys = np.array([_key(x) for x in sets], dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("key"),
                    block.column("doc_id"),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([_sent(x, similarity)[1] for x in sets], pa.int64()),
                    pa.array(keys[:, 0]),
                    pa.array(keys[:, 1]),
                ],
                names=["key", "doc_id", "n", "zone", "f1", "f2"],
            )

    return run


def _to_buckets(buckets: int, words: int, similarity):
    """Rows (bucket, hashes, owners, f1, f2): the shipped shingles of a block, and the keys of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches):
            distinct = {_key(x): _sent(x, similarity)[0] for x in shingle_sets(block, words) if len(x)}
            if not distinct:
                continue
            keys = np.array(list(distinct), dtype=np.int64)
            hashes = np.concatenate(list(distinct.values()))
            owners = np.repeat(np.arange(len(keys), dtype=np.int32), [len(x) for x in distinct.values()])
            bucket = (tb.mix(hashes) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out: dict[str, list] = {"bucket": [], "hashes": [], "owners": [], "f1": [], "f2": []}
            for b in np.flatnonzero(np.diff(edges)).tolist():
                own = order[edges[b] : edges[b + 1]]
                present, local = np.unique(owners[own], return_inverse=True)
                out["bucket"].append(b)
                out["hashes"].append(hashes[own].tobytes())
                out["owners"].append(local.astype(np.int32).tobytes())
                out["f1"].append(keys[present, 0].tobytes())
                out["f2"].append(keys[present, 1].tobytes())
            kinds = [pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Of one bucket: (f1, f2, shingle, df) for the shingles that several sets hold."""
    kinds = {"hashes": np.uint64, "owners": np.int32, "f1": np.int64, "f2": np.int64}
    parts = {name: [np.frombuffer(x, t) for x in table[name].to_pylist()] for name, t in kinds.items()}
    base = np.cumsum([0, *(len(x) for x in parts["f1"][:-1])])
    owners = np.concatenate([x + low for x, low in zip(parts["owners"], base.tolist(), strict=True)])
    hashes, f1, f2 = (np.concatenate(parts[name]) for name in ("hashes", "f1", "f2"))
    # Copies in several blocks are one set: number the sets by their keys.
    _, at, number = np.unique(np.rec.fromarrays([f1, f2], names="f1,f2"), return_index=True, return_inverse=True)
    owners = number[owners]
    order = np.lexsort((owners, hashes))
    hashes, owners = hashes[order], owners[order]
    fresh = np.append(True, (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1]))
    hashes, owners = hashes[fresh], owners[fresh]
    begins = np.append(True, hashes[1:] != hashes[:-1])
    df = np.diff(np.append(np.flatnonzero(begins), len(hashes)))
    df = np.repeat(df, df)
    many = df > 1
    own = at[owners[many]]
    return pa.table({"f1": f1[own], "f2": f2[own], "shingle": hashes[many].view(np.int64), "df": df[many].astype(np.int64)})


def choose_prefix(n: int, zone: int, shingles: np.ndarray, df: np.ndarray, similarity=SIMILARITY, whole: bool = False):
    """The number of matches to ask for, the repeated shingles of that prefix and their places in the set's order;
    no shingles if there is no partner.

    ``shingles`` (as unsigned numbers) and ``df`` are those that other sets hold too: of all (``whole``), or of the
    shipped ones, of which ``zone`` are of the zone.
    """
    shared = n - least_overlap(n, similarity)
    if whole:
        zone, inside, shipped = n, np.ones(len(shingles), dtype=bool), n
    else:
        inside = shingles < _LIMIT
        shipped = zone if zone >= shared + 1 + n // 25 else n
    order = np.lexsort((shingles, df, ~inside))
    shingles, df, inside = shingles[order], df[order], inside[order]
    in_zone = int(inside.sum())
    rank = np.arange(len(shingles))
    # Before the repeated ones of each part stand those that only this set holds.
    rank[:in_zone] += zone - in_zone
    rank[in_zone:] += zone - in_zone + (n - zone - (len(shingles) - in_zone))
    most = min(least_overlap(n, similarity), shipped - shared)
    if not whole and shipped == n:
        # A similar set may ship its zone alone, which is sure to hold its prefix only up to this many matches.
        most = min(most, 1 + least_overlap(n, similarity) // 25)
    num, den = similarity
    # Beside a set of the same size a shorter prefix is enough; that is what is read most.
    near = n - least_overlap(n, (2 * num, num + den))
    best, chosen = None, (1, shingles[:0], rank[:0])
    for matches in MATCHES:
        if matches > most:
            break
        size = int(np.searchsorted(rank, shared + matches))
        if size < matches:
            return matches, shingles[:0], rank[:0]
        read = float((df[: int(np.searchsorted(rank, near + matches))] - 1).sum())
        cost = read + VERIFY_COST * read / matches
        if best is None or cost < best:
            best, chosen = cost, (matches, shingles[:size], rank[:size])
    return chosen


def _prefixes(similarity, whole: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"shingle": [], "node": [], "n": [], "matches": [], "place": []}
            lists = batch.column("lists")
            flat, sizes = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
            shingles = tb.segments(flat.field("shingle").to_numpy().view(np.uint64), sizes)
            dfs = tb.segments(flat.field("df").to_numpy(), sizes)
            for node, n, zone, x, df in zip(*(batch.column(k).to_pylist() for k in ("node", "n", "zone")), shingles, dfs, strict=True):
                matches, prefix, place = choose_prefix(n, zone, x, df, similarity, whole)
                if len(prefix):
                    out["shingle"].append(prefix.view(np.int64))
                    out["node"].append(np.full(len(prefix), node))
                    out["n"].append(np.full(len(prefix), n))
                    out["matches"].append(np.full(len(prefix), matches))
                    out["place"].append(place)
            columns = [np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in out.values()]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=list(out))

    return run


def _verified(similarity):
    num, den = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(den * both >= num * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _sets_to_buckets(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("shingles")]
            for low in range(0, len(sets), 256):
                part, nodes = sets[low : low + 256], batch.column("node").slice(low, 256).to_numpy()
                hashes, owners = np.concatenate(part), np.repeat(nodes, list(map(len, part)))
                bucket = (tb.mix(hashes) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                filled = np.flatnonzero(np.diff(edges)).tolist()
                own = [order[edges[b] : edges[b + 1]] for b in filled]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(filled, pa.int32()),
                        pa.array([hashes[x].tobytes() for x in own], pa.binary()),
                        pa.array([owners[x].tobytes() for x in own], pa.binary()),
                    ],
                    names=["bucket", "hashes", "owners"],
                )

    return run


def _repeats(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one bucket: nodes, shingles and counts, for the shingles that several nodes hold."""
    parts = [np.concatenate([np.frombuffer(x, t) for x in table[k].to_pylist()]) for k, t in (("hashes", np.uint64), ("owners", np.int64))]
    order = np.lexsort(parts[::-1])
    hashes, owners = (x[order] for x in parts)
    fresh = np.append(True, (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1]))
    hashes, owners = hashes[fresh], owners[fresh]
    begins = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    df = np.diff(np.append(begins, len(hashes)))
    df = np.repeat(df, df)
    many = df > 1
    return owners[many], hashes[many], df[many]


def _entries(table: pa.Table) -> pa.Table:
    nodes, shingles, df = _repeats(table)
    return pa.table({"node": nodes, "shingle": shingles.view(np.int64), "df": df.astype(np.int64)})


def _held(buckets: int):
    """How many of the bucket's shingles each node shares with others, dealt by node."""

    def run(table: pa.Table) -> pa.Table:
        nodes, counts = np.unique(_repeats(table)[0], return_counts=True)
        return send(table["bucket"][0].as_py(), nodes.view(np.uint64), buckets, {"nodes": nodes, "held": counts.astype(np.int32)})

    return run


def _add_held(table: pa.Table) -> pa.Table:
    _, got = gather(table, nodes=np.int64, held=np.int32)
    nodes, number = np.unique(got["nodes"], return_inverse=True)
    return pa.table({"node": nodes, "held": np.bincount(number, weights=got["held"]).astype(np.int64)})


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches):
            sets = shingle_sets(block, words)
            packed = pa.array([x.tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([block.column("key"), packed], names=["node", "shingles"])

    return run


def _may_link(num: int):
    """Different components, and neither set's room (see below) is too small for the other's size."""
    rooms = (F.col("room") >= num * F.col("n_b")) & (F.col("room_b") >= num * F.col("n"))
    return (F.col("component") != F.col("component_b")) & rooms


def _need(both, similarity):
    """The least overlap of a similar pair whose sizes add up to ``both``."""
    num, den = similarity
    return F.ceil(both * num / (num + den))


def _with_partners(
    left: DataFrame, similarity: tuple[int, int], scratch: Scratch, turns: int = PRUNE_TURNS, places: bool = True
) -> DataFrame:
    """The list entries for which another component has an entry of the list that is small enough and roomy enough,
    and that are (``places``) within the prefix that the smallest such set asks for.

    Per list, the smallest size and the largest room are kept for the two best components, so every entry can look
    past its own component.

    ``left`` is a written table. A turn reads its lists three times, so they are written between turns as well: the
    plan of a turn within the next one's would be three times as large with every turn, on the driver too.
    """
    num = similarity[0]
    for turn in range(turns):
        if turn:
            left = scratch.write(left)
        by = left.groupBy("shingle", "component").agg(F.min("n").alias("n"), F.max("room").alias("room"))
        best = by.groupBy("shingle").agg(
            F.min(F.struct("n", "component")).alias("small"), F.max(F.struct("room", "component")).alias("roomy")
        )
        other = by.join(best, "shingle").groupBy("shingle").agg(
            F.min(F.when(F.col("component") != F.col("small.component"), F.col("n"))).alias("small_other"),
            F.max(F.when(F.col("component") != F.col("roomy.component"), F.col("room"))).alias("roomy_other"),
        )
        best = best.join(other, "shingle")
        small = F.when(F.col("component") != F.col("small.component"), F.col("small.n")).otherwise(F.col("small_other"))
        roomy = F.when(F.col("component") != F.col("roomy.component"), F.col("roomy.room")).otherwise(F.col("roomy_other"))
        fits = (F.col("room") >= num * small) & (roomy >= num * F.col("n"))
        if places:
            fits &= F.col("place") < F.col("n") - _need(F.col("n") + small, similarity) + F.col("matches")
        left = left.join(best, "shingle").where(fits).select(left.columns)
    return left


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles every set of ``left`` shares with every one of ``right``."""
    sets = left + right
    hashes, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), list(map(len, sets)))
    order = np.argsort(hashes, kind="stable")
    hashes, own = hashes[order], own[order]
    begins = np.append(True, hashes[1:] != hashes[:-1])
    df = np.diff(np.append(np.flatnonzero(begins), len(hashes)))
    many = np.repeat(df, df) > 1
    own, column = own[many], np.cumsum(begins[many]) - 1
    both = np.zeros((len(left), len(right)), dtype=np.int64)
    columns = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, columns, TILE_COLUMNS):
        edges = np.searchsorted(column, [low, low + TILE_COLUMNS])
        held = np.zeros((len(sets), min(TILE_COLUMNS, columns - low)), dtype=np.float32)
        held[own[slice(*edges)], column[slice(*edges)] - low] = 1
        both += (held[: len(left)] @ held[len(left) :].T).astype(np.int64)
    return both


def _tile_links(similarity):
    """Of some pairs of tiles: how many sets of the one tile are similar to each set of the other, or of the same."""
    num, den = similarity

    def run(table: pa.Table) -> pa.Table:
        keys = np.stack([table[k].to_numpy() for k in ("component", "first", "second")], axis=1)
        node, tile, packed = table["node"].to_numpy(), table["tile"].to_numpy(), table["shingles"].to_pylist()
        _, number = np.unique(keys, axis=0, return_inverse=True)
        order = np.lexsort((node, number.ravel()))
        nodes, counts = [], []
        for rows in tb.segments(order, np.bincount(number.ravel())):
            # A row of the table that came twice has its set twice.
            rows = rows[np.append(True, node[rows[1:]] != node[rows[:-1]])]
            sets, (_, first, second) = [np.frombuffer(packed[i], np.uint64) for i in rows.tolist()], keys[rows[0]].tolist()
            a = np.flatnonzero(tile[rows] == first)
            b = np.flatnonzero(tile[rows] == second)
            if not len(a) or not len(b):
                continue
            both = _overlaps([sets[i] for i in a.tolist()], [sets[i] for i in b.tolist()])
            sizes = np.array(list(map(len, sets)), dtype=np.int64)
            linked = den * both >= num * (sizes[a][:, None] + sizes[b][None, :] - both)
            if first == second:
                np.fill_diagonal(linked, False)
            else:
                nodes.append(node[rows[b]])
                counts.append(linked.sum(axis=0))
            nodes.append(node[rows[a]])
            counts.append(linked.sum(axis=1))
        columns = [np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (nodes, counts)]
        return pa.table(dict(zip(("node", "links"), columns, strict=True)))

    return run


def _count_links(sets: DataFrame, members: DataFrame, similarity: tuple[int, int], buckets: int) -> DataFrame:
    """(node, n_links) for the ``members`` (node, component, n): with how many others of its component each is similar.

    A component's sets are dealt to tiles of a bounded size, and every two tiles meet; small components go together.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("sets"), F.sum("n").alias("size"))
    tiles = F.ceil(F.greatest(F.col("sets") / TILE_SETS, F.col("size") / (BUCKET_BYTES // 8)))
    dealt = members.join(sizes.select("component", tiles.alias("tiles")), "component")
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("node"), "tiles")).join(sets, "node")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    pair = F.least("tile", "other").alias("first"), F.greatest("tile", "other").alias("second")
    dealt = dealt.select("component", *pair, "tile", "tiles", "node", "shingles")
    together = F.pmod(F.xxhash64("component"), F.lit(buckets))
    dealt = dealt.withColumn("bin", F.when(F.col("tiles") > 1, F.xxhash64("component", "first", "second")).otherwise(together))
    counted = dealt.groupBy("bin").applyInArrow(_tile_links(similarity), "node long, links long")
    return counted.groupBy("node").agg(F.sum("links").alias("n_links"))


def _same_ids(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) between the classes of different texts that have one id."""
    kind = F.struct("f1", "f2")
    several = signed.where("n > 0").groupBy("doc_id").agg(F.min(kind).alias("low"), F.max(kind).alias("high")).where("low <> high")
    several = several.select("doc_id", F.col("low.f1").alias("g1"), F.col("low.f2").alias("g2"))
    nodes = classes.select("f1", "f2", F.col("node").alias("a"))
    lows = classes.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("node").alias("b"))
    return signed.where("n > 0").join(several, "doc_id").join(nodes, ["f1", "f2"]).join(lows, ["g1", "g2"]).select("a", "b").distinct()


def jaccard_components(
    docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY, count_links: bool = True
) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of ``docs`` (doc_id, text).

    ``n_links`` is the number of other classes that the class of the document is similar to; without ``count_links``
    the column is left out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-jaccard")
    num, den = similarity
    docs = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    # Texts that share an id are told apart.
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    signed = scratch.write(docs.mapInArrow(_signatures(words, similarity), "key long, doc_id long, n long, zone long, f1 long, f2 long"))
    classes = signed.where("n > 0").groupBy("f1", "f2").agg(
        F.min("key").alias("node"), F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("zone").alias("zone")
    )
    classes = scratch.write(classes)
    # Buckets of a bounded size, so that a task's memory does not follow the number of partitions.
    shipped = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * 8
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(shipped / BUCKET_BYTES))
    repeated = (
        docs.mapInArrow(_to_buckets(buckets, words, similarity), "bucket int, hashes binary, owners binary, f1 binary, f2 binary")
        .groupBy("bucket")
        .applyInArrow(_repeated, "f1 long, f2 long, shingle long, df long")
        .groupBy("f1", "f2")
        .agg(F.collect_list(F.struct("shingle", "df")).alias("lists"))
    )
    lists = classes.join(repeated, ["f1", "f2"]).select("node", "n", "zone", "lists")
    prefix = scratch.write(lists.mapInArrow(_prefixes(similarity), _ENTRIES))
    nodes = prefix.select(F.col("node").alias("key")).distinct()
    sets = scratch.write(docs.join(nodes, "key", "left_semi").mapInArrow(_sets(words), "node long, shingles binary"))

    def bucketed(sets: DataFrame):
        return sets.mapInArrow(_sets_to_buckets(buckets), "bucket int, hashes binary, owners binary").groupBy("bucket")

    # A pair's overlap is at most what either set shares with anybody: it needs (den + num) held >= num (n + m).
    room = F.col("held") * (num + den) - F.col("n") * num
    held = bucketed(sets).applyInArrow(_held(buckets), sent_schema("nodes", "held"))
    held = held.groupBy("bucket").applyInArrow(_add_held, "node long, held long")
    roomy = prefix.select("shingle", "node", "n").join(held, "node").withColumn("room", room).where(F.col("room") > 0)
    roomy = scratch.write(roomy).withColumn("component", F.col("node"))
    roomy = _with_partners(roomy, similarity, scratch, places=False)
    nodes = roomy.select("node", "n", "held", "room").distinct()
    nodes = scratch.write(nodes.join(classes.select("node", F.col("doc_id").alias("lowest")), "node"))
    sets = scratch.write(sets.join(nodes.select("node"), "node", "left_semi"))
    # What is left gets its prefixes in the order of whole sets, by counts among what is left.
    repeated = (
        bucketed(sets)
        .applyInArrow(_entries, "node long, shingle long, df long")
        .groupBy("node")
        .agg(F.collect_list(F.struct("shingle", "df")).alias("lists"))
    )
    lists = nodes.join(repeated, "node").select("node", "n", F.col("n").alias("zone"), "lists")
    prefix = lists.mapInArrow(_prefixes(similarity, whole=True), _ENTRIES)
    prefix = scratch.write(prefix.join(nodes.select("node", "held", "lowest", "room"), "node"))

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"set_{k}")) for k in "ab")
        return scratch.write(pairs.join(a, "a").join(b, "b").mapInArrow(_verified(similarity), "a long, b long"))

    links, left = None, prefix.withColumn("component", F.col("node"))
    for turn in range(LEADER_TURNS):
        left = scratch.write(_with_partners(left, similarity, scratch))
        # First the set with the least of its own, which the others may derive from, ties by id; then any.
        order = F.struct(F.col("n") - F.col("held"), "lowest") if turn == 0 else F.xxhash64("node", F.lit(turn))
        leader = F.struct(order.alias("order"), F.col("node").alias("b"), *(F.col(k).alias(f"{k}_b") for k in ("n", "room", "component")))
        leaders = left.groupBy("shingle").agg(F.min(leader).alias("leader")).select("shingle", "leader.*")
        led = (
            left.withColumnRenamed("node", "a").join(leaders, "shingle").where(_may_link(num))
            .groupBy("a", "b")
            .agg(F.count("*").alias("c"))
            .groupBy("a")
            .agg(F.max_by("b", F.struct("c", -F.col("b"))).alias("b"))
        )
        fresh = verified(led)
        links = fresh if links is None else scratch.write(links.union(fresh))
        joined = components(links, scratch)
        left = left.drop("component").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        left = scratch.write(left)
    left = scratch.write(_with_partners(left, similarity, scratch))
    carried = ("n", "room", "component", "matches", "place")
    a, b = (
        left.select("shingle", F.col("node").alias(k), *(F.col(c).alias(c + end) for c in carried))
        for k, end in (("a", ""), ("b", "_b"))
    )
    # For this very pair the overlap has to be ``need``, so prefixes of n - need + least share ``least``.
    need, least = _need(F.col("n") + F.col("n_b"), similarity), F.least("matches", "matches_b", F.lit(LAST_MATCHES))
    pairs = (
        a.join(b, "shingle")
        .where(_may_link(num) & (F.col("a") < F.col("b")))
        .where((F.col("place") < F.col("n") - need + least) & (F.col("place_b") < F.col("n_b") - need + least))
        .groupBy("a", "b")
        .agg(F.count("*").alias("c"), F.max(least).alias("least"))
        .where("c >= least")
    )
    links = scratch.write(links.union(verified(pairs.select("a", "b"))).distinct())
    linked = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    found = scratch.write(components(links.union(_same_ids(signed, classes)), scratch))
    lowest = classes.join(found, "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    placed = found.join(lowest, "component").select("node", "component_id")
    placed = classes.withColumnRenamed("doc_id", "own").join(placed, "node", "left")
    kept = ["f1", "f2", F.coalesce("component_id", "own").alias("component_id")]
    if count_links:
        # Whoever is similar to anybody has a link by now.
        members = nodes.select("node", "n").join(found, "node").join(linked, "node", "left_semi")
        counts = scratch.write(_count_links(sets, members, similarity, buckets))
        placed = placed.join(counts, "node", "left")
        kept.append(F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rows = signed.join(placed.select(kept), ["f1", "f2"], "left")
    known = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    columns = [
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.nullif(known, F.lit(NO_ID)).alias("component_id"),
    ]
    return rows.select(*columns, *([F.coalesce("n_links", F.lit(0)).alias("n_links")] if count_links else []))


def op8_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(read(spark, folder, "documents"))
