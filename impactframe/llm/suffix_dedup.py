"""Removal of long repeated substrings by prefix doubling on sampled positions.

A full suffix array ranks every byte; here only positions that every window of ``LENGTH`` bytes agrees on are
ranked: in each window the start of the ``SEED`` bytes with the smallest hash. Consecutive windows with the same
such position form a run. Equal windows have their position at the same place, so

1. runs are ranked by their ``SEED`` bytes; those whose rank is unique have no repeated window and leave;
2. the others are ranked by the pair of that rank and the rank of all bytes of the run's windows, which reaches to
   twice the length and more. Of equal runs all but the first are repeats as a whole; a first one whose pair has no
   other partner of the same seed is settled as well;
3. what is left (runs that agree only in part, at the ends of repeated passages) is ranked by whole windows, past
   the threshold; every window but the first of its rank is a repeat.

Ranks are hashes of the bytes (64 bits, of distinct purpose in each round), so that no round has to look up the rank
of a position elsewhere; a round shuffles the pairs by rank, sorts them there and sends back what it decided. Only
one run in about 25 bytes takes part in the first round and only repeated text in the others. Texts are kept in one
table bucketed by block, which all rounds read without another shuffle.

Defined cases: a null or empty text has no bytes; texts shorter than ``LENGTH`` have no windows; rows with the
same id are of equal rank, so that a string at the same place in both is first in both: repeated rows get the same
result each; a null id is an id below all others; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactframe.llm import textblock as tb
from impactframe.llm.blocks import gather, nothing_sent, pack, pack_array, send, sent_schema, unpack, unpack_array
from impactframe.llm.tables import Scratch, read

LENGTH = 100
SEED = 52
NO_ID = -(2**63)

#: Bits of a place in its block; the other 28 bits hold the hash that a place is chosen by.
_PLACE_BITS = np.uint64(36)
_PLACE = np.uint64((1 << 36) - 1)


@dataclass
class Runs:
    """Of one block: owner, first and last window, ranked position, and what spans are hashed with."""

    owner: np.ndarray
    first: np.ndarray
    last: np.ndarray
    place: np.ndarray
    sums: np.ndarray
    data: np.ndarray

    def seeds(self) -> np.ndarray:
        return tb.rolling_hash(self.sums, self.place, self.place + SEED)

    def spans(self, rows: np.ndarray) -> np.ndarray:
        whole = tb.span_hash(self.data, self.first[rows], self.last[rows] + LENGTH, 22)
        return tb.mix(whole + (self.place[rows] - self.first[rows]).astype(np.uint64))


def runs(block: tb.Block) -> Runs:
    n = len(block.data)
    sums = tb.rolling_sums(block.data, 21)
    empty = np.empty(0, np.int64)
    if n < LENGTH:
        return Runs(empty, empty, empty, empty, sums, block.data)
    seeds = tb.rolling_hash(sums, np.arange(n - SEED + 1), np.arange(SEED, n + 1))
    least = (seeds >> _PLACE_BITS) << _PLACE_BITS | np.arange(len(seeds), dtype=np.uint64)
    # The least of each LENGTH - SEED + 1 neighbours, by doubling.
    width, size = LENGTH - SEED + 1, 1
    while size < width:
        gap = min(size, width - size)
        least = np.minimum(least[:-gap], least[gap:])
        size += gap
    place = (least & _PLACE).astype(np.int64)
    owner = np.repeat(np.arange(len(block)), np.diff(block.bounds))[: len(place)]
    whole = np.arange(len(place)) + LENGTH <= block.bounds[1:][owner]
    windows = np.flatnonzero(whole)
    place, owner = place[windows], owner[windows]
    begins = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]))) if len(place) else empty
    ends = np.append(begins[1:], len(place)) - 1 if len(place) else empty
    return Runs(owner[begins], windows[begins], windows[ends], place[begins], sums, block.data)


def _read(table: pa.Table) -> tuple[int, tb.Block, np.ndarray]:
    """Number, texts and ids of the one block of the table."""
    row = table.to_pylist()[0]
    block, ids = unpack(row)
    return row["block"], block, np.array([NO_ID if i is None else i for i in ids], dtype=np.int64)


def _answers(table: pa.Table, sender: np.ndarray, chosen: np.ndarray, numbers: np.ndarray, kind: int) -> pa.Table:
    """The chosen entries' numbers, to the blocks that sent them."""
    parts = np.split(numbers[chosen].astype(np.int32), np.searchsorted(sender[chosen], np.arange(1, table.num_rows)))
    some = [i for i, x in enumerate(parts) if len(x)]
    return pa.table(
        {
            "block": table["block"].take(pa.array(some, pa.int64())),
            "kind": pa.array(np.full(len(some), kind, dtype=np.int32)),
            "numbers": pa.array([pack_array(parts[i]) for i in some], pa.binary()),
        }
    )


_ANSWER = "block long, kind int, numbers binary"


def _numbers(table: pa.Table, kind: int) -> np.ndarray:
    parts = [unpack_array(r["numbers"], np.int32) for r in table.to_pylist() if r["kind"] == kind]
    return np.sort(np.concatenate(parts)) if parts else np.empty(0, np.int32)


def _send_seeds(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                number, block, _ = _read(batch.slice(at, 1))
                seeds = runs(block).seeds()
                columns = {"rank": (seeds >> np.uint64(32)).astype(np.uint32), "number": np.arange(len(seeds), dtype=np.int32)}
                yield from send(number, seeds, buckets, columns).to_batches()

    return run


def _rank_seeds(table: pa.Table) -> pa.Table:
    """Half a hash is enough here: a chance repeat only takes part in the next round."""
    sender, got = gather(table, rank=np.uint32, number=np.int32)
    _, number, size = np.unique(got["rank"], return_inverse=True, return_counts=True)
    return _answers(table, sender, np.flatnonzero(size[number] > 1), got["number"], 0)


def _send_pairs(buckets: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return nothing_sent(*_PAIR)
        block_number, block, ids = _read(table)
        own, rows = runs(block), _numbers(answers, 0)
        seeds = own.seeds()[rows]
        columns = {
            "seed": seeds,
            "span": own.spans(rows),
            "doc": ids[own.owner[rows]],
            "place": own.place[rows] - block.bounds[own.owner[rows]],
            "number": rows,
        }
        return send(block_number, seeds, buckets, columns)

    return run


_PAIR = ("seed", "span", "doc", "place", "number")


def _firsts(keys: list[np.ndarray], doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups of equal keys (numbers by entry), and which entries are first in theirs by (doc, place)."""
    order = np.lexsort((place, doc, *keys[::-1]))
    fresh = np.zeros(len(order), dtype=bool)
    fresh[:1] = True
    for key in keys:
        fresh[1:] |= key[order[1:]] != key[order[:-1]]
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(fresh) - 1
    head = order[fresh]
    return number, (doc == doc[head][number]) & (place == place[head][number])


def _rank_pairs(table: pa.Table) -> pa.Table:
    sender, got = gather(table, seed=np.uint64, span=np.uint64, doc=np.int64, place=np.int64, number=np.int32)
    pair, first = _firsts([got["seed"], got["span"]], got["doc"], got["place"])
    _, at = np.unique(pair, return_index=True)
    seed = np.unique(got["seed"], return_inverse=True)[1]
    pairs_of_seed = np.bincount(seed[at], minlength=seed.max() + 1)
    repeats = _answers(table, sender, np.flatnonzero(~first), got["number"], 1)
    open_runs = _answers(table, sender, np.flatnonzero(first & (pairs_of_seed[seed] > 1)), got["number"], 2)
    return pa.concat_tables([repeats, open_runs])


def _window_list(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the runs, and the run of each."""
    sizes = last - first + 1
    run = np.repeat(np.arange(len(first)), sizes)
    return first[run] + np.arange(len(run)) - (np.cumsum(sizes) - sizes)[run], run


def _send_windows(buckets: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows = _numbers(answers, 2)
        if not table.num_rows or not len(rows):
            return nothing_sent(*_WINDOW)
        block_number, block, ids = _read(table)
        own = runs(block)
        windows, of = _window_list(own.first[rows], own.last[rows])
        owner = own.owner[rows][of]
        ranks = tb.span_hash(block.data, windows, windows + LENGTH, 23)
        columns = {"rank": ranks, "doc": ids[owner], "place": windows - block.bounds[owner], "number": windows.astype(np.int32)}
        return send(block_number, ranks, buckets, columns)

    return run


_WINDOW = ("rank", "doc", "place", "number")


def _rank_windows(table: pa.Table) -> pa.Table:
    sender, got = gather(table, rank=np.uint64, doc=np.int64, place=np.int64, number=np.int32)
    _, first = _firsts([got["rank"]], got["doc"], got["place"])
    return _answers(table, sender, np.flatnonzero(~first), got["number"], 3)


def _remove(table: pa.Table, answers: pa.Table) -> pa.Table:
    if not table.num_rows:
        return _RESULT
    _, block, ids = _read(table)
    repeats, windows = _numbers(answers, 1), _numbers(answers, 3).astype(np.int64)
    if len(repeats):
        own = runs(block)
        windows = np.concatenate([windows, _window_list(own.first[repeats], own.last[repeats])[0]])
    edge = np.zeros(len(block.data) + 1, dtype=np.int64)
    np.add.at(edge, windows, 1)
    np.add.at(edge, windows + LENGTH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    starts, ends = block.spans(gone)
    removed = np.bincount(block.owner(starts), weights=ends - starts, minlength=len(block)).astype(np.int64)
    spans = block.counts(block.owner(starts))
    kept = np.concatenate([[0], np.cumsum(~gone)])[block.bounds]
    content = block.data[~gone].tobytes()
    relative = starts - block.bounds[block.owner(starts)]
    both = zip(tb.segments(relative, spans), tb.segments(relative + ends - starts, spans), strict=True)
    span_lists = [list(zip(a.tolist(), b.tolist(), strict=True)) for a, b in both]
    return pa.table(
        {
            "doc_id": pa.array(ids),
            "n_bytes": pa.array(np.diff(block.bounds), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "spans": pa.array([[{"a": a, "b": b} for a, b in x] for x in span_lists], _SPANS),
            "kept": pa.array([content[a:b] for a, b in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)], pa.binary()),
        }
    )


_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_KINDS = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "spans": _SPANS, "kept": pa.binary()}
_RESULT = pa.table({k: pa.array([], t) for k, t in _KINDS.items()})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans array<struct<a, b>> in bytes, kept binary) for the rows of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-dedup")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = pack(docs, scratch, buckets)

    def ranked(sent: DataFrame, rank) -> DataFrame:
        return sent.groupBy("bucket").applyInArrow(rank, _ANSWER)

    def answered(answers: DataFrame, step, schema: str) -> DataFrame:
        return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(step, schema)

    repeated = ranked(blocks.mapInArrow(_send_seeds(buckets), sent_schema("rank", "number")), _rank_seeds)
    pairs = answered(repeated, _send_pairs(buckets), sent_schema(*_PAIR))
    settled = scratch.write(ranked(pairs, _rank_pairs))
    windows = answered(settled.where("kind = 2"), _send_windows(buckets), sent_schema(*_WINDOW))
    found = settled.where("kind = 1").union(ranked(windows, _rank_windows))
    result = "doc_id long, n_bytes long, n_removed long, spans array<struct<a:long,b:long>>, kept binary"
    cleaned = answered(found, _remove, result)
    return cleaned.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = remove_repeats(read(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

