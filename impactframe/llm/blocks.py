"""Texts packed into blocks, and questions that blocks ask about keys of the whole corpus.

``pack`` writes the texts once as rows of about ``BLOCK_BYTES`` in a table bucketed by block, so that joining
something to a block moves no text. ``send`` deals a block's keys out by hash; what a bucket decides about them goes
back to the blocks as packed answers. A frequent key is one entry per block, wherever its occurrences are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.taskcontext import TaskContext

from impactframe.llm import textblock as tb
from impactframe.llm.tables import Scratch

BLOCK_BYTES = 2 << 20

_BLOCK = "block long, doc_ids array<long>, sizes binary, texts binary"


def pack_array(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values))


def unpack_array(payload: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), dtype=dtype)


def _packed(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for n, block in enumerate(tb.blocks(batches, max_bytes=block_bytes)):
            row = [[task << 32 | n], [block.column("doc_id").to_pylist()], [pack_array(np.diff(block.bounds))], [pack_array(block.data)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=["block", "doc_ids", "sizes", "texts"])

    return run


def pack(docs: DataFrame, scratch: Scratch, buckets: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The table of blocks of ``docs`` (doc_id, text), one row each."""
    return scratch.bucketed(docs.select("doc_id", "text").mapInArrow(_packed(block_bytes), _BLOCK), buckets, "block")


def unpack(row: dict) -> tuple[tb.Block, list[int | None]]:
    """The texts and ids of one row."""
    bounds = np.concatenate([[0], np.cumsum(unpack_array(row["sizes"], np.int64))])
    return tb.Block(None, unpack_array(row["texts"], np.uint8), bounds), row["doc_ids"]


def deal(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries in the order of their buckets, and where each bucket begins in it."""
    bucket = (tb.mix(keys) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def send(block: int, keys: np.ndarray, buckets: int, columns: dict[str, np.ndarray], kind: int = 0) -> pa.Table:
    """One row per bucket of the keys with the columns of its entries."""
    order, edges = deal(keys, buckets)
    filled = np.flatnonzero(np.diff(edges))
    out = {
        "block": pa.array(np.full(len(filled), block), pa.int64()),
        "bucket": pa.array(filled.astype(np.int32)),
        "kind": pa.array(np.full(len(filled), kind, dtype=np.int32)),
    }
    for name, values in columns.items():
        out[name] = pa.array([pack_array(values[order[edges[b] : edges[b + 1]]]) for b in filled.tolist()], pa.binary())
    return pa.table(out)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending numbers as their steps, bytes of the same weight together: dense keys take fewer than eight bytes."""
    steps = np.diff(keys, prepend=keys.dtype.type(0))
    return pack_array(steps.view(np.uint8).reshape(-1, 8).T)


def unpack_sorted(payload: bytes) -> np.ndarray:
    steps = unpack_array(payload, np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view(np.uint64).ravel(), dtype=np.uint64)


def send_sorted(block: int, keys: np.ndarray, buckets: int, columns: dict[str, np.ndarray], kind: int = 0) -> pa.Table:
    """Like ``send`` for distinct ascending keys, which are dealt by ranges: what comes back bucket by bucket is in
    the order of the keys. The keys go as a column of that name; entries are along the last axis of ``columns``."""
    limits = [(2**64 * b) // buckets for b in range(buckets)]
    edges = np.append(np.searchsorted(keys, np.array(limits, dtype=np.uint64)), len(keys))
    filled = np.flatnonzero(np.diff(edges)).tolist()
    out = {
        "block": pa.array([block] * len(filled), pa.int64()),
        "bucket": pa.array(filled, pa.int32()),
        "kind": pa.array([kind] * len(filled), pa.int32()),
        "keys": pa.array([pack_sorted(keys[edges[b] : edges[b + 1]]) for b in filled], pa.binary()),
    }
    for name, values in columns.items():
        out[name] = pa.array([pack_array(values[..., edges[b] : edges[b + 1]]) for b in filled], pa.binary())
    return pa.table(out)


def sent_schema(*columns: str) -> str:
    return "block long, bucket int, kind int, " + ", ".join(f"{k} binary" for k in columns)


def nothing_sent(*columns: str) -> pa.Table:
    kinds = {"block": pa.int64(), "bucket": pa.int32(), "kind": pa.int32()} | {k: pa.binary() for k in columns}
    return pa.table({k: pa.array([], t) for k, t in kinds.items()})


def gather(table: pa.Table, **kinds) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The entries of one bucket: the row that sent each, and the columns."""
    columns = {k: [unpack_array(x, t) for x in table[k].to_pylist()] for k, t in kinds.items()}
    sizes = [len(x) for x in next(iter(columns.values()))]
    return np.repeat(np.arange(len(sizes)), sizes), {k: np.concatenate(x) for k, x in columns.items()}
