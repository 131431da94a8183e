"""Texts of one Arrow batch as one byte array: words, lines and hashes of spans without a Python loop per word.

Used inside ``mapInArrow`` tasks. A block holds whole texts of at most ``max_bytes`` together (a longer
text is a block of its own), so a task's memory follows the longest text, not the size of its partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

BLOCK_BYTES = 1 << 20
U64 = np.uint64
#: Ratio of the rolling hash; odd, so that it has an inverse modulo 2**64.
_RATIO = 0x9E3779B97F4A7C15 | 1


def _generator(seed: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(seed))


@lru_cache(maxsize=8)
def _byte_values(seed: int) -> np.ndarray:
    return _generator(seed).integers(0, 2**64, 256, dtype=U64)


@lru_cache(maxsize=4)
def _powers(ratio: int, size: int) -> np.ndarray:
    powers = np.full(size, ratio, dtype=U64)
    powers[0] = 1
    return np.cumprod(powers, dtype=U64)


def _room(n: int) -> int:
    return max(1 << 16, 1 << (int(n) - 1).bit_length())


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the output."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def rolling_sums(data: np.ndarray, seed: int) -> np.ndarray:
    """Running sums from which ``rolling_hash`` gets the hash of any span."""
    sums = np.empty(len(data) + 1, dtype=U64)
    sums[0] = 0
    values = _byte_values(seed)[data]
    values *= _powers(_RATIO, _room(len(data)))[: len(data)]
    np.cumsum(values, out=sums[1:])
    return sums


def rolling_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans that start at every byte, a polynomial modulo 2**64: equal bytes have equal hashes, but
    some patterned texts of a thousand bytes and more share theirs, so it serves to choose and to deal, not to decide."""
    inverse = _powers(pow(_RATIO, -1, 2**64), _room(len(sums)))
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(U64) * U64(0xA0761D6478BD642F))


#: Longer spans are hashed one by one.
_LONG = 1024
#: By the number of bytes that count, the mask of eight.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of the spans; equal bytes have equal hashes, wherever they stand.

    Eight bytes of every span are mixed in at a time, so that each step is a bijection of what came before: no
    pattern of bytes cancels, as it can in a polynomial modulo 2**64.
    """
    sizes = np.asarray(ends - starts, dtype=np.int64)
    h = mix(sizes.astype(U64) + U64(0x9E3779B97F4A7C15 * (seed + 1) % 2**64))
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded.data, strides=(1,))
    live, at = np.flatnonzero((sizes > 0) & (sizes <= _LONG)), 0
    while len(live):
        chunk = eights[starts[live] + at] & _MASKS[np.minimum(sizes[live] - at, 8)]
        h[live] = mix(h[live] ^ chunk) + U64(0xA0761D6478BD642F)
        at += 8
        live = live[sizes[live] > at]
    for i in np.flatnonzero(sizes > _LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(padded[starts[i] : ends[i]].data, seed)
    return mix(h)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of `[\x20\x09-\x0D]`.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
WORD = ~SPACE


class Block:
    """Whole texts side by side: ``data`` are their bytes, text i is data[bounds[i]:bounds[i + 1]]."""

    def __init__(self, batch: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray):
        self.batch, self.data, self.bounds = batch, data, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def column(self, name: str) -> pa.Array:
        return self.batch.column(name)

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of true values that cross no text's border."""
        n = len(self.data)
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[self.bounds[:-1][self.bounds[:-1] < n]] = False
        after[self.bounds[1:][self.bounds[1:] > 0] - 1] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """The text that holds each (sorted) byte position."""
        return np.searchsorted(self.bounds, positions, side="right") - 1

    def counts(self, owners: np.ndarray) -> np.ndarray:
        return np.bincount(owners, minlength=len(self))


def blocks(
    batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = BLOCK_BYTES, max_rows: int | None = None
) -> Iterator[Block]:
    """Cut batches into blocks, of ``max_rows`` texts at most if given; a null text has no bytes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        texts = batch.column(column)
        texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
        _, offsets, content = texts.buffers()
        bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        content = np.frombuffer(content, dtype=np.uint8) if content is not None and content.size else np.empty(0, np.uint8)
        at = 0
        while at < len(texts):
            end = int(np.searchsorted(bounds, bounds[at] + max_bytes, side="right")) - 1
            end = min(max(end, at + 1), at + (max_rows or len(texts)), len(texts))
            low, high = int(bounds[at]), int(bounds[end])
            yield Block(batch.slice(at, end - at), content[low:high], bounds[at : end + 1] - low)
            at = end


def factorize(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes by first appearance, where each appears first, and the number of every hash."""
    number, distinct = pd.factorize(h)
    first = np.empty(len(distinct), dtype=np.int64)
    first[number[::-1]] = np.arange(len(h) - 1, -1, -1)
    return distinct, first, number


def segments(values: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Cut an array into one piece per text."""
    return np.split(values, np.cumsum(counts)[:-1]) if len(counts) else []


def binary_lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value per text: the bytes of its numbers."""
    size = values.dtype.itemsize
    offsets = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(np.asarray(counts) * size, out=offsets[1:])
    parts = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]
    return pa.Array.from_buffers(pa.large_binary(), len(counts), parts).cast(pa.binary())


def cut(block: Block, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts reduced to the bytes of the (disjoint) spans."""
    edge = np.zeros(len(block.data) + 1, dtype=np.int8)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    kept = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    before = np.concatenate([[0], np.cumsum(kept)])
    offsets = before[block.bounds].astype(np.int64)
    parts = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(block.data[kept]))]
    return pa.Array.from_buffers(pa.large_string(), len(block), parts).cast(pa.string())
