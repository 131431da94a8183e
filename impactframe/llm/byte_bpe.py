"""Byte-level BPE: each distinct pre-token of the corpus is encoded once.

A task cuts its texts into chunks. For a chunk it explodes the pre-tokens with their positions and keeps the
distinct ones, packed by hash bucket, and for each text the positions as numbers of the chunk's words. The buckets
are shuffled together, where each distinct word is encoded once; the ids go back to the chunks that asked, and a
chunk puts its texts together again by position. A frequent word is one entry in each chunk, never one row per
occurrence. Decoding joins the ids with the token-byte table, which has one row per vocabulary entry.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows give one row each; ids are
carried as they are, null included; no documents give no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactframe.llm import textblock as tb
from impactframe.llm.pretokens import pieces
from impactframe.llm.tables import Scratch, read

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of text after which a chunk is closed.
CHUNK_BYTES = 8 << 20
#: Tokens that are decoded, and words that are put together, at once, about.
DECODE_TOKENS = 1 << 18

_WORDS = "chunk binary, bucket int, words binary, sizes binary"
_TEXTS = "chunk binary, doc_ids array<long>, sizes binary, numbers binary, places binary"


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values))


def _unpack(payload: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), dtype=dtype)


def _pack_numbers(numbers: np.ndarray) -> bytes:
    """Numbers as four planes of bytes: the upper ones are mostly zero if small numbers are frequent."""
    planes = np.ascontiguousarray(numbers, dtype="<i4").view(np.uint8).reshape(-1, 4).T
    return _pack(planes)


def _unpack_numbers(payload: bytes) -> np.ndarray:
    return np.ascontiguousarray(_unpack(payload, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def gather_spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The spans one after the other."""
    total = int(sizes.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(sizes) else np.empty(0, np.int64)
    return data[shift + np.arange(total)]


class _Chunk:
    """The distinct words and the position lists of one chunk."""

    def __init__(self, buckets: int):
        self.buckets, self.size, self.digest = buckets, 0, hashlib.blake2b(digest_size=16)
        self.hashes, self.sizes, self.data = [], [], []
        self.lists, self.counts, self.ids = [], [], []

    def add(self, block: tb.Block) -> None:
        self.digest.update(block.data)
        self.digest.update(repr((block.column("doc_id").to_pylist(), block.bounds.tolist())).encode())
        starts, ends, owner = pieces(block, spaced=True)
        h = tb.span_hash(block.data, starts, ends, 3)
        unique, at, number = tb.factorize(h)
        sizes = ends[at] - starts[at]
        self.lists.append((sum(map(len, self.hashes)), number.astype(np.int32)))
        self.hashes.append(unique)
        self.sizes.append(sizes)
        self.data.append(gather_spans(block.data, starts[at], sizes))
        self.counts.append(block.counts(owner))
        self.ids.append(block.column("doc_id"))
        self.size += len(block.data)

    def _words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the distinct words: place of the first in the lists, bucket order, and bucket edges in that order."""
        distinct, at, number = tb.factorize(np.concatenate(self.hashes))
        bucket = (distinct >> np.uint64(33)).astype(np.int64) % self.buckets
        order = np.lexsort((distinct, bucket))
        return distinct, at, number, order, np.searchsorted(bucket[order], np.arange(self.buckets + 1))

    def word_rows(self) -> Iterator[pa.RecordBatch]:
        _, at, _, order, edges = self._words()
        sizes, data = np.concatenate(self.sizes), np.concatenate(self.data)
        starts = np.cumsum(sizes) - sizes
        name = self.digest.digest()
        for b in np.flatnonzero(np.diff(edges)).tolist():
            own = at[order[edges[b] : edges[b + 1]]]
            words = gather_spans(data, starts[own], sizes[own])
            row = [[name], [b], [_pack(words)], [_pack(sizes[own].astype(np.int32))]]
            kinds = [pa.binary(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=["chunk", "bucket", "words", "sizes"])

    def text_rows(self) -> Iterator[pa.RecordBatch]:
        distinct, _, number, order, _ = self._words()
        numbers = np.concatenate([number[low + x] for low, x in self.lists])
        # Words by frequency, so that the position lists have small numbers; ``place`` leads from there to the buckets.
        by_count = np.argsort(-np.bincount(numbers, minlength=len(distinct)), kind="stable")
        rank, place = np.empty_like(by_count), np.empty_like(by_count)
        rank[by_count] = np.arange(len(by_count))
        place[order] = np.arange(len(order))
        sizes = _pack(np.concatenate(self.counts).astype(np.int64))
        ids = pa.chunked_array(self.ids).to_pylist()
        row = [[self.digest.digest()], [ids], [sizes], [_pack_numbers(rank[numbers])], [_pack_numbers(place[by_count])]]
        kinds = [pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=["chunk", "doc_ids", "sizes", "numbers", "places"])


def _chunks(buckets: int, chunk_bytes: int, rows: str):
    """``rows`` names what a chunk gives: word_rows or text_rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = None
        for block in tb.blocks(batches):
            chunk = chunk or _Chunk(buckets)
            chunk.add(block)
            if chunk.size >= chunk_bytes:
                yield from getattr(chunk, rows)()
                chunk = None
        if chunk:
            yield from getattr(chunk, rows)()

    return run


@lru_cache(maxsize=2)
def _encoder(content: bytes) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(content), special_tokens={})


def ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}


@lru_cache(maxsize=2)
def token_bytes(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes, start and size by id."""
    table = ranks(content)
    by_id = [b""] * (max(table.values()) + 1)
    for piece, i in table.items():
        by_id[i] = piece
    sizes = np.array([len(x) for x in by_id], dtype=np.int64)
    return np.frombuffer(b"".join(by_id), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes


def _encode_bucket(vocabulary: Broadcast):
    def run(table: pa.Table) -> pa.Table:
        encode = _encoder(vocabulary.value)._core_bpe.encode_single_piece
        known: dict[bytes, list[int]] = {}
        payloads, counts = [], []
        for packed, sizes in zip(table["words"].to_pylist(), table["sizes"].to_pylist(), strict=True):
            words = memoryview(zstandard.ZstdDecompressor().decompress(packed))
            at, flat, each = 0, [], []
            for size in _unpack(sizes, np.int32).tolist():
                word = bytes(words[at : at + size])
                at += size
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = encode(word)
                flat += ids
                each.append(len(ids))
            payloads.append(_pack(np.array(flat, dtype=np.int32)))
            counts.append(_pack(np.array(each, dtype=np.int32)))
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "ids": payloads, "counts": counts})

    return run


def _reassemble(texts: pa.Table, words: pa.Table) -> pa.Table:
    """The ids of a chunk's texts; a chunk that stands in the input several times has all its rows several times."""
    rows = {r["bucket"]: r for r in words.to_pylist()}
    rows = [rows[b] for b in sorted(rows)]
    ids = np.concatenate([np.empty(0, np.int32), *(_unpack(r["ids"], np.int32) for r in rows)])
    counts = np.concatenate([np.empty(0, np.int64), *(_unpack(r["counts"], np.int32) for r in rows)])
    starts = np.cumsum(counts) - counts
    out, done = [], 0
    for text in texts.to_pylist():
        places = _unpack_numbers(text["places"])
        if len(places) != len(counts):
            break
        numbers, doc_ids = _unpack_numbers(text["numbers"]), text["doc_ids"]
        edges = np.cumsum(np.append(0, _unpack(text["sizes"], np.int64)))
        at = 0
        # Some texts at a time: beside the ids themselves a position takes fifty bytes until it has its ids.
        while at < len(doc_ids):
            end = max(at + 1, int(np.searchsorted(edges, edges[at] + DECODE_TOKENS, side="right")) - 1)
            own = places[numbers[edges[at] : edges[end]]]
            tokens = gather_spans(ids, starts[own], counts[own])
            ends = np.cumsum(np.append(0, counts[own]))[edges[at : end + 1] - edges[at]]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens, pa.int32()))
            out.append(pa.table({"doc_id": pa.array(doc_ids[at:end], pa.int64()), "ids": lists}))
            at = end
        done += 1
    if not done or done < texts.num_rows:
        raise RuntimeError("the documents changed between two reads; encode them with reread=False")
    return pa.concat_tables(out)


def encode(docs: DataFrame, vocabulary_path: str | None = None, chunk_bytes: int = CHUNK_BYTES, reread: bool = True) -> DataFrame:
    """(doc_id, ids array<int>) for the rows of ``docs`` (doc_id, text).

    The rows are read twice and have to come in the same partitions and order, as from files; that they do is
    checked by a digest of each chunk. With ``reread=False`` they are written once before.
    """
    spark = docs.sparkSession
    vocabulary = _shared(spark, vocabulary_path)
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select("doc_id", "text")
    if not reread:
        docs = Scratch(spark, "byte-bpe").write(docs)
    words = docs.mapInArrow(_chunks(buckets, chunk_bytes, "word_rows"), _WORDS)
    texts = docs.mapInArrow(_chunks(buckets, chunk_bytes, "text_rows"), _TEXTS)
    encoded = words.groupBy("bucket").applyInArrow(_encode_bucket(vocabulary), "chunk binary, bucket int, ids binary, counts binary")
    return texts.groupBy("chunk").cogroup(encoded.groupBy("chunk")).applyInArrow(_reassemble, "doc_id long, ids array<int>")


def _shared(spark: SparkSession, path: str | None) -> Broadcast:
    """The vocabulary file, for all tasks: its size is that of the vocabulary, whatever the corpus."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def decode(encoded: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """All columns of ``encoded`` (ids array<int>, ...) and the decoded bytes."""
    vocabulary = _shared(encoded.sparkSession, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, starts, sizes = token_bytes(vocabulary.value)
        for batch in batches:
            ends = np.cumsum(batch.column("ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                done = ends[at - 1] if at else 0
                size = max(1, int(np.searchsorted(ends, done + DECODE_TOKENS)) - at)
                part = batch.slice(at, size)
                at += size
                lists = part.column("ids")
                ids = lists.flatten().to_numpy()
                counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = gather_spans(data, starts[ids], sizes[ids])
                edges = np.concatenate([[0], np.cumsum(sizes[ids])])[np.concatenate([[0], np.cumsum(counts)])]
                yield part.append_column("decoded", tb.binary_lists(flat, np.diff(edges)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{schema}, decoded binary")


def digests(decoded: DataFrame, *columns: str) -> DataFrame:
    """doc_id, n_tokens, hashes of the ids and of the decoded bytes, and the given columns."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *columns,
    )


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return digests(decode(encode(read(spark, folder, "documents"))))
