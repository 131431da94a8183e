"""Token ids in length-delimited binary files with a separate offset index.

Documents are range-partitioned by id and sorted, so partition i holds the ids before those of partition i + 1; each
partition tokenizes its texts and writes one shard:

    NNNNN-attempt.rec   records one after the other: length (u64), masked crc32 of the length (u32), payload, masked
                        crc32 of the payload (u32); a payload is doc_id (i64), a null mark (u8), the width of an id (u8) and the ids (u16 or u32)
    NNNNN-attempt.idx   (start, length) of each record (two u64), for shuffled reads

all little-endian. A crc is masked as rotate-right(crc, 15) + 0xA282EAD8, so that a checksum of data that holds
checksums is not degenerate. An attempt writes files of its own name; only the shards that the manifest names count,
so a repeated task leaves at most unused files.

Defined cases: a null or empty text has only the end id; a null id comes first; repeated rows are records of their
own, ordered by text; no documents give no shards and no rows; other columns are not written.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext
from tokenizers import Tokenizer, pre_tokenizers

from impactframe.llm import textblock as tb
from impactframe.llm.byte_bpe import gather_spans
from impactframe.llm.pretokens import code_points, pieces
from impactframe.llm.tables import Scratch, read

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
_MASK = 0xA282EAD8
_SHARD = "shard int, records string, index string, n_records long, n_tokens long"
_HEAD = "<QI"
_KEY = "<qBB"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: bytes, start: int) -> bytes:
    """The payload of the record at ``start``; a wrong checksum is an error."""
    length, crc = struct.unpack_from(_HEAD, data, start)
    if masked_crc(data[start : start + 8]) != crc:
        raise ValueError(f"broken record length at byte {start}")
    at = start + struct.calcsize(_HEAD)
    payload = data[at : at + length]
    if len(payload) != length or struct.unpack_from("<I", data, at + length)[0] != masked_crc(payload):
        raise ValueError(f"broken record at byte {start}")
    return payload


@lru_cache(maxsize=1)
def _tokenizer(content: bytes) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_buffer(content)


@lru_cache(maxsize=1)
def _plain() -> np.ndarray:
    """Code points that lower-casing and composing treat one by one, and whose white space is beyond doubt."""
    plain = np.zeros(0x110000, dtype=bool)
    plain[:0x250] = True
    plain[0x2010:0x2028] = True
    plain[[*range(0x1C, 0x20), 0x85, 0x130]] = False
    return plain


class _ByteLetters(dict):
    """For ``str.translate``: the letters that stand for a character's bytes in the vocabulary."""

    def __missing__(self, point: int) -> str:
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self[point] = "".join(x for x, _ in level.pre_tokenize_str(chr(point)))
        return self[point]


class Words:
    """The ids of the distinct words of one task, each given to the tokenizer once."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.letters = _ByteLetters()
        self.hashes = np.empty(0, np.uint64)
        self.starts = self.sizes = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def lookup(self, hashes: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows of the words (distinct hashes) in ``starts`` and ``sizes``; unknown ones are added."""
        at = np.searchsorted(self.hashes, hashes)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == hashes[known]
        new = np.flatnonzero(~known)
        if len(new):
            words = [raw[s:e].decode() for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            merged = self.tokenizer.model.tokenize
            lists = [[x.id for x in merged(w.translate(self.letters))] for w in words]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
            self.sizes = np.append(self.sizes, sizes)
            self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())))
            self.hashes = np.append(self.hashes, hashes[new])
            order = np.argsort(self.hashes)
            self.hashes, self.starts, self.sizes = self.hashes[order], self.starts[order], self.sizes[order]
            at = np.searchsorted(self.hashes, hashes)
        return at


def tokenize(block: tb.Block, words: Words) -> list[np.ndarray]:
    """The ids of each text, as the tokenizer gives them.

    Texts with special tokens, or with characters that interact with their neighbours, are given to the tokenizer whole.
    """
    at, points = code_points(block.data)
    given = block.column("text").fill_null("")
    marked = [pc.match_substring(given, x.content).to_numpy(zero_copy_only=False) for x in words.tokenizer.get_added_tokens_decoder().values()]
    strange = np.union1d(block.owner(at[~_plain()[points]]), np.flatnonzero(np.logical_or.reduce(marked)))
    lowered = pc.utf8_lower(given)
    lower = next(tb.blocks([pa.record_batch({"text": lowered})], max_bytes=1 << 62))
    starts, ends, owner = pieces(lower, spaced=False)
    h = tb.span_hash(lower.data, starts, ends, 3)
    distinct, first, number = tb.factorize(h)
    row = words.lookup(distinct, lower.data.tobytes(), starts[first], ends[first])[number]
    ids = gather_spans(words.ids, words.starts[row], words.sizes[row])
    per_text = np.bincount(owner, weights=words.sizes[row], minlength=len(block)).astype(np.int64)
    lists = tb.segments(ids, per_text)
    if len(strange):
        texts = block.column("text").take(pa.array(strange)).to_pylist()
        for i, x in zip(strange.tolist(), words.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            lists[i] = np.array(x.ids, dtype=np.uint32)
    return lists


def _write_shard(folder: str, vocabulary: Broadcast, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(_tokenizer(vocabulary.value))
        task = TaskContext.get()
        name = f"{folder}/{task.partitionId():05d}-{task.taskAttemptId()}"
        store, path = fs.FileSystem.from_uri(name)
        kind = np.dtype("<u2" if words.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        end = np.array([end_id], dtype=np.uint32)
        records = index = None
        at = n = tokens = 0
        for block in tb.blocks(batches):
            if records is None:
                store.create_dir(path.rpartition("/")[0], recursive=True)
                records, index = store.open_output_stream(f"{path}.rec"), store.open_output_stream(f"{path}.idx")
            entries = []
            for doc_id, ids in zip(block.column("doc_id").to_pylist(), tokenize(block, words), strict=True):
                ids = np.concatenate([ids, end]).astype(kind)
                record = frame(struct.pack(_KEY, doc_id or 0, doc_id is None, kind.itemsize) + ids.tobytes())
                records.write(record)
                entries += [at, len(record)]
                at += len(record)
                tokens += len(ids)
            index.write(np.array(entries, dtype="<u8").tobytes())
            n += len(block)
        if records is not None:
            records.close()
            index.close()
            row = [[task.partitionId()], [f"{name}.rec"], [f"{name}.idx"], [n], [tokens]]
            kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(row, kinds, strict=True)],
                names=["shard", "records", "index", "n_records", "n_tokens"],
            )

    return run


def write_records(docs: DataFrame, folder: str, vocabulary_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the shards; the manifest is (shard, records, index, n_records, n_tokens), one row per shard."""
    spark = docs.sparkSession
    with open(vocabulary_path or public_tokenizers.path(VOCABULARY), "rb") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())
    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return Scratch(spark, "token-records").write(rows.mapInArrow(_write_shard(folder, vocabulary, end_id), _SHARD))


def _read_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            store, path = fs.FileSystem.from_uri(row["index"])
            index = np.frombuffer(store.open_input_stream(path).read(), dtype="<u8").reshape(-1, 2)
            store, path = fs.FileSystem.from_uri(row["records"])
            start, at = row["start"], 0
            with store.open_input_file(path) as file:
                while at < len(index):
                    # About 8 MB of records at once.
                    end = max(at + 1, int(np.searchsorted(index[:, 0], index[at, 0] + np.uint64(8 << 20))))
                    low = int(index[at, 0])
                    data = file.read_at(int(index[end - 1].sum()) - low, low)
                    out: dict[str, list] = {"doc_id": [], "start": [], "ids": []}
                    for offset in (index[at:end, 0].astype(np.int64) - low).tolist():
                        payload = unframe(data, offset)
                        doc_id, null, width = struct.unpack_from(_KEY, payload)
                        ids = np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(_KEY)).astype("<u4").tobytes()
                        out["doc_id"].append(None if null else doc_id)
                        out["start"].append(start)
                        out["ids"].append(ids)
                        start += len(ids) // 4
                    kinds = [pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), kinds, strict=True)], names=list(out))
                    at = end


def read_records(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids as little-endian u32) of all records; ``start`` counts the ids of all records before."""
    # One row per shard: the running sum is over as many rows as there are files.
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = manifest.withColumn("start", F.coalesce(before, F.lit(0)))
    # A stated number of partitions: adaptive execution would merge the few small rows into one task that reads all.
    return shards.repartition(max(1, manifest.count()), "shard").mapInArrow(_read_shard, "doc_id long, start long, ids binary")


def op6_token_records(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark, "records")
    manifest = write_records(read(spark, folder, "documents"), f"{scratch.folder}/{uuid.uuid4().hex}")
    records = read_records(manifest)
    return records.select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
