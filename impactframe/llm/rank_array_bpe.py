"""Byte-pair encoding with word ends by contiguous rank arrays, and decoding.

The words of a block of texts are told apart by their bytes, and each distinct one is merged once a task. Short words
of about one length are merged together: one row of arrays per word holds its part boundaries (as the id of each part)
and the rank of every two neighbouring parts. Again and again every row is scanned for its smallest rank, the first
of equal ones; the boundary between these two parts is deleted, what stands to its right moves up, and the ranks on
both sides of the new part are looked up again. Words of more than ``SHORT`` bytes keep the ranks in a heap instead,
so that a text without a space costs n log n.

Lower-casing and composing of characters beyond the common ones, and the places of words among them, are taken from
the tokenizer file's own rules with the public library; merging and decoding are done here.

Defined cases: a null or empty text, or one of white space, has no ids and decodes to an empty text; a null id stays
null; repeated rows are encoded each. Strings of special tokens in a text become their ids, as the library does it.
A text is encoded whole, however long; a task holds one text, or about a megabyte of short ones, at once, and the ids
of the distinct words it has met, which are dropped after ``MOST_WORDS`` of them. Other columns are kept; one named
``ids``, ``n_tokens`` or ``decoded`` is replaced by the result.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import cached_property, lru_cache
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from impactframe.llm import textblock as tb
from impactframe.llm.byte_bpe import gather_spans
from impactframe.llm.pretokens import code_points, pieces
from impactframe.llm.tables import read

VOCABULARY = "word_bpe_49k.json"
#: Longest word (in bytes) that is merged in arrays.
SHORT = 64
#: Distinct words whose ids a task remembers.
MOST_WORDS = 500_000
_NEVER = np.int32(2**31 - 1)


def _common() -> np.ndarray:
    """Code points that are composed and lower-cased one by one, and are white space or not beyond doubt."""
    common = np.zeros(0x110000, dtype=bool)
    common[:0x250] = True
    common[0x2010:0x2028] = True
    common[[*range(0x1C, 0x20), 0x85, 0x130]] = False
    return common


class Vocabulary:
    """The tokenizer file as arrays: the ids of single bytes, of pairs with their ranks, and the text of every id."""

    def __init__(self, content: bytes):
        told = json.loads(content)
        model = told["model"]
        ids, ending = model["vocab"], model["end_of_word_suffix"]
        letters = self.letters()
        self.first = np.array([ids[letters[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([ids[letters[b] + ending] for b in range(256)], dtype=np.int64)
        self.content = content
        self.bytes_of = {letter: b for b, letter in enumerate(letters)}
        special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.special = special
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")
        self.n = max([*ids.values(), *special.values()]) + 1
        keys = np.array([ids[a] * self.n + ids[b] for a, b in model["merges"]], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in model["merges"]], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.made, self.ranks = keys[order], made[order], order.astype(np.int32)
        texts = [b""] * self.n
        for text, i in [*ids.items(), *special.items()]:
            texts[i] = text.encode() + b" "
        self.texts = _Strings(texts)
        self.numbers = _Strings([f"{i} ".encode() for i in range(self.n)])
        self.common = _common()

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """For the rules on uncommon characters only."""
        return Tokenizer.from_buffer(self.content)

    @staticmethod
    def letters() -> list[str]:
        """The letter that stands for each byte in the vocabulary: itself if it shows, else one from 256 on."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = iter(range(256, 512))
        return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs of ids (``_NEVER`` where they do not merge) and the ids they merge to."""
        key = left * self.n + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], _NEVER), self.made[at]


class _Strings:
    """Byte strings by number, side by side."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def join(self, numbers: np.ndarray) -> bytes:
        """The strings of the numbers, one after the other, without the last byte."""
        return gather_spans(self.data, self.starts[numbers], self.sizes[numbers]).tobytes()[:-1]


@lru_cache(maxsize=1)
def vocabulary_of(content: bytes) -> Vocabulary:
    return Vocabulary(content)


def merge_short(words: list[bytes], v: Vocabulary) -> list[np.ndarray]:
    """The ids of words of at most ``SHORT`` bytes, one row of arrays for each."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    width = int(sizes.max())
    data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width)
    ids = v.first[data]
    rows = np.arange(len(words))
    ids[rows, sizes - 1] = v.last[data[rows, sizes - 1]]
    count = sizes.copy()
    place = np.arange(width)
    # ranks[w, i]: of parts i and i + 1; nothing merges with what lies beyond the last part.
    ranks = np.full((len(words), width), _NEVER, dtype=np.int32)
    if width > 1:
        ranks[:, :-1], _ = v.pair(ids[:, :-1], ids[:, 1:])
        ranks[place >= sizes[:, None] - 1] = _NEVER
    live = np.arange(len(words))
    while True:
        at = ranks[live].argmin(axis=1)
        going = ranks[live, at] < _NEVER
        live, at = live[going], at[going]
        if not len(live):
            break
        _, made = v.pair(ids[live, at], ids[live, at + 1])
        # Delete the boundary after part ``at``: what follows it moves up by one.
        source = np.minimum(place + (place > at[:, None]), width - 1)
        ids[live] = np.take_along_axis(ids[live], source, axis=1)
        moved = np.take_along_axis(ranks[live], source, axis=1)
        moved[:, -1] = _NEVER
        ids[live, at] = made
        count[live] -= 1
        line = np.arange(len(live))
        has_left = at > 0
        left, _ = v.pair(ids[live, np.maximum(at - 1, 0)], made)
        moved[line[has_left], at[has_left] - 1] = left[has_left]
        has_right = at + 1 < count[live]
        right, _ = v.pair(made, ids[live, np.minimum(at + 1, width - 1)])
        moved[line, at] = np.where(has_right, right, _NEVER)
        ranks[live] = moved
    return [row[:n] for row, n in zip(ids, count.tolist(), strict=True)]


def merge_long(word: bytes, v: Vocabulary) -> np.ndarray:
    """The ids of one word; the ranks of neighbours wait in a heap."""
    ids = v.first[np.frombuffer(word, dtype=np.uint8)]
    ids[-1] = v.last[word[-1]]
    ranks, made = v.pair(ids[:-1], ids[1:])
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def pair(left: int, right: int) -> tuple[int, int]:
        if (left, right) not in known:
            rank, new = v.pair(np.array([left]), np.array([right]))
            known[left, right] = int(rank[0]), int(new[0])
        return known[left, right]

    never = int(_NEVER)
    parts, size = ids.tolist(), len(ids)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    # An entry counts only while both its parts are still the ones it was made for.
    heap = [(r, i, parts[i], parts[i + 1], m) for i, (r, m) in enumerate(zip(ranks.tolist(), made.tolist(), strict=True)) if r < never]
    heapq.heapify(heap)
    while heap:
        _, i, left, right, new = heapq.heappop(heap)
        j = after[i]
        if parts[i] != left or j >= size or parts[j] != right:
            continue
        parts[i], parts[j], after[i] = new, -1, after[j]
        if after[j] < size:
            before[after[j]] = i
            rank, made_of = pair(new, parts[after[j]])
            if rank < never:
                heapq.heappush(heap, (rank, i, new, parts[after[j]], made_of))
        h = before[i]
        if h >= 0:
            rank, made_of = pair(parts[h], new)
            if rank < never:
                heapq.heappush(heap, (rank, h, parts[h], new, made_of))
    return np.array([p for p in parts if p >= 0], dtype=np.int64)


class Words:
    """The ids of the distinct words of a task."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.forget()

    def forget(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.ids = np.empty(0, np.int64)
        self.starts = self.sizes = np.empty(0, np.int64)

    def rows_of(self, words: list[bytes]) -> np.ndarray:
        """The places of distinct words in ``starts`` and ``sizes``; unknown ones are merged first."""
        if len(self.rows) + len(words) > MOST_WORDS:
            self.forget()
        new = sorted((w for w in words if w not in self.rows), key=len)
        lists, at = [], 0
        for width in (4, 8, 12, 16, 24, 32, SHORT):
            end = at
            while end < len(new) and len(new[end]) <= width:
                end += 1
            lists += merge_short(new[at:end], self.v) if end > at else []
            at = end
        lists += [merge_long(w, self.v) for w in new[at:]]
        if new:
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
            self.sizes = np.append(self.sizes, sizes)
            self.ids = np.concatenate([self.ids, *lists])
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))


def _uncommon_ids(text: str, words: Words) -> np.ndarray:
    """The ids of a text that holds special tokens, or characters that act upon their neighbours."""
    v, lists = words.v, [np.empty(0, np.int64)]
    for part in v.split.split(text):
        if part in v.special:
            lists.append(np.array([v.special[part]]))
        elif part:
            cut = v.tokenizer.pre_tokenizer.pre_tokenize_str(v.tokenizer.normalizer.normalize_str(part))
            spelt = [bytes(map(v.bytes_of.__getitem__, word)) for word, _ in cut]
            row = dict(zip(distinct := list(dict.fromkeys(spelt)), words.rows_of(distinct).tolist(), strict=True))
            chosen = np.fromiter(map(row.__getitem__, spelt), np.int64, len(spelt))
            lists.append(gather_spans(words.ids, words.starts[chosen], words.sizes[chosen]))
    return np.concatenate(lists)


def encode_block(block: tb.Block, words: Words) -> list[np.ndarray]:
    """The ids of each text of a block."""
    v = words.v
    at, points = code_points(block.data)
    apart = np.zeros(len(block), dtype=bool)
    apart[block.owner(at[~v.common[points]])] = True
    texts = block.column("text").fill_null("")
    for mark in v.special:
        apart |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    lower = next(tb.blocks([pa.record_batch({"text": pc.utf8_lower(texts)})], max_bytes=1 << 62))
    starts, ends, owner = pieces(lower, spaced=False)
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    spelt = gather_spans(lower.data, starts, sizes)
    every = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(spelt)])
    told = every.dictionary_encode()
    row = words.rows_of(told.dictionary.to_pylist())[told.indices.to_numpy()]
    ids = gather_spans(words.ids, words.starts[row], words.sizes[row])
    per_text = np.bincount(owner, weights=words.sizes[row], minlength=len(block)).astype(np.int64)
    lists = tb.segments(ids, per_text)
    for i in np.flatnonzero(apart).tolist():
        lists[i] = _uncommon_ids(texts[i].as_py(), words)
    return lists


def _broadcast(spark: SparkSession, path: str | None) -> Broadcast:
    """The tokenizer file, about two megabytes."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def _schema(df: DataFrame, added: str) -> str:
    names = [x.split()[0] for x in added.split(", ")]
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in names] + [added])


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    kept = [k for k in batch.schema.names if k not in columns]
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *columns.values()], names=[*kept, *columns])


def encode(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """Add ``ids`` (little-endian u32) and ``n_tokens`` of ``text``."""
    vocabulary = _broadcast(docs.sparkSession, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(vocabulary_of(vocabulary.value))
        for block in tb.blocks(batches):
            lists = encode_block(block, words)
            packed = [x.astype("<u4").tobytes() for x in lists]
            yield _with(block.batch, ids=pa.array(packed, pa.binary()), n_tokens=pa.array(list(map(len, lists)), pa.int64()))

    return docs.mapInArrow(run, _schema(docs, "ids binary, n_tokens long"))


def decode(encoded: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """Add ``decoded``, the tokens of ``ids`` with a space between them; null ids count as none."""
    vocabulary = _broadcast(encoded.sparkSession, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary_of(vocabulary.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [v.texts.join(np.frombuffer(x or b"", "<u4")).decode() for x in part.column("ids").to_pylist()]
                yield _with(part, decoded=pa.array(texts, pa.string()))

    return encoded.mapInArrow(run, _schema(encoded, "decoded string"))


def digests(decoded: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded and decoded rows."""
    vocabulary = _broadcast(decoded.sparkSession, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary_of(vocabulary.value)
        for batch in batches:
            ids = [sha256(v.numbers.join(np.frombuffer(x, "<u4"))).hexdigest() for x in batch.column("ids").to_pylist()]
            texts = [sha256(x.encode()).hexdigest() for x in batch.column("decoded").to_pylist()]
            columns = [batch.column("doc_id"), batch.column("n_tokens"), pa.array(ids, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow = decoded.select("doc_id", "n_tokens", "ids", "decoded")
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_rank_array_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return digests(decode(encode(docs).drop("text")))
