"""Katz backoff language model over words, with Good-Turing discounts and exactly normalised backoff weights.

P(w) of a known word is its discounted count over all training tokens; what the discounts leave is the probability
of an unknown word (all unknown words are one class). P(w | v) of a seen pair is its discounted count over the count
of v; an unseen one backs off to weight(v) P(w), where weight(v) makes the probabilities after v sum to one. A
context whose pairs are all beyond the discounted counts keeps 1 / (count + 1) for what is unseen. With order three,
P(w | u v) is the same one level up: discounted counts of triples over the count of the pair (u, v), and weight(u v)
P(w | v) for what is unseen, down to the words if need be. The first token of a text has one start before it and so
is scored as a pair.

Counts are never all in one place. Texts stand in a table bucketed by block; a block sends its distinct words and
pairs with their training counts to buckets of key ranges and gets back the totals (stored as one packed answer per
block, bucket and order), whether anybody else has the key, and who stands for it. A triple with a pair that no other
block has is counted where it is; only the other triples are sent in a second exchange. The weights need two sums
over what is seen after a context. Both follow from how many successors have a count of 1, 2, ... and what the counts
beyond the discounted ones add up to, so blocks exchange these whole numbers, for contexts that several blocks have,
and get a context's sums back only if they have an unseen successor of it. Then every block evaluates its tokens. A
frequent word, pair or triple is one entry per block.

Defined cases: a null or empty text is the end token alone; without training texts every word is unknown with
probability one; repeated rows count as often as they stand there; a null id counts like an empty one for the split;
no documents give no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactframe.llm import textblock as tb
from impactframe.llm.blocks import nothing_sent, pack, pack_array, send_sorted, sent_schema, unpack, unpack_array, unpack_sorted
from impactframe.llm.tables import Scratch, fold, read

#: Counts above this one are not discounted.
DISCOUNTED = 5
#: Sums are by context, of pairs after a word and of triples after a pair.
WORDS, PAIRS, TRIPLES, SUMS, PAIR_SUMS, LOCAL, TOTALS = 1, 2, 3, 4, 5, 6, 7
#: Larger blocks repeat fewer keys; a task holds the arrays of one block.
BLOCK_BYTES = 4 << 20
#: Stand for the end of a text and, as a context only, for its start.
END, START = np.uint64(0x8F2D1A6B3C4E5F71), np.uint64(0x1B5E9D3A7C8F2E46)

_ANSWER = "block long, bucket int, kind int, a binary, b binary"


@dataclass
class Tokens:
    """The tokens of one block's texts, as numbers of its distinct words, pairs and triples, which ascend by key."""

    ids: list
    owner: np.ndarray
    word: np.ndarray
    words: np.ndarray
    pair: np.ndarray
    pairs: np.ndarray
    #: Of the distinct pairs.
    pair_word: np.ndarray
    pair_context: np.ndarray
    #: Of the tokens that are not the first of their text: their places and triples. Without order three, none.
    later: np.ndarray
    triple: np.ndarray
    triples: np.ndarray
    #: Of the distinct triples: the pair before the word, and the pair that ends in it.
    triple_context: np.ndarray
    triple_pair: np.ndarray
    #: The block's own counts in training texts. The start counts as a context: once for each text.
    word_counts: np.ndarray
    pair_counts: np.ndarray
    triple_counts: np.ndarray


def _ascending(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, where each appears first, and the number of every key."""
    distinct, first, number = tb.factorize(keys)
    order = np.argsort(distinct)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return distinct[order], first[order], rank[number]


def tokens(row: dict, order: int, held_out) -> Tokens:
    block, ids = unpack(row)
    data = tb.lower_ascii(block.data)
    starts, ends = block.spans(tb.WORD[data])
    owner = block.owner(starts)
    at = np.searchsorted(owner, np.arange(len(block)), side="right")
    h = np.insert(tb.span_hash(data, starts, ends, 1), at, END)
    owner = np.insert(owner, at, np.arange(len(block)))
    words, _, word = _ascending(np.append(h, START))
    context = np.empty(len(h), dtype=np.int64)
    context[1:] = word[:-2]
    context[np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))] = word[-1]
    pairs, first, pair = _ascending(tb.mix(words[context] * np.uint64(0x9E3779B97F4A7C15) + h))
    later = np.flatnonzero(owner[1:] == owner[:-1]) + 1 if order == 3 else np.empty(0, dtype=np.int64)
    keys = tb.mix(pairs[pair[later - 1]] * np.uint64(0x9E3779B97F4A7C15) + h[later])
    triples, at, triple = _ascending(keys)
    start, word = word[-1], word[:-1]
    trained = ~held_out(ids)
    learn = trained[owner]
    word_counts = np.bincount(word[learn], minlength=len(words))
    word_counts[start] = trained.sum()
    return Tokens(
        ids, owner, word, words, pair, pairs, word[first], context[first],
        later, triple, triples, pair[later[at] - 1], pair[later[at]],
        word_counts, np.bincount(pair[learn], minlength=len(pairs)), np.bincount(triple[learn[later]], minlength=len(triples)),
    )


def _sent_counts(block: int, kind: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.Table:
    return send_sorted(block, keys, buckets, {"counts": counts.astype(np.int32)}, kind)


def _send_counts(buckets: int, order: int, held_out):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                t = tokens(row, order, held_out)
                yield from _sent_counts(row["block"], WORDS, t.words, t.word_counts, buckets).to_batches()
                yield from _sent_counts(row["block"], PAIRS, t.pairs, t.pair_counts, buckets).to_batches()

    return run


def _open_triples(t: Tokens, pairs: np.ndarray) -> np.ndarray:
    """Which triples other blocks may have too, by the answers about pairs."""
    return (pairs[t.triple_context] | pairs[t.triple_pair]) & 2 == 0


def _send_triples(buckets: int, order: int, held_out):
    """The triples that other blocks may have; of the others, the counts of counts."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return nothing_sent("keys", "counts")
        row = table.to_pylist()[0]
        t = tokens(row, order, held_out)
        others = _open_triples(t, _answer(answers.to_pylist(), PAIRS, "a", np.int64))
        stats = _stats(t.triple_counts[~others])
        local = [[row["block"]], [row["block"] % buckets], [LOCAL], [b""], [stats.tobytes()]]
        sent = _sent_counts(row["block"], TRIPLES, t.triples[others], t.triple_counts[others], buckets)
        local = pa.table([pa.array(x, f.type) for x, f in zip(local, sent.schema, strict=True)], schema=sent.schema)
        return pa.concat_tables([sent, local])

    return run


def _stats(counts: np.ndarray) -> np.ndarray:
    """The sum of counts, how many there are, and the counts of counts, over what is not zero."""
    counted = counts[counts > 0]
    of_counts = np.bincount(np.minimum(counted, DISCOUNTED + 2), minlength=DISCOUNTED + 3)
    return np.array([counted.sum(), len(counted), *of_counts[1 : DISCOUNTED + 2]], dtype=np.int64)


def _gather(table: pa.Table, **kinds) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """The entries of one bucket: where the rows end, the distinct keys, the number of each key, and the columns."""
    keys = [unpack_sorted(x) for x in table["keys"].to_pylist()]
    cuts = np.cumsum([len(x) for x in keys])[:-1]
    distinct, _, number = tb.factorize(np.concatenate(keys))
    return cuts, distinct, number, {k: np.concatenate([unpack_array(x, t) for x in table[k].to_pylist()]) for k, t in kinds.items()}


def _count(table: pa.Table) -> pa.Table:
    """Of one bucket and kind: totals for the senders, aligned with what they sent, and counts of counts. The lowest
    bit of an answer says that the sender stands for the key, the next one that it is the only sender."""
    kind, n = table["kind"][0].as_py(), table.num_rows
    if kind == LOCAL:
        n, kind, values = 0, TRIPLES, []
        stats = np.sum([np.frombuffer(x, np.int64) for x in table["counts"].to_pylist()], axis=0)
    else:
        cuts, distinct, number, got = _gather(table, counts=np.int32)
        totals = np.bincount(number, weights=got["counts"], minlength=len(distinct)).astype(np.int64)
        alone = np.bincount(number, minlength=len(distinct))[number] == 1
        stands = np.zeros(len(number), dtype=np.int64)
        # The first sender that saw the key in training stands for it.
        seen = np.flatnonzero(got["counts"] > 0)
        stands[seen[np.unique(number[seen], return_index=True)[1]]] = 1
        values = np.split(totals[number] * 4 + alone * 2 + stands, cuts)
        stats = _stats(totals[distinct != START] if kind == WORDS else totals)
    return pa.table(
        {
            "block": pa.array([*table["block"].to_pylist()[:n], -1], pa.int64()),
            "bucket": pa.array([table["bucket"][0].as_py()] * (n + 1), pa.int32()),
            "kind": pa.array([kind] * n + [TOTALS + kind], pa.int32()),
            "a": pa.array([pack_array(x) for x in values] + [stats.tobytes()], pa.binary()),
            "b": pa.array([b""] * (n + 1), pa.binary()),
        }
    )


def smoothed(of_counts: np.ndarray) -> np.ndarray | None:
    """Counts of counts on the line through their logarithms, as in simple Good-Turing; None with fewer than two.

    ``of_counts[i]`` keys have the count i + 1. A count that nothing has shares the next one's keys.
    """
    n = np.asarray(of_counts, dtype=float)
    r = np.arange(1, len(n) + 1)
    at = r[n > 0]
    if len(at) < 2:
        return None
    before = np.concatenate([[0], at[:-1]])
    after = np.append(at[1:], 2 * at[-1] - before[-1])
    slope, level = np.polyfit(np.log(at), np.log(n[at - 1] / ((after - before) / 2)), 1)
    return np.exp(level + slope * np.log(r))


def discounts(of_counts: np.ndarray) -> np.ndarray:
    """Factors for counts 0 to DISCOUNTED, then 1: Katz's from the smoothed counts of counts. Those are between 0
    and 1 where the counts of counts fall faster than 1 / count; a factor that is not is (c - 1/2) / c."""
    r = np.arange(1, DISCOUNTED + 1)
    factors = (r - 0.5) / r
    n = smoothed(of_counts)
    if n is not None:
        common = (DISCOUNTED + 1) * n[DISCOUNTED] / n[0]
        katz = ((r + 1) * n[1:] / n[:-1] / r - common) / (1 - common) if common < 1 else np.zeros(DISCOUNTED)
        factors = np.where((katz > 0) & (katz < 1), katz, factors)
    return np.concatenate([[0.0], factors, [1.0]])


class Totals:
    """Numbers of the whole corpus, from the tokens, the distinct words, and the counts of counts by order."""

    def __init__(
        self, tokens: int, words: int, words_of_count: np.ndarray, pairs_of_count: np.ndarray, triples_of_count: np.ndarray | None = None
    ):
        self.tokens, self.words = tokens, words
        self.word_factors, self.pair_factors = discounts(words_of_count), discounts(pairs_of_count)
        self.triple_factors = self.pair_factors if triples_of_count is None else discounts(triples_of_count)
        r = np.arange(1, DISCOUNTED + 1)
        left = float(((1 - self.word_factors[1:-1]) * r * words_of_count[:DISCOUNTED]).sum())
        self.unknown = left / max(1, tokens)
        if left <= 0:
            # Nothing to discount: an unknown word gets the share of one more token.
            self.unknown = 1 / (tokens + 1)
            self.word_factors = self.word_factors * tokens / (tokens + 1)

    def word_probability(self, counts: np.ndarray) -> np.ndarray:
        known = self.word_factors[np.minimum(counts, DISCOUNTED + 1)] * counts / max(1, self.tokens)
        return np.where(counts > 0, known, self.unknown)

    def pair_probability(self, counts: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        return self.pair_factors[np.minimum(counts, DISCOUNTED + 1)] * counts / np.maximum(contexts, 1)

    def triple_probability(self, counts: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        return self.triple_factors[np.minimum(counts, DISCOUNTED + 1)] * counts / np.maximum(contexts, 1)


def _of_kind(answers: list[dict], kind: int) -> list[dict]:
    return sorted((r for r in answers if r["kind"] == kind), key=lambda r: r["bucket"])


def _answer(answers: list[dict], kind: int, column: str, dtype) -> np.ndarray:
    """The answers of all buckets, in the order of what was sent."""
    return np.concatenate([np.empty(0, dtype), *(unpack_array(r[column], dtype) for r in _of_kind(answers, kind))])


@dataclass
class Counts:
    """What is known of a block's distinct words, pairs and triples."""

    words: np.ndarray
    pairs: np.ndarray
    triples: np.ndarray
    #: The pairs and triples that the block stands for.
    own_pairs: np.ndarray
    own_triples: np.ndarray
    #: The words and pairs seen in training that other blocks may have successors of.
    shared_words: np.ndarray
    shared_pairs: np.ndarray


def _counts(t: Tokens, answers: list[dict]) -> Counts:
    words, pairs = (_answer(answers, kind, "a", np.int64) for kind in (WORDS, PAIRS))
    triples = t.triple_counts * 4 + (t.triple_counts > 0)
    triples[_open_triples(t, pairs)] = _answer(answers, TRIPLES, "a", np.int64)
    # Nothing comes after the end.
    inner = t.words[t.pair_word] != END if len(t.triples) else np.zeros(len(t.pairs), dtype=bool)
    shared_words = np.flatnonzero((t.words != END) & (words // 4 > 0) & (words & 2 == 0))
    shared_pairs = np.flatnonzero(inner & (pairs // 4 > 0) & (pairs & 2 == 0))
    return Counts(words // 4, pairs // 4, triples // 4, np.flatnonzero(pairs & 1), np.flatnonzero(triples & 1), shared_words, shared_pairs)


def _classes(context: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """How many have the count 1, 2, ..., and the sum of the counts beyond the discounted ones, each by context."""
    out = np.zeros((DISCOUNTED + 1, n), dtype=np.int64)
    np.add.at(out, (np.minimum(counts, DISCOUNTED + 1) - 1, context), np.where(counts > DISCOUNTED, counts, 1))
    return out


def _discounted(classes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The sum of the discounted counts of such classes."""
    return (factors[1:] * np.append(np.arange(1, DISCOUNTED + 1), 1)) @ classes


def _word_classes(t: Tokens, counts: Counts) -> np.ndarray:
    """By word, over the pairs after it that the block stands for: classes of their counts, and of their words'."""
    of, context = counts.own_pairs, t.pair_context[counts.own_pairs]
    return np.vstack([_classes(context, x, len(t.words)) for x in (counts.pairs[of], counts.words[t.pair_word[of]])])


def _pair_classes(t: Tokens, counts: Counts) -> np.ndarray:
    """The same by pair, over triples and the pairs that end them."""
    of, context = counts.own_triples, t.triple_context[counts.own_triples]
    return np.vstack([_classes(context, x, len(t.pairs)) for x in (counts.triples[of], counts.pairs[t.triple_pair[of]])])


def _asking(t: Tokens, counts: Counts) -> tuple[np.ndarray, np.ndarray]:
    """Which words and pairs have an unseen successor in the block."""
    words, pairs = np.zeros(len(t.words), dtype=bool), np.zeros(len(t.pairs), dtype=bool)
    words[t.pair_context[counts.pairs == 0]] = True
    pairs[t.triple_context[counts.triples == 0]] = True
    return words, pairs


def _send_classes(buckets: int, order: int, held_out):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return nothing_sent("keys", "classes", "asks")
        row = table.to_pylist()[0]
        t = tokens(row, order, held_out)
        counts = _counts(t, answers.to_pylist())
        asks_words, asks_pairs = _asking(t, counts)
        sent = []
        for kind, keys, of, classes, asks in (
            (SUMS, t.words, counts.shared_words, _word_classes(t, counts), asks_words),
            (PAIR_SUMS, t.pairs, counts.shared_pairs, _pair_classes(t, counts), asks_pairs),
        ):
            sent.append(send_sorted(row["block"], keys[of], buckets, {"classes": classes[:, of], "asks": asks[of]}, kind))
        return pa.concat_tables(sent)

    return run


def _add_classes(table: pa.Table) -> pa.Table:
    """Of one bucket and kind: for every entry, whether no successor has a discounted count; the sums, if asked."""
    cuts, distinct, number, got = _gather(table, asks=np.bool_)
    width = 2 * (DISCOUNTED + 1)
    classes = [unpack_array(x, np.int64).reshape(width, -1) for x in table["classes"].to_pylist()]
    sums = np.zeros((width, len(distinct)), dtype=np.int64)
    for k in range(width):
        np.add.at(sums[k], number, np.concatenate([x[k] for x in classes]))
    full = (sums[:DISCOUNTED] == 0).all(axis=0)
    sums = [sums[:, n[asked]] for n, asked in zip(np.split(number, cuts), np.split(got["asks"], cuts), strict=True)]
    return pa.table(
        {
            "block": table["block"],
            "bucket": table["bucket"],
            "kind": table["kind"],
            "a": pa.array([pack_array(x) for x in np.split(full[number], cuts)], pa.binary()),
            "b": pa.array([pack_array(x) for x in sums], pa.binary()),
        }
    )


def _whole(classes: np.ndarray, shared: np.ndarray, asking: np.ndarray, answers: list[dict], kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes by context with those of all blocks where they were asked for, and which contexts are full."""
    full = (classes[:DISCOUNTED] == 0).all(axis=0)
    full[shared] = _answer(answers, kind, "a", np.bool_)
    sums = [unpack_array(r["b"], np.int64).reshape(len(classes), -1) for r in _of_kind(answers, kind)]
    if sums:
        classes[:, shared[asking[shared]]] = np.hstack(sums)
    return classes, full


def weights(seen: np.ndarray, lower: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By context: the factor of seen pairs and the weight of unseen ones, from the sums over the seen pairs."""
    factor = full_factor(1 - seen < 1e-9, counts)
    rest = np.maximum(1 - lower, 1e-12)
    return factor, np.where(counts > 0, (1 - factor * seen) / rest, 1.0)


def full_factor(full: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What a seen context whose successors are all beyond the discounted counts keeps for them; 1 for others."""
    return np.where(full & (counts > 0), counts / (counts + 1.0), 1.0)


def _evaluate(buckets: int, order: int, held_out, totals: Totals):
    half = DISCOUNTED + 1

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _NO_SCORES
        t, got = tokens(table.to_pylist()[0], order, held_out), answers.to_pylist()
        counts = _counts(t, got)
        words, pairs, triples = counts.words, counts.pairs, counts.triples
        asks_words, asks_pairs = _asking(t, counts)
        classes, full = _whole(_word_classes(t, counts), counts.shared_words, asks_words, got, SUMS)
        seen = _discounted(classes[:half], totals.pair_factors) / np.maximum(words, 1)
        # Weights count only where a successor is unseen: there the classes are whole.
        _, weight = weights(seen, _discounted(classes[half:], totals.word_factors) / max(1, totals.tokens), words)
        of_word = full_factor(full, words)
        alone = totals.word_probability(words)
        context, word = t.pair_context, t.pair_word
        of_pairs = np.where(pairs > 0, of_word[context] * totals.pair_probability(pairs, words[context]), weight[context] * alone[word])
        logs = np.log10(of_pairs)[t.pair]
        if order == 3:
            classes, full = _whole(_pair_classes(t, counts), counts.shared_pairs, asks_pairs, got, PAIR_SUMS)
            seen = _discounted(classes[:half], totals.triple_factors) / np.maximum(pairs, 1)
            lower = of_word[word] * _discounted(classes[half:], totals.pair_factors) / np.maximum(words[word], 1)
            _, weight = weights(seen, lower, pairs)
            factor, context = full_factor(full, pairs), t.triple_context
            of_triples = np.where(
                triples > 0, factor[context] * totals.triple_probability(triples, pairs[context]), weight[context] * of_pairs[t.triple_pair]
            )
            logs[t.later] = np.log10(of_triples)[t.triple]
        n = len(t.ids)
        base = np.log10((words + 0.5) / (totals.tokens + 0.5 * (totals.words + 1)))
        # The start is a context, never a token.
        return pa.table(
            {
                "doc_id": pa.array(t.ids, pa.int64()),
                "n_tokens": pa.array(np.bincount(t.owner, minlength=n), pa.int64()),
                "n_known": pa.array(np.bincount(t.owner, weights=words[t.word] > 0, minlength=n).astype(np.int64)),
                "base_score": pa.array(np.bincount(t.owner, weights=base[t.word], minlength=n)),
                "score": pa.array(np.bincount(t.owner, weights=logs, minlength=n)),
            }
        )

    return run


_SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"
_NO_SCORES = pa.table({k: pa.array([], pa.int64() if t == "long" else pa.float64()) for k, t in (x.split() for x in _SCORES.split(", "))})


def held_out_ids(ids: list, parts: int = 5, part: int = 1) -> np.ndarray:
    """Which ids are not learned from: crc32 of the id as text, modulo ``parts``, is ``part``."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % parts == part for i in ids], dtype=bool)


def katz_scores(docs: DataFrame, held_out=held_out_ids, order: int = 2) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for the rows of ``docs`` (doc_id, text), by a
    model of order two or three."""
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = docs.sparkSession
    scratch = Scratch(spark, "katz")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = pack(docs, scratch, buckets, BLOCK_BYTES)

    def answered(answers: DataFrame, step, schema: str) -> DataFrame:
        return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(step, schema)

    def counted(sent: DataFrame) -> DataFrame:
        return scratch.write(sent.groupBy("bucket", "kind").applyInArrow(_count, _ANSWER))

    found = counted(blocks.mapInArrow(_send_counts(buckets, order, held_out), sent_schema("keys", "counts")))
    if order == 3:
        sent = answered(found.where(F.col("kind") == PAIRS), _send_triples(buckets, order, held_out), sent_schema("keys", "counts"))
        found = found.union(counted(sent))
    # A row per bucket and kind, each of a few numbers.
    sums = {kind: np.zeros(DISCOUNTED + 3, np.int64) for kind in (WORDS, PAIRS, TRIPLES)}
    for r in found.where(F.col("block") == -1).select("kind", "a").collect():
        sums[r["kind"] - TOTALS] += np.frombuffer(r["a"], np.int64)
    n, v, *of_words = sums[WORDS].tolist()
    totals = Totals(n, v, np.array(of_words), sums[PAIRS][2:], sums[TRIPLES][2:])
    found = found.where(F.col("block") >= 0)
    classes = answered(found, _send_classes(buckets, order, held_out), sent_schema("keys", "classes", "asks"))
    added = scratch.write(classes.groupBy("bucket", "kind").applyInArrow(_add_classes, _ANSWER))
    scored = answered(found.union(added), _evaluate(buckets, order, held_out, totals), _SCORES)
    return scored.withColumn("train_tokens", F.lit(n).cast("long"))


def op4_katz_model(spark: SparkSession, folder: str) -> DataFrame:
    scored = katz_scores(read(spark, folder, "documents"), order=3)
    held_out = (fold("doc_id", 5) == 1).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")
