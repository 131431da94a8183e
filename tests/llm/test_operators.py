"""Every operator against a plain version of its contract, on texts with all the hard cases, and on no rows."""

import base64
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import types as T
from tokenizers import Tokenizer

from impactframe.llm import byte_bpe, codeword_language, decontaminate, katz_model, line_runs, ngram_jaccard
from impactframe.llm import random_indexing, robust_quality, suffix_dedup, textblock, token_records
from impactframe.llm.pretokens import pieces
from impactframe.llm.tables import Scratch
import brute

pytestmark = pytest.mark.filterwarnings("ignore")


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_decontamination(spark, docs, no_docs, pairs):
    items = [(1, pairs[30][1]), (2, "an"), (2, pairs[12][1]), (None, pairs[30][1]), (4, None), (5, " ".join((pairs[66][1] or "a b").split()[:20]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "_n_words", "_n_hit", "_items", "_contaminated"]
    named = [(x if x is not None else "null", t) for x, t in items]
    expected = sorted(brute.contamination(pairs, named))
    for limit in (10**6, 0):
        got = decontaminate.find_contamination(docs, bench, most_broadcast=limit)
        found = sorted((d, n, h, len(i), brute.sha(",".join(i)), c) for d, n, h, i, c in got.select(columns).collect())
        assert found == expected
    assert decontaminate.remove_documents(docs, bench).columns == docs.columns
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench.where("item_id = 1")).collect()}
    assert len(cut[pairs[30][0]].split()) < len(pairs[30][1].split())
    assert cut[163] == dict(pairs)[163]
    assert decontaminate.find_contamination(no_docs, bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.where("item_id < 0")).where("_n_hit > 0").count() == 0


def test_suffix_dedup(docs, no_docs, pairs):
    got = suffix_dedup.remove_repeats(docs).collect()
    found = sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), brute.sha(bytes(r.kept))) for r in got)
    assert found == sorted(brute.repeats(pairs))
    assert sum(r.n_removed for r in got) > 1000
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_base_statistics_and_outliers(spark, docs, no_docs, pairs):
    got = rows(robust_quality.judge(docs), "doc_id", *(f"_{k}" for k in robust_quality._COUNTS if k != "n_lines"), "_base_failed")
    assert got == sorted((d, *brute.base_statistics(t)) for d, t in pairs)
    assert robust_quality.judge(no_docs).count() == 0
    rng = random.Random(1)
    clean = [(i, " ".join(rng.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=rng.randint(30, 200))) + f" {i}") for i in range(300)]
    clean = [(i, " ".join(f"{w}{rng.randrange(10**6)}" for w in t.split())) for i, t in clean]
    odd = [(1000 + i, " ".join(f"{rng.randrange(10**6)}***$$" for _ in range(80))) for i in range(10)]
    table = spark.createDataFrame([(i, t, "en", "s") for i, t in clean + odd], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r._kept for r in robust_quality.judge(table).collect()}
    assert all(kept[i] for i, _ in clean) and not any(kept[i] for i, _ in odd)


def test_outlier_cut(spark):
    # The share of chi-square with five degrees of freedom beyond the cut is what the module says.
    x = robust_quality.CUT
    beyond = math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)
    assert 1 / 70_000 < beyond < 1 / 65_000
    rng = random.Random(2)
    clean = [(i, " ".join(f"word{rng.randrange(10**6)}" for _ in range(rng.randint(60, 120)))) for i in range(300)]
    # More and more symbols, so that some texts are just beyond the cut.
    junk = [(1000 + k, clean[k][1] + " " + "#" * k) for k in range(120)]
    table = spark.createDataFrame([(i, t, "en", "s") for i, t in clean + junk], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in robust_quality.judge(table).collect()}
    edge = [r for r in got.values() if 30 < r._distance <= 36]
    assert edge and not any(r._kept for r in edge)
    assert all(got[i]._kept for i, _ in clean)


def test_katz_model(docs, no_docs, pairs):
    got = {r.doc_id: r for r in katz_model.katz_scores(docs).collect()}
    token_lists = [(d, [*brute.words(t), None]) for d, t in pairs]
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    single, double, contexts = Counter(), Counter(), Counter()
    for d, w in token_lists:
        if not held(d):
            single.update(w)
            double.update(zip([0, *w], w))
            contexts.update([0, *w][:-1])
    n = sum(single.values())
    of = lambda c: np.array([sum(x == r for x in c.values()) for r in range(1, 7)])
    totals = katz_model.Totals(n, len(single), of(single), of(double))
    p1 = lambda w: float(totals.word_probability(np.array([single[w]]))[0])
    assert abs(sum(map(p1, single)) + totals.unknown - 1) < 1e-9
    seen, lower = Counter(), Counter()
    for (a, b), c in double.items():
        seen[a] += float(totals.pair_probability(np.array([c]), np.array([contexts[a]]))[0])
        lower[a] += p1(b)

    def p2(a, b):
        factor, weight = (float(x[0]) for x in katz_model.weights(*(np.array([v]) for v in (seen[a], lower[a], contexts[a]))))
        if double[a, b]:
            return factor * float(totals.pair_probability(np.array([double[a, b]]), np.array([contexts[a]]))[0])
        return weight * p1(b)

    for context in list(contexts)[:60]:
        assert abs(sum(p2(context, w) for w in single) + p2(context, "never seen") - 1) < 1e-9
    for d, w in token_lists:
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(single[x] > 0 for x in w), n)
        assert abs(r.score - sum(math.log10(p2(a, b)) for a, b in zip([0, *w], w))) < 1e-6
        assert abs(r.base_score - sum(math.log10((single[x] + 0.5) / (n + 0.5 * (len(single) + 1))) for x in w)) < 1e-6
    assert katz_model.katz_scores(no_docs).count() == 0


@pytest.mark.parametrize(
    "of_counts",
    [
        [200420, 57120, 23804, 13644, 12859, 6775],
        [1482341, 227973, 46941, 19718, 17404, 6993],
        [90, 0, 12, 0, 7, 0],
    ],
)
def test_katz_discounts_stay_good_turing(of_counts):
    # The counts of counts of real texts with copies: n_5 is lifted.
    factors = katz_model.discounts(np.array(of_counts))[1:-1]
    assert ((factors > 0) & (factors < 1)).all()
    assert not np.isclose(factors, [(r - 0.5) / r for r in range(1, 6)]).any()
    # What the discounts take from the smoothed counts is the smoothed share of what occurs once.
    fit = katz_model.smoothed(np.array(of_counts))
    assert sum((1 - f) * r * n for f, r, n in zip(factors, range(1, 6), fit)) == pytest.approx(fit[0])


def test_katz_discounts_of_a_power_law():
    # r* / r is r / (r + 1), and the common share 1 / 6.
    got = katz_model.discounts(np.array([3600 / r**2 for r in range(1, 7)]))
    assert np.allclose(got, [0, *((r / (r + 1) - 1 / 6) / (5 / 6) for r in range(1, 6)), 1])
    # Nothing to fit, or counts of counts that do not fall: no Good-Turing discount there is.
    for flat in ([0] * 6, [5, 0, 0, 0, 0, 0], [4] * 6):
        assert np.allclose(katz_model.discounts(np.array(flat))[1:-1], [(r - 0.5) / r for r in range(1, 6)])


def test_katz_model_of_order_three(spark, docs, no_docs, pairs):
    token_lists = [(d, [*brute.words(t), None]) for d, t in pairs]
    counts = [Counter(), Counter(), Counter()]
    for d, w in token_lists:
        if zlib.crc32(str(d).encode()) % 5 != 1:
            for k, counter in enumerate(counts):
                counter.update(zip(*([0, *w][max(0, 1 - k) + i :] for i in range(k + 1))))
    single, n = counts[0], sum(counts[0].values())
    totals = katz_model.Totals(n, len(single), *(np.array([sum(x == r for x in c.values()) for r in range(1, 7)]) for c in counts))
    factors = [totals.word_factors, totals.pair_factors, totals.triple_factors]
    after = [{}, {}, {}]
    for k in (1, 2):
        for gram in counts[k]:
            after[k].setdefault(gram[:-1], []).append(gram[-1])
    cache = {}

    def p(*gram):
        """Of the last word after the others."""
        if gram not in cache:
            cache[gram] = probability(*gram)
        return cache[gram]

    def probability(*gram):
        k, context = len(gram) - 1, gram[:-1]
        if not k:
            return factors[0][min(single[gram], 6)] * single[gram] / n if single[gram] else totals.unknown
        follow = after[k].get(context, [])
        size = sum(counts[k][*context, w] for w in follow)
        if not size:
            return p(*gram[1:])
        share = {w: factors[k][min(c := counts[k][*context, w], 6)] * c / size for w in follow}
        scale = size / (size + 1) if 1 - sum(share.values()) < 1e-9 else 1
        if gram[-1] in share:
            return scale * share[gram[-1]]
        return (1 - scale * sum(share.values())) / (1 - sum(p(*gram[1:-1], w) for w in follow)) * p(*gram[1:])

    for context in [*list(after[2])[:20], (0, "never seen"), ("never", "seen")]:
        assert abs(sum(p(*context, *w) for w in single) + p(*context, "never seen") - 1) < 1e-9
    # One block, where nothing is shared, and one for each text or two.
    for parts in (1, 40):
        got = {r.doc_id: r for r in katz_model.katz_scores(docs.repartition(parts), order=3).collect()}
        for d, w in token_lists:
            s = [0, *w]
            expected = math.log10(p(0, w[0])) + sum(math.log10(p(*s[i : i + 3])) for i in range(len(s) - 2))
            assert abs(got[d].score - expected) < 1e-6 and got[d].n_tokens == len(w)
    assert katz_model.katz_scores(no_docs, order=3).count() == 0


def test_line_dedup(docs, no_docs, pairs):
    kept = line_runs.dedup_lines(docs)
    got = sorted((r.doc_id, r._n_lines, r._n_dropped, brute.sha(r.text or "")) for r in kept.collect())
    assert got == sorted(brute.lines(pairs))
    assert {r.doc_id for r in kept.where("text is null").collect()} == {160}
    assert line_runs.dedup_lines(no_docs).count() == 0


def test_line_runs_compact(spark):
    runs = line_runs.LineRuns(Scratch(spark, "test"), fanout=2)
    for low in range(5, 0, -1):
        runs.add(spark.createDataFrame([(low, k, 0) for k in range(low, low + 3)], "doc_id long, key_a long, key_b long"))
    assert all(len(level) < 2 for level in runs.levels)
    table = {r.key_a: (r.n_docs, r.keeper) for r in runs.table().collect()}
    assert table == {k: (len(h := [d for d in range(1, 6) if d <= k < d + 3]), max(h)) for k in range(1, 8)}


def test_token_records(spark, docs, no_docs, pairs, tmp_path):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    manifest = token_records.write_records(docs, f"file://{tmp_path}/records")
    got = sorted((r.doc_id, r.start, bytes(r.ids)) for r in token_records.read_records(manifest).collect())
    start = 0
    for (doc, text), (d, at, ids) in zip(sorted(pairs, key=lambda p: p[0]), got, strict=True):
        expected = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert (d, at, np.frombuffer(ids, "<u4").tolist()) == (doc, start, expected)
        start += len(expected)
    path = next(tmp_path.glob("records/*.rec"))
    data = bytearray(path.read_bytes())
    assert token_records.unframe(bytes(data), 0)
    data[20] ^= 1
    with pytest.raises(ValueError, match="broken record"):
        token_records.unframe(bytes(data), 0)
    empty = token_records.write_records(no_docs, f"file://{tmp_path}/none")
    assert token_records.read_records(empty).count() == 0


def test_pieces_equal_the_pattern():
    rng = random.Random(1)
    alphabet = [*"ab'sstrevemld 1²  \n\t\r é漢😀_-!\x1c ÀZ", "'s", "'ll", " '"]
    texts = ["", "'", " 's", "\n's", "don't we'llx", "a \n b", "x  "] + ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(3000)]
    white = lambda p: p.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
    plain = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
    for spaced, pattern in ((True, white(public_tokenizers.PATTERN)), (False, plain)):
        i = 0
        for block in textblock.blocks([pa.record_batch({"text": texts})], max_bytes=5000):
            starts, ends, owner = pieces(block, spaced)
            raw = block.data.tobytes()
            for k in range(len(block)):
                got = [raw[s:e].decode() for s, e in zip(starts[owner == k], ends[owner == k])]
                assert got == regex.findall(pattern, texts[i])
                i += 1


def test_byte_bpe(docs, no_docs, pairs):
    ranks = byte_bpe.ranks(open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb").read())
    encoder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = sorted((d, encoder.encode_ordinary(t or "")) for d, t in pairs)
    for reread in (True, False):
        encoded = byte_bpe.encode(docs, chunk_bytes=4000, reread=reread)
        assert sorted((r.doc_id, list(r.ids)) for r in encoded.collect()) == expected
    decoded = byte_bpe.decode(byte_bpe.encode(docs))
    assert sorted((r.doc_id, bytes(r.decoded).decode()) for r in decoded.collect()) == sorted((d, t or "") for d, t in pairs)
    assert byte_bpe.encode(no_docs).count() == 0
    assert base64.b64encode(b"a") and len(ranks) > 50_000


def test_jaccard_components(docs, no_docs, pairs):
    got = rows(ngram_jaccard.jaccard_components(docs), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.components(pairs))
    assert sum(c != d for d, _, c in got) >= 8
    assert ngram_jaccard.jaccard_components(no_docs).count() == 0


def test_jaccard_near_the_limit(spark):
    """Families whose members are just linked or just not, around several centres that share passages."""
    rng = random.Random(5)
    table = []
    for family in range(6):
        core = [f"w{family if i % 5 else 'x'}-{i}" for i in range(90)]
        for _ in range(25):
            text = list(core)
            for _ in range(rng.randint(0, 6)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(40)}"
            table.append((len(table), " ".join(text[: rng.randint(70, 90)])))
    frame = spark.createDataFrame(table, "doc_id long, text string")
    assert rows(ngram_jaccard.jaccard_components(frame), "doc_id", "n_shingles", "component_id") == sorted(brute.components(table))


def test_jaccard_counts_every_link(spark, monkeypatch):
    """Near copies of one text are nearly all similar to each other, also where a leader has joined them already, and
    where they take several tiles; copies of one set are one class."""
    rng = random.Random(11)
    table = []
    for family in range(3):
        core = [f"w{family}-{i}" for i in range(130)]
        for _ in range(20):
            text = list(core)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
            table.append((len(table), " ".join(text)))
    table += [(1000, table[3][1]), (1001, "one two three"), (1002, None)]
    frame = spark.createDataFrame(table, "doc_id long, text string")
    expected = sorted(brute.link_counts(table))
    assert sum(n for _, n in expected) > 3 * 20 * 10
    assert rows(ngram_jaccard.jaccard_components(frame), "doc_id", "n_links") == expected
    monkeypatch.setattr(ngram_jaccard, "TILE_SETS", 4)
    monkeypatch.setattr(ngram_jaccard, "TILE_COLUMNS", 7)
    assert rows(ngram_jaccard.jaccard_components(frame), "doc_id", "n_links") == expected
    assert ngram_jaccard.jaccard_components(frame, count_links=False).columns == ["doc_id", "n_shingles", "component_id"]


def test_jaccard_plans_stay_small(spark, monkeypatch):
    """No plan holds the plans of the turns before it: the driver keeps plans, and their code, in its memory."""
    plans = []

    def write(scratch, df, *partitions, known=Scratch.write):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return known(scratch, df, *partitions)

    monkeypatch.setattr(Scratch, "write", write)
    word = lambda k: " ".join(f"{k}-{i}" for i in range(40))
    table = [(1, word("a")), (2, word("a") + " end"), (3, word("b")), (4, "start " + word("b")), (5, word("c"))]
    frame = spark.createDataFrame(table, "doc_id long, text string")
    got = rows(ngram_jaccard.jaccard_components(frame), "doc_id", "component_id", "n_links")
    assert got == [(1, 1, 1), (2, 1, 1), (3, 3, 1), (4, 3, 1), (5, 5, 0)]
    assert max(plan.count("Join ") for plan in plans) <= 8


def test_jaccard_texts_that_share_an_id(spark):
    """Each text of an id is compared as it is; then all that they link to is one component."""
    word = lambda k: " ".join(f"{k}-{i}" for i in range(40))
    near = lambda k: word(k) + f" end-{k}"
    table = [(9, word("a")), (9, word("b")), (None, word("c")), (None, word("d")), (3, near("a")), (4, near("b")), (5, near("c"))]
    table += [(6, near("d")), (7, word("e")), (8, near("e")), (12, word("f"))]
    frame = spark.createDataFrame(table, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.n_links) for r in ngram_jaccard.jaccard_components(frame).collect()}
    assert got == {
        (9, 36): (3, 1), (3, 37): (3, 1), (4, 37): (3, 1), (None, 36): (None, 1), (5, 37): (None, 1), (6, 37): (None, 1),
        (7, 36): (7, 1), (8, 37): (7, 1), (12, 36): (12, 0),
    }


def labelled(spark, n=400):
    rng = random.Random(9)
    kinds = {"en": "the and of ing tion her".split(), "de": "sch ein und ung lich cht".split(), "fr": "eau que ment les oux tre".split()}
    made = []
    for i in range(n):
        lang = ["en", "de", "fr"][i % 3]
        made.append((i, " ".join("".join(rng.choices(kinds[lang], k=2)) for _ in range(40)), lang))
    return spark.createDataFrame(made, "doc_id long, text string, lang string")


def test_language_codewords():
    for k in (2, 4, 9):
        words = codeword_language.codewords(k)
        assert (np.abs(words.sum(axis=0)) < k).all()
        assert min((words[i] != words[j]).sum() for i in range(k) for j in range(i)) >= 2


def test_language_id(spark, docs, no_docs):
    table = labelled(spark)
    model = codeword_language.learned(table)
    got = codeword_language.predict(table, model).select("lang", "_lang_pred", "_score").collect()
    assert np.mean([r.lang == r._lang_pred for r in got]) > 0.97 and all(0 <= r._score <= 1 for r in got)
    odd = {r.doc_id: r for r in codeword_language.predict(docs, model).collect()}
    assert all(odd[i]._lang_pred == "und" and odd[i]._score == 0 for i in (160, 161, 162, 168))
    assert codeword_language.predict(no_docs, model).count() == 0
    assert codeword_language.fit(no_docs) is None
    assert {r._lang_pred for r in codeword_language.predict(docs, None).collect()} == {"und"}
    single = codeword_language.fit(table.where("lang = 'de'"))
    assert {r._lang_pred for r in codeword_language.predict(table, single).collect()} == {"de"}


def test_byte_bpe_memory_of_a_chunk():
    """A chunk's texts are put together some at a time, not with several numbers for every word of the chunk."""

    class Vocabulary:
        value = open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb").read()

    rng = random.Random(4)
    words = ["".join(rng.choices("an er on re at en".split(), k=2)) for _ in range(300)]
    made = [None, "", *(" ".join(rng.choices(words, k=2000)) for _ in range(600)), ""]
    batch = pa.record_batch({"doc_id": pa.array(range(len(made)), pa.int64()), "text": pa.array(made)})
    asked, texts = (pa.Table.from_batches(byte_bpe._chunks(4, 64 << 20, k)(iter([batch]))) for k in ("word_rows", "text_rows"))
    found = byte_bpe._encode_bucket(Vocabulary)(asked)
    tracemalloc.start()
    try:
        got = byte_bpe._reassemble(texts, found)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    encoder = byte_bpe._encoder(Vocabulary.value)
    assert got["doc_id"].to_pylist() == list(range(len(made)))
    assert got["ids"].to_pylist() == [encoder.encode_ordinary(t or "") for t in made]
    assert peak < 30 << 20


def test_language_memory_of_short_texts(spark):
    """Features have a fixed size, so many short texts in one batch must not be worked out together."""

    class Captured:
        schema = T.StructType([T.StructField("text", T.StringType())])

        def mapInArrow(self, run, _):
            return run

    model = codeword_language.learned(labelled(spark))
    batch = pa.record_batch({"text": pa.array([None, "", *(f"a short text {i}" for i in range(5000))])})
    tracemalloc.start()
    try:
        got = pa.Table.from_batches(codeword_language.predict(Captured(), model)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got["text"].to_pylist() == batch["text"].to_pylist()
    assert got["_lang_pred"].to_pylist()[:2] == ["und", "und"] and set(got["_lang_pred"].to_pylist()[2:]) <= {"en", "de", "fr"}
    assert peak < 40 << 20


def test_quality_classifier(spark, docs, no_docs):
    rng = random.Random(2)
    table, labels = [], []
    for i in range(500):
        words = ["".join(rng.choices("an er on re at en".split(), k=2)) for _ in range(rng.randint(10, 80))]
        bad = i % 4 == 0
        table.append((i, " ".join(w + "!!" if bad else w for w in words)))
        labels.append((i, 0 if bad else 1))
    frame = spark.createDataFrame(table, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(9999, 1), (3, None)], "doc_id long, quality int")
    scored = {r.doc_id: r._score for r in random_indexing.score(frame, marks.where("doc_id % 3 != 0")).collect()}
    held = [(i, q) for i, q in labels if i % 3 == 0]
    assert np.mean([(scored[i] >= 0.5) == q for i, q in held]) > 0.95
    assert {r._score for r in random_indexing.score(docs, marks.where("doc_id < 0")).collect()} == {0.5}
    every = random_indexing.score(docs, marks).collect()
    assert len(every) == docs.count() and all(0 <= r._score <= 1 for r in every)
    assert random_indexing.score(no_docs, marks).count() == 0
