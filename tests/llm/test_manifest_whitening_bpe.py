"""The manifest, the whitening and the rank-array encoding against plain versions, through the registered queries."""

import random
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from impactframe.llm import merkle_manifest as M
from impactframe.llm import rank_array_bpe as B
from impactframe.llm import whitening as W

pytestmark = pytest.mark.filterwarnings("ignore")


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, more=0):
    doc_id, source, lang, n_chars, text = row
    return digest(*map(field, (doc_id, source, lang, None if n_chars is None else n_chars + more, text)))


def climb(level):
    """All levels from these nodes to the top."""
    levels = [level]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def plain_manifest(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    low = lambda x: (x[0] is not None, x[0] or 0, leaf_of(x))
    ordered = {lang: sorted(trees[lang], key=low) for lang in langs}
    levels = {lang: climb([leaf_of(r) for r in ordered[lang]]) for lang in langs}
    top = climb([levels[lang][-1][0] for lang in langs])
    out = []
    for t, lang in enumerate(langs):
        for i, row in enumerate(ordered[lang]):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node, path = leaf_of(row, 1 if tampered else 0), []
            for place, above in ((i, levels[lang]), (t, top)):
                for level in above[:-1]:
                    run = level[place & ~1 : (place & ~1) + 2]
                    others = [x for k, x in enumerate(run) if k != place & 1]
                    path += others
                    node = digest(*(node if k == place & 1 else x for k, x in enumerate(run)))
                    place >>= 1
            root = top[-1][0]
            out.append((row[0], leaf_of(row), levels[lang][-1][0], root, digest(*path), node, node == root))
    return sorted(out, key=repr)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, rank int, tree string, path string"


def write_docs(spark, folder, rows):
    spark.createDataFrame([(*r, 1, "t", "p") for r in rows], DOCS).write.parquet(f"{folder}/documents.parquet")
    return M.op11_merkle_manifest(spark, str(folder))


def rows_of(n, rng):
    out = [(i, rng.choice(["s", None, "é"]), rng.choice(["a", "a", "a", "b", "漢", None]), i if i % 5 else None, f"text {i}" if i % 9 else None) for i in range(n)]
    return out + [(None, "s", "a", 1, "x"), (None, "s", "a", 1, "y"), (3, "s", "a", 2, ""), (3, "s", "a", 2, ""), (7, None, "lone", 3, "z" * 5000)]


def test_manifest_query(spark, tmp_path):
    rows = rows_of(75, random.Random(4))
    assert sorted(map(tuple, write_docs(spark, tmp_path, rows).collect()), key=repr) == plain_manifest(rows)


def test_manifest_of_several_rounds(spark, tmp_path):
    rows = rows_of(2500, random.Random(6))
    # More languages than a record has children, too.
    rows += [(10_000 + i, "s", f"x{i}", 1, "t") for i in range(1100)]
    assert sorted(map(tuple, write_docs(spark, tmp_path, rows).collect()), key=repr) == plain_manifest(rows)


def test_manifest_of_one_row_and_of_none(spark, tmp_path):
    one = [(14, "s", None, 1, "x")]
    assert list(map(tuple, write_docs(spark, tmp_path / "a", one).collect())) == plain_manifest(one)
    none = write_docs(spark, tmp_path / "b", [])
    assert none.count() == 0 and none.columns == write_docs(spark, tmp_path / "c", one).columns


def test_proofs_of_a_few_requests(spark):
    rows = rows_of(3000, random.Random(5))
    docs = spark.createDataFrame([(*r, 1, "t", "p") for r in rows], DOCS)
    manifest = M.write_manifest(docs)
    assert len(manifest.languages.rounds) == 2
    some = manifest.entries.where("doc_id % 400 = 3")
    expected = {(r[0], r[1]): r[4] for r in plain_manifest(rows) if r[0] is not None and r[0] % 400 == 3}
    got = M.prove(manifest, some).select("doc_id", F.lower(F.hex("leaf")), F.sha2(F.lower(F.hex("path")), 256)).collect()
    assert {(a, b): c for a, b, c in got} == expected


# --- whitening ------------------------------------------------------------------


def embeddings(spark, folder, rows):
    table = spark.createDataFrame([(*r, "u", 1.0) for r in rows], "vec_id long, embedding array<float>, x string, id double")
    table.write.parquet(f"{folder}/embeddings.parquet")
    return W.op12_embedding_whitening(spark, str(folder))


def plain_whitening(vectors):
    x = np.floor(1024 * np.array(vectors, dtype=np.float32).astype(float)).astype(np.int64) + 100000
    n, sums = len(x), x.sum(axis=0)
    centred = (x * n - sums) / n
    values, components = np.linalg.eigh(centred.T @ centred / n)
    values, components = values[::-1][:8], components[:, ::-1][:, :8]
    total = np.trace(centred.T @ centred / n)
    return ((x * n - sums) ** 2).sum(axis=1), centred @ components, values, values / total


@pytest.mark.parametrize("size", [3, 20])
def test_whitening_query(spark, tmp_path, size):
    rng = np.random.default_rng(size)
    mixing = rng.normal(size=(size, size)) * np.logspace(0, -3, size)
    vectors = (rng.normal(size=(400, size)) @ mixing + 3).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)]
    odd = [(1000, None), (1001, [float("nan")] * size), (1002, [None] + [0.0] * (size - 1)), (1003, [float("inf")] * size), (1004, [1.0])]
    rows += [(5, vectors[5]), (None, vectors[6])]
    got = embeddings(spark, tmp_path, rows + odd).toPandas()
    deviation, projected, values, share = plain_whitening([v for _, v in rows])
    assert len(got) == len(rows) * min(size, 8) and (got.n == len(rows)).all()
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-4
    for c, part in got.groupby("component"):
        assert np.allclose(part.explained, share[c - 1], rtol=1e-9)
        own = part[part.vec_id < 400].drop_duplicates("vec_id").sort_values("vec_id")
        assert (own.deviation.to_numpy() == deviation[:400]).all()
        expected = projected[:400, c - 1] / np.sqrt(values[c - 1])
        sign = np.sign((expected * own.whitened).sum())
        assert np.allclose(own.whitened, sign * expected, rtol=0, atol=1e-7)
    assert got.vec_id.isna().sum() == min(size, 8)


def test_whitening_where_little_varies(spark, tmp_path):
    rng = np.random.default_rng(1)
    flat = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 5))
    # Dimension 3 is constant and dimension 4 repeats dimension 0.
    flat[:, 3], flat[:, 4] = 1.5, flat[:, 0]
    got = embeddings(spark, tmp_path / "flat", list(enumerate(flat.tolist()))).toPandas()
    _, _, values, share = plain_whitening(flat)
    live = values > values[0] * 1e-12
    nulls = got.groupby("component").whitened.apply(lambda w: w.isna().all())
    assert (~nulls).to_numpy().tolist() == live.tolist() and got.identity_error.iloc[0] < 1e-4
    lone = embeddings(spark, tmp_path / "lone", [(1, [1.0, 2.0])]).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in lone] == [(1, 0, None, 0.0, None)] * 2
    assert embeddings(spark, tmp_path / "none", [(1, None)]).count() == 0
    assert embeddings(spark, tmp_path / "empty", [(1, [])]).count() == 0


# --- rank-array encoding --------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(B.VOCABULARY))


@pytest.fixture(scope="module")
def vocabulary():
    with open(public_tokenizers.path(B.VOCABULARY), "rb") as file:
        return B.vocabulary_of(file.read())


def test_short_and_long_merges_equal_the_model(library, vocabulary):
    rng = random.Random(2)
    words = ["".join(rng.choices("aehinorst", k=rng.randint(1, 64))) for _ in range(400)]
    words += ["a" * n for n in range(1, 65)] + ["\x00", "\xff\xfe" * 9, "łódź", "😀😀", "漢字漢字"] + ["the" * 21, "ab" * 32]
    spelt = list(dict.fromkeys(w.encode() for w in words))
    letters = vocabulary.letters()
    expected = [[x.id for x in library.model.tokenize("".join(letters[b] for b in w))] for w in spelt]
    short = [w for w in spelt if len(w) <= B.SHORT]
    assert [x.tolist() for x in B.merge_short(short, vocabulary)] == [e for w, e in zip(spelt, expected) if len(w) <= B.SHORT]
    assert [B.merge_long(w, vocabulary).tolist() for w in spelt] == expected


def test_rank_array_query(spark, tmp_path, texts, library):
    rng = random.Random(9)
    alphabet = list("aAbE'sdtl 12.,!?\n\t") + ["é", "é", "İ", "ß", "Σ", "ς", "ǅ", "漢", "😀", " ", " ", "\u0085", "<|endoftext|>", "<|startoftext|>", "<|", "͸", "٣", "Ⅷ", "‍"]
    made = [(1000 + i, "".join(rng.choices(alphabet, k=rng.randint(0, 60)))) for i in range(400)]
    made += [(2000, "x" * 50_000), (2001, ("the" * 40 + " ") * 30), (None, "Two Words"), (2003, None), (2003, None)]
    rows = texts + made
    table = spark.createDataFrame([(i, t, "i", 1, "d", 2) for i, t in rows], "doc_id long, text string, ids string, n_tokens int, decoded string, block int")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(back.encode()).hexdigest()))
    got = list(map(tuple, B.op13_rank_array_bpe(spark, str(tmp_path)).collect()))
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    kept = B.decode(B.encode(table))
    assert sorted(kept.columns) == sorted(table.columns)
    assert B.digests(B.decode(B.encode(table.where("false")))).count() == 0
