import os
import random
from pathlib import Path

# Python workers import the package too.
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parents[2]), os.environ.get("PYTHONPATH", "")])

import pytest  # noqa: E402

SYLLABLES = "the an er on re at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co".split()


def prose(rng, n):
    made = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]
    return " ".join(w.capitalize() + "." if rng.random() < 0.1 else w for w in made)


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) with what operators must bear: nulls, empty and long texts, copies, ties, odd characters."""
    rng = random.Random(3)
    base = [prose(rng, rng.choice([1, 4, 5, 13, 60, 150])) for _ in range(40)]
    passage, line = prose(rng, 80), "Subscribe to our weekly letter now"
    rows = list(enumerate(base))
    rows += [(100 + i, base[7]) for i in range(4)]
    near = base[8].split() if len(base[8].split()) > 50 else prose(rng, 150).split()
    rows.append((120, " ".join(near)))
    for i in range(6):
        edited = list(near)
        edited[rng.randrange(len(edited))] = "changed"
        rows.append((121 + i, " ".join(edited)))
    rows += [(140 + i, prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 20)) for i in range(5)]
    rows += [(150 + i, f"  {line.upper() if i % 2 else line} \n" + prose(rng, 8)) for i in range(5)]
    rows += [(160, None), (161, ""), (162, " \n\t "), (163, "漢字 ÀÉ İstanbul Σας 😀 'll don't \x1c x"), (164, "na " * 400)]
    rows += [(165, "\n".join([passage] * 3)), (166, prose(rng, 6000)), (167, "One two three\u0085four"), (168, "*** $$$ ||| " * 30)]
    # Patterned words and their mirrors: a polynomial hash modulo 2**64 cannot tell these apart.
    for i, size in ((170, 1024), (173, 2048), (176, 1000)):
        pattern = "".join("ab"[k.bit_count() % 2] for k in range(size))
        mirror = pattern.translate({97: "b", 98: "a"})
        rows += [(i, pattern), (i + 1, mirror), (i + 2, pattern)]
    rows += [(179, "One <|endoftext|> two<|startoftext|>THREE <|ENDOFTEXT|>")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The rows with repeated ones, and columns whose names the operators use themselves."""
    rows = [(i, t, "ab"[i % 2] if i % 7 else None, "s1" if i % 3 else None, 1, "x") for i, t in texts]
    return spark.createDataFrame(rows + rows[3:5], "doc_id long, text string, lang string, source string, n_chars int, node string")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("doc_id < -1")


@pytest.fixture(scope="session")
def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
