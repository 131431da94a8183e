"""The contracts once more, plainly, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def contamination(docs, items, n=13):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    grams = defaultdict(set)
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - n + 1)) if w else ():
            grams[tuple(w[i : i + n])].add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for size in {len(g) for g in grams}:
            for i in range(len(w) - size + 1):
                if (g := tuple(w[i : i + size])) in grams:
                    hit |= set(range(i, i + size))
                    found |= grams[g]
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def repeats(docs, length=100):
    seen, out = {}, {}
    for doc, text in sorted({(d, t or "") for d, t in docs}):
        b = text.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen.setdefault(b[p : p + length], (doc, p)) != (doc, p):
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc, text] = (len(b), sum(gone), spans, sha(kept))
    return [(d, *out[d, t or ""]) for d, t in docs]


def base_statistics(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered, seen, dups = set(), set(), 0
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            covered |= set(range(i, i + 5))
    for line in (text or "").split("\n"):
        if line.strip(SPACES):
            dups += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(map((text or "").count, "#*$%&|<>")), dups, len(covered), failed


def kept_lines(docs):
    """(doc_id, all lines, kept lines) of every row."""
    holders = defaultdict(set)
    key = lambda x: x.strip(SPACES).translate(LOWER)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(doc)
    split = [(doc, (text or "").split("\n")) for doc, text in docs]
    return [(d, x, [y for y in x if len(holders[key(y)]) < 3 or max(holders[key(y)]) == d]) for d, x in split]


def lines(docs):
    return [(d, len(x), len(x) - len(y), sha("\n".join(y))) for d, x, y in kept_lines(docs)]


def components(docs):
    sets = {}
    for doc, text in docs:
        w = words(text)
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return [(d, len(sets[d]), root(d)) for d, _ in docs]


def link_counts(docs):
    """(doc_id, number of other distinct sets that its set is linked with)."""
    sets = {}
    for doc, text in docs:
        w = words(text)
        sets[doc] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    kinds = set(sets.values())
    near = lambda x, y: x != y and len(x & y) and 100 * len(x & y) >= 75 * len(x | y)
    counts = {x: sum(bool(near(x, y)) for y in kinds) for x in kinds}
    return [(d, counts[sets[d]]) for d, _ in docs]


def crc(ids):
    import numpy as np

    return zlib.crc32(np.array(ids, "<u4").tobytes())
