"""Splitting texts into the pieces that byte-pair merges never cross, on whole blocks.

Equals a left-to-right scan with `public_tokenizers.PATTERN` (``spaced=True``: a piece takes one space before it,
other white space is a piece) or with the same pattern without white space and with one number character a piece
(``spaced=False``: white space is dropped).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

from impactframe.llm.textblock import Block

OTHER, LETTER, NUMBER, SPACE = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    table = np.zeros(0x110000, dtype=np.uint8)
    # A string for each code point would take more than 100 MB in every worker; surrogates are of no class.
    text = np.arange(len(table), dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            table[m.start() : m.end()] = kind
    return table


def classes_of(points: np.ndarray) -> np.ndarray:
    return _classes()[points]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte position and code point of every character of valid UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[at].astype(np.int32)
    for low, high, tail in ((0xC0, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0x100, 3)):
        chosen = np.flatnonzero((points >= low) & (points < high))
        if len(chosen):
            value = points[chosen] & (0x3F >> tail)
            for k in range(1, tail + 1):
                value = (value << 6) | (data[at[chosen] + k] & 0x3F)
            # Negative, so that the next round does not take it for a first byte.
            points[chosen] = -value
    return at, np.abs(points)


def pieces(block: Block, spaced: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and owners of all pieces."""
    at, points = code_points(block.data)
    n = len(at)
    if not n:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    kind = classes_of(points)
    first = np.zeros(n + 1, dtype=bool)
    first[np.searchsorted(at, block.bounds)] = True
    last = first[1:]  # the next character belongs to another text
    first = first[:-1]
    begins = first.copy()
    begins[1:] |= kind[1:] != kind[:-1]
    before_solid = np.zeros(n, dtype=bool)
    before_solid[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE)
    before_solid &= ~last
    if spaced:
        begins |= before_solid
        begins[np.flatnonzero(before_solid & (points == 32)) + 1] = False
    else:
        begins |= kind == NUMBER
    _contractions(points, kind, first, begins)
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], n)
    if not spaced:
        solid = kind[starts] != SPACE
        starts, ends = starts[solid], ends[solid]
    edge = np.append(at, len(block.data))
    starts, ends = edge[starts], edge[ends]
    return starts, ends, block.owner(starts)


def _contractions(points: np.ndarray, kind: np.ndarray, first: np.ndarray, begins: np.ndarray) -> None:
    """An apostrophe that begins a piece takes s, t, m, d, re, ve or ll after it."""
    n = len(points)
    marks = np.flatnonzero((points == ord("'")) & begins)
    marks = marks[marks + 1 < n]
    marks = marks[~first[marks + 1]]
    for ending in ("s", "t", "re", "ve", "m", "ll", "d"):
        size = len(ending)
        fits = marks[marks + size < n]
        for k, c in enumerate(ending, 1):
            fits = fits[(points[fits + k] == ord(c)) & ~first[fits + k]]
        begins[fits + 1] = False
        rest = fits + 1 + size
        begins[rest[rest < n]] = True
