"""Splitting text into the pieces that byte-level BPE merges separately.

The pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
is applied to many texts at once: every code point is looked up in a class
table (letter, number, white space, other), and a piece starts

* at the first character of a text;
* where the class changes, unless the character before is a blank, which then
  belongs to the piece;
* at the first and, if something else follows it, the last character of a run
  of white space.

The contractions are the only alternatives that depend on letters; they can
begin only at an apostrophe that starts a piece and stands alone, so just those
places are looked at one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: What may follow the apostrophe in the pattern's first alternatives.
SHORT = frozenset("stmd")
LONG = frozenset(("re", "ve", "ll"))

_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of each code point (built once in a process)."""
    global _classes
    if _classes is None:
        points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], dtype="<u4")
        every = points.tobytes().decode("utf-32-le")
        table = np.zeros(0x110000, dtype=np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, every):
                table[points[m.start():m.end()]] = kind
        _classes = table
    return _classes


def starts_of(whole: str, points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where pieces start in the texts of these lengths, laid end to end (not all empty)."""
    n = len(points)
    kind = classes()[points]
    ends = np.cumsum(lengths)
    firsts = (ends - lengths)[lengths > 0]
    lasts = ends[lengths > 0] - 1

    changes = np.ones(n, dtype=bool)
    changes[1:] = kind[1:] != kind[:-1]
    after_blank = np.zeros(n, dtype=bool)
    after_blank[1:] = points[:-1] == 32
    space = kind == SPACE
    before_other = np.zeros(n, dtype=bool)
    before_other[:-1] = ~space[1:]
    before_other[lasts] = False
    starts = np.where(space, changes | before_other, changes & ~after_blank)
    starts[firsts] = True

    quotes = np.flatnonzero(starts[:-1] & (points[:-1] == 39) & (kind[1:] == LETTER))
    if quotes.size:
        begins = np.zeros(n + 1, dtype=bool)
        begins[firsts] = True
        for i in quotes.tolist():
            if begins[i + 1]:
                continue
            if whole[i + 1] in SHORT:
                size = 2
            elif whole[i + 1:i + 3] in LONG and not begins[i + 2]:
                size = 3
            else:
                continue
            starts[i + 1] = False
            if i + size < n:
                starts[i + size] = True
    return starts


def places(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The texts laid end to end, their code points, the places where pieces start, and how many pieces each text has."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    whole = "".join(texts)
    if not whole:
        return "", np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    points = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")
    at = np.flatnonzero(starts_of(whole, points, lengths))
    ends = np.cumsum(lengths)
    return whole, points, at, np.searchsorted(at, ends) - np.searchsorted(at, ends - lengths)


def split(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The pieces of all texts in order, and how many each text has."""
    whole, _, at, per_text = places(texts)
    bounds = at.tolist()
    return [whole[a:b] for a, b in zip(bounds, [*bounds[1:], len(whole)])], per_text


def cut(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """As ``split``, with the pieces as one Arrow column over the texts' UTF-8 bytes."""
    whole, points, at, per_text = places(texts)
    data = whole.encode()
    if len(data) != len(whole):
        sizes = 1 + (points >= 0x80).view(np.int8) + (points >= 0x800) + (points >= 0x10000)
        at = (np.cumsum(sizes, dtype=np.int64) - sizes)[at]
    offsets = np.append(at, len(data))
    if not len(at):
        return pa.array([], pa.large_string()), per_text
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)), per_text
