"""Vectorised token boundaries for the engine's token rule.

A token is one match of ``[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]`` (TOKEN_RE).  The functions here work on
NumPy arrays of code points, a whole Arrow batch at a time: a class is looked up for every
character, and boundaries are the places where the class changes.  Nothing is matched row by row.
"""

from __future__ import annotations

import re

import numpy as np

TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
#: The same rule for Python's re: str patterns use Unicode classes.
TOKEN_RE = re.compile(r"\w+|[^\w\s]")
WORD_RE = re.compile(r"[^\W_]+")

SPACE, PUNCT, WORD = 0, 1, 2
_TABLE: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """One class for each code point: 0 white space, 1 single-character token, 2 word character."""
    global _TABLE
    if _TABLE is None:
        table = np.full(0x110000, PUNCT, np.uint8)
        chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for m in re.finditer(r"\w+", chars):
            a, b = ord(m[0][0]), ord(m[0][-1])
            table[a : b + 1] = WORD  # a run cannot cross the surrogate gap: neither side is a word character
        for m in re.finditer(r"\s+", chars):
            table[ord(m[0][0]) : ord(m[0][-1]) + 1] = SPACE
        _TABLE = table
    return _TABLE


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points, each text followed by one newline, and where each text starts.

    The result has one start more than there are texts.  A null counts as an empty text.
    """
    joined = "\n".join("" if t is None else t for t in texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((0 if t is None else len(t) for t in texts), np.int64, len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths + 1, out=starts[1:])
    return points, starts


def token_starts(points: np.ndarray) -> np.ndarray:
    """Positions at which a token starts."""
    kinds = char_classes()[points]
    begins = kinds == PUNCT
    words = kinds == WORD
    begins[1:] |= words[1:] & ~words[:-1]
    if len(points):
        begins[0] |= words[0]
    return np.flatnonzero(begins)


def token_ends(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The exclusive end of each token that starts at ``starts``."""
    words = char_classes()[points] == WORD
    stops = np.flatnonzero(~words)  # the first stop after a word's start ends it; a newline always follows
    ends = starts + 1
    inside = words[starts]
    ends[inside] = stops[np.searchsorted(stops, starts[inside])]
    return ends


def token_counts(texts: list[str | None]) -> np.ndarray:
    """Tokens of each text; 0 for a null or an empty text."""
    if not texts:
        return np.zeros(0, np.int64)
    points, starts = code_points(texts)
    begins = token_starts(points)
    return np.diff(np.searchsorted(begins, starts))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), for uint64 arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def token_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each token's code points, by prefix sums modulo 2**64.

    hash = sum(value(c) * odd**position) * odd**-start, then mixed with the length: the same token
    has the same hash wherever it stands.
    """
    with np.errstate(over="ignore"):
        n = len(points)
        base = np.uint64(0xD6E8FEB86659FD93)
        inverse = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
        powers = _powers(base, n)
        values = mix64(points.astype(np.uint64) + _MIX)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers, out=sums[1:])
        h = (sums[ends] - sums[starts]) * _powers(inverse, n)[starts]
        return mix64(h + (ends - starts).astype(np.uint64) * _MIX)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        have = _POWERS[int(base)] = np.cumprod(p, dtype=np.uint64)
    return have[:n]


_ASCII = None


def ascii_tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each ASCII byte (bytes from 128 on: class 3)."""
    global _ASCII
    if _ASCII is None:
        kinds = np.full(256, 3, np.uint8)
        kinds[:128] = char_classes()[:128]
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        _ASCII = kinds, lower
    return _ASCII


def column_token_counts(column) -> np.ndarray:
    """Tokens of each row of an Arrow string column; nulls count 0.

    ASCII rows are counted on the column's own bytes; rows with other characters by code points.
    """
    import pyarrow as pa

    from codeloom.functions.blocks import text_bytes

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.int64)
    data, offsets = text_bytes(column)
    kinds = ascii_tables()[0][data]
    begins = kinds == PUNCT
    words = kinds == WORD
    begins[1:] |= words[1:] & ~words[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]  # a row's first character starts a token even after a word in the row before
    begins[inner] |= words[inner]
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(begins, out=sums[1:])
    counts = sums[offsets[1:]] - sums[offsets[:-1]]
    other = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kinds == 3, out=other[1:])
    slow = np.flatnonzero(other[offsets[1:]] > other[offsets[:-1]])
    if len(slow):
        counts[slow] = token_counts(column.take(pa.array(slow)).to_pylist())
    if column.null_count:
        counts[np.asarray(column.is_null())] = 0
    return counts
