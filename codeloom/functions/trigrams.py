"""Trigram queries derived from regular expressions, and block-wise trigram indexes over a text column.

A query is what every match of the expression must contain: nested ("and", ...) and ("or", ...) of trigrams, or
None where nothing is required.  An index of a block of rows has one posting list for each trigram of the queries; a query
is answered by intersecting and uniting posting lists, so that an expression only sees its candidate rows.
"""

from __future__ import annotations

import re
from re import _parser  # the standard library's own regular expression parser

import numpy as np
import pyarrow as pa

from codeloom.functions.blocks import text_bytes

Query = tuple | str | None


def _all(parts: list[Query]) -> Query:
    kept = list(dict.fromkeys(p for p in parts if p is not None))
    return kept[0] if len(kept) == 1 else ("and", *kept) if kept else None


def _any(parts: list[Query]) -> Query:
    if not parts or any(p is None for p in parts):
        return None
    kept = list(dict.fromkeys(parts))
    return kept[0] if len(kept) == 1 else ("or", *kept)


def _literals(text: str) -> Query:
    text = text.lower()
    return _all([text[i : i + 3] for i in range(len(text) - 2)]) if text.isascii() else None


def _strings(tree: object, limit: int = 64) -> list[str] | None:
    """All strings that a small tree of literals, sets, groups, branches and options matches, or None."""
    out = [""]
    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            more: list[str] | None = [chr(value)]
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in value):
            more = [chr(v) for _, v in value]
        elif name == "SUBPATTERN":
            more = _strings(value[-1], limit)
        elif name == "BRANCH":
            each = [_strings(b, limit) for b in value[1]]
            more = None if any(e is None for e in each) else [x for e in each for x in e]
        elif name == "MAX_REPEAT" and value[1] == 1:
            inner = _strings(value[2], limit)
            more = None if inner is None else (["", *inner] if value[0] == 0 else inner)
        else:
            return None
        if more is None or len(out) * len(more) > limit:
            return None
        out = [a + b for a in out for b in more]
    return out


def _of(tree: object) -> Query:
    parts: list[Query] = []
    runs = [""]  # the strings that the literals so far can be: small character sets are spelled out

    def close() -> None:
        nonlocal runs
        parts.append(_any([_literals(r) for r in runs]))
        runs = [""]

    for op, value in tree:
        name = str(op)
        spelled = _strings([(op, value)])
        if spelled is not None and len(spelled) * len(runs) <= 64:
            runs = [r + x for r in runs for x in spelled]
        elif name in ("AT", "ASSERT_NOT"):
            continue
        else:
            close()
            if name == "SUBPATTERN":
                parts.append(_of(value[-1]))
            elif name == "BRANCH":
                parts.append(_any([_of(b) for b in value[1]]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
                parts.append(_of(value[2]))
            elif name == "ATOMIC_GROUP":
                parts.append(_of(value))
            elif name == "ASSERT":
                parts.append(_of(value[1]))
    close()
    return _all(parts)


def required(pattern: re.Pattern[str]) -> Query:
    """The trigrams, in lower case, that any match of the pattern must have."""
    return _of(_parser.parse(pattern.pattern, pattern.flags & (re.I | re.M | re.S | re.X)))


def trigrams(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams(q) for q in query[1:]))


class TrigramIndex:
    """Posting lists of a fixed trigram vocabulary over the rows of a text column."""

    _tables: dict[frozenset[str], np.ndarray] = {}

    def __init__(self, column: pa.Array, vocabulary: frozenset[str]) -> None:
        table = self._tables.get(vocabulary)
        self.order = sorted(vocabulary)
        if table is None:
            table = np.full(1 << 21, -1, np.int16)  # three 7-bit characters
            for i, t in enumerate(self.order):
                a, b, c = t.encode()
                table[a << 14 | b << 7 | c] = i
            self._tables[vocabulary] = table
        data, offsets = text_bytes(column)
        self.rows = len(offsets) - 1
        low = _LOWER[data].astype(np.uint32)
        codes = low[:-2] << 14 | low[1:-1] << 7 | low[2:] if len(low) > 2 else low[:0]
        at = np.flatnonzero(table[codes] >= 0)
        row = np.searchsorted(offsets, at, side="right") - 1
        keep = at + 3 <= offsets[row + 1]
        key = np.unique(table[codes[at[keep]]].astype(np.int64) * self.rows + row[keep])
        term = key // max(self.rows, 1)
        self.edges = np.searchsorted(term, np.arange(len(self.order) + 1))
        self.postings = key % max(self.rows, 1)
        self.number = {t: i for i, t in enumerate(self.order)}

    def posting(self, trigram: str) -> np.ndarray:
        i = self.number[trigram]
        return self.postings[self.edges[i] : self.edges[i + 1]]

    def candidates(self, query: Query) -> np.ndarray:
        """Rows that a match of the query's expression can be in, ascending."""
        if query is None:
            return np.arange(self.rows)
        if isinstance(query, str):
            return self.posting(query)
        lists = [self.candidates(q) for q in query[1:]]
        if query[0] == "or":
            return np.unique(np.concatenate(lists))
        lists.sort(key=len)
        out = lists[0]
        for other in lists[1:]:
            if not len(out):
                break
            out = out[np.isin(out, other, assume_unique=True)]
        return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[128:] = 0  # other characters are in no trigram of the vocabulary
