"""Evaluation passages that occur in training documents (problem 9).

Method: an FM-index per training shard.  The words of a shard's documents become one symbol sequence; its
Burrows-Wheeler transform lies in a wavelet tree; all test phrases are searched backwards at once by vectorised
ranks; occurrences are located by walking to sampled suffix positions; overlapping ones are merged to spans.

A phrase is ``run`` consecutive words.  Words that no item has can't lie in a shared phrase, so a shard's index holds
just the runs of at least ``run`` item words: that is exact, and all words of all documents are looked at.
The items are a bounded query set; larger sets are searched in blocks of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.blocks import blocks

RUN = 12
#: Words of items that one search holds; more are searched in further passes.
BLOCK_WORDS = 2_000_000
SHARD_BYTES = 1 << 23
SAMPLE = 8
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters or digits, lower-cased."""
    if not text:
        return []
    return _WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in _WORD.findall(text)]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling; the sequence must end with a unique smallest symbol or be treated as ending there."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    k = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] if k < n else 0
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate(([1], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if rank[order[-1]] == n or k >= n:
            return order
        k *= 2


class WaveletTree:
    """A wavelet matrix: one bit vector with prefix counts for each bit of the symbols, highest first."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            sums = np.zeros(len(symbols) + 1, np.int64)
            np.cumsum(bit, out=sums[1:])
            self.ones.append(sums)
            self.zeros.append(len(symbols) - int(sums[-1]))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low, high = np.zeros(len(at), np.int64), at.astype(np.int64)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.ones[level]
            bit = ((symbol >> b) & 1).astype(bool)
            low = np.where(bit, self.zeros[level] + ones[low], low - ones[low])
            high = np.where(bit, self.zeros[level] + ones[high], high - ones[high])
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each position."""
        at = at.astype(np.int64)
        out = np.zeros(len(at), np.int64)
        for level in range(self.bits):
            ones = self.ones[level]
            bit = ones[at + 1] - ones[at]
            out = out * 2 + bit
            at = np.where(bit == 1, self.zeros[level] + ones[at], at - ones[at])
        return out


class FMIndex:
    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE) -> None:
        """``symbols`` are at least 1; 0 is appended as the end."""
        s = np.append(symbols, 0)
        order = suffix_array(s)
        bwt = s[order - 1]
        self.tree = WaveletTree(bwt, max(1, int(s.max()).bit_length()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(s))))
        self.sampled = order % sample == 0
        self.values = order[self.sampled]
        self.places = np.cumsum(self.sampled) - 1

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of each phrase (one per row)."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.before[-1], np.int64)
        live = np.arange(len(phrases))
        for c in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, c]
            base = self.before[symbol]
            a, b = base + self.tree.rank(symbol, low[live]), base + self.tree.rank(symbol, high[live])
            low[live], high[live] = a, b
            live = live[a < b]
            if not len(live):
                break
        empty = np.ones(len(phrases), bool)
        empty[live] = False
        high[empty] = low[empty]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks, by walking backwards to a sampled one."""
        rows = rows.copy()
        steps = np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.sampled[rows])
        while len(walking):
            at = rows[walking]
            symbol = self.tree.access(at)
            rows[walking] = self.before[symbol] + self.tree.rank(symbol, at)
            steps[walking] += 1
            walking = walking[~self.sampled[rows[walking]]]
        return self.values[self.places[rows]] + steps


class Phrases:
    """The distinct phrases of a block of items, as symbols, and which items have each."""

    def __init__(self, items: list[tuple[int, str]], run: int) -> None:
        self.run = run
        self.symbol: dict[str, int] = {}
        table: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            s = [self.symbol.setdefault(w, len(self.symbol) + 1) for w in words_of(text)]
            for i in range(len(s) - run + 1):
                table.setdefault(tuple(s[i : i + run]), set()).add(item)
        self.phrases = np.array(list(table), np.int64).reshape(-1, run)
        self.items = [sorted(v) for v in table.values()]

    def spans(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(row, item, first word, words) of every merged span that a text shares with an item."""
        if not len(self.phrases):
            return []
        symbols, rows, offsets = [], [], []
        end = len(self.symbol) + 1  # between runs: no phrase has it
        get = self.symbol.get
        for r, text in enumerate(texts):
            ids = np.fromiter((get(w, 0) for w in words_of(text)), np.int64)
            if len(ids) < self.run:
                continue
            edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).astype(np.int8), [0]))))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if b - a >= self.run:
                    symbols.append(np.append(ids[a:b], end))
                    rows.append(np.full(b - a + 1, r))
                    offsets.append(np.arange(a, b + 1))
        if not symbols:
            return []
        held = np.concatenate(symbols)
        present = np.zeros(end + 1, bool)
        present[held] = True
        asked = np.flatnonzero(present[self.phrases].all(axis=1))  # a phrase with a word that the shard lacks isn't in it
        if not len(asked):
            return []
        index = FMIndex(held)
        row, offset = np.concatenate(rows), np.concatenate(offsets)
        low, high = (np.zeros(len(self.phrases), np.int64) for _ in range(2))
        low[asked], high[asked] = index.search(self.phrases[asked])
        hit = np.flatnonzero(high > low)
        count = (high - low)[hit]
        ranks = np.repeat(low[hit], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        at = index.locate(ranks)
        found = sorted((int(row[p]), item, int(offset[p])) for p, k in zip(at.tolist(), np.repeat(hit, count).tolist()) for item in self.items[k])
        out: list[tuple[int, int, int, int]] = []
        for r, item, first in found:
            if out and out[-1][:2] == (r, item) and first <= out[-1][2] + out[-1][3]:
                out[-1] = (r, item, out[-1][2], first + self.run - out[-1][2])
            else:
                out.append((r, item, first, self.run))
        return out


def _item_blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most about ``limit`` words, fetched one block at a time."""
    rows = items.select("item_id", "text").where("item_id is not null and text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-int(total) // (4 * limit)))
    for part in range(parts):
        yield [(r[0], r[1]) for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).distinct().collect()]


def leaked_spans(documents: DataFrame, items: DataFrame, run: int = RUN, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, first_word, words) of every span of at least ``run`` words that a document shares with an item.

    Spans of one item that touch or overlap are merged.  Input: doc_id, text; item_id, text.  Null or short texts share nothing;
    rows without an id are left out; a row delivered twice counts once; item ids may repeat with different texts.
    """
    schema = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("first_word", T.IntegerType()), T.StructField("words", T.IntegerType())])
    item_type = pa.int32() if isinstance(schema["item_id"].dataType, T.IntegerType) else pa.int64()
    rows = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * run - 1))
    parts = []
    for block_items in _item_blocks(items, block_words):
        shared = documents.sparkSession.sparkContext.broadcast(Phrases(block_items, run))  # at most block_words phrases

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for shard in blocks(batches, "text", SHARD_BYTES):
                spans = shared.value.spans(shard.column("text").to_pylist())
                ids = shard.column("doc_id").take(pa.array([s[0] for s in spans], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([s[1] for s in spans], item_type), pa.array([s[2] for s in spans], pa.int32()), pa.array([s[3] for s in spans], pa.int32())], ["doc_id", "item_id", "first_word", "words"])

        parts.append(rows.mapInArrow(search, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, item_id) of every document that shares a phrase with an item, each once."""
    return leaked_spans(documents, items, run).select("doc_id", "item_id").distinct()
