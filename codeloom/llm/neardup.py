"""Near-duplicate texts: every pair whose n-gram sets reach a Jaccard similarity (problem 5).

Method: vertical partitioning of the global n-gram order.

1. A fixed-size sketch of token and n-gram frequencies over all rows gives every n-gram a place in one global order, rare
   first (any global order is exact; a good one meets few pairs).
2. The order is cut into ranges, the fragments.  Two sets that reach the threshold share a gram of both pigeonhole prefixes, so
   the prefixes alone are sent to the fragments; each counts the partial overlaps of the pairs that meet in it, and the sums
   per pair, with the most that can still follow, leave the candidates.
3. For candidates the whole sets are cut into segments, ranges of the same order.  Partial overlaps are counted segment by
   segment, rare ones first, and summed per pair; a pair is dropped as soon as its sum and the most that the segments to come can
   add miss the required overlap.  The sum over all segments is the exact overlap: no text is compared.

Texts with equal token sequences share one signature and are one record in all of this, so that any number of
copies costs one; membership brings them back.  No pair of copies is ever formed before the end.

Skew: a gram that more than HOT_MEMBERS texts may have is split over salts by signature; pairs within a salt and pairs between two salts
are counted by different tasks.  A record with many partners is sent once to each block of pairs, not once to each partner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.blocks import blocks
from codeloom.functions.tokens import code_points, mix64, token_ends, token_hashes, token_starts
from codeloom.session import written

THRESHOLD = 0.7
NGRAM = 3
MIN_TOKENS = 40
#: Counters of the frequency sketch, for tokens and for n-grams: its size doesn't depend on the data.
TOKEN_SKETCH, GRAM_SKETCH = 1 << 18, 1 << 20
SLICE = 1 << 16
SLICES = (TOKEN_SKETCH + GRAM_SKETCH) // SLICE
#: Prefix grams that a fragment holds, about.
FRAGMENT_GRAMS = 250_000
#: Prefix grams that are gathered before they are packed by fragment.
PACKED_GRAMS = 500_000
#: Texts, and grams of each, of the sample that places the cuts of the order.  It balances tasks; results don't depend on it.
SAMPLE_TEXTS, SAMPLE_GRAMS = 4096, 256
#: Texts that may share a gram before it is split over salts, and sightings in the sample from which that is estimated.
HOT_MEMBERS, HOT_SEEN = 20_000, 8
#: Segments of the order in which candidates' overlaps are counted.
SEGMENTS = 8
#: Candidate pairs up to which the choice of their texts is broadcast.
SMALL_PAIRS = 100_000
#: Grams of the pairs that one block of candidates holds, about.
BLOCK_GRAMS = 4_000_000
_GRAM_BITS = 56
#: Members of one class from which its pairs are spread.
SALT_MEMBERS = 1000


def required(size_sum: np.ndarray, threshold: float) -> np.ndarray:
    """The smallest overlap at which two sets of this total size reach the threshold."""
    return np.ceil(threshold / (1 + threshold) * size_sum - 1e-9).astype(np.int64)


def prefix_length(sizes: np.ndarray, threshold: float) -> np.ndarray:
    return sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1


def token_slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(TOKEN_SKETCH - 1)).astype(np.int64)


def gram_slot(grams: np.ndarray) -> np.ndarray:
    return ((grams >> np.uint64(8)) & np.uint64(GRAM_SKETCH - 1)).astype(np.int64) + TOKEN_SKETCH


class Grams:
    """Token and n-gram arrays of a block of texts."""

    def __init__(self, texts: list[str | None], ngram: int) -> None:
        points, offsets = code_points([None if t is None else t.lower() for t in texts])
        starts = token_starts(points)
        self.hashes = token_hashes(points, starts, token_ends(points, starts))
        self.bounds = np.searchsorted(starts, offsets)
        self.tokens = np.diff(self.bounds)
        self.row = np.repeat(np.arange(len(texts)), self.tokens)
        self.ngram = ngram

    def signatures(self) -> np.ndarray:
        """One 64-bit value for each text's token sequence."""
        with np.errstate(over="ignore"):
            place = np.arange(len(self.hashes), dtype=np.uint64) - np.repeat(self.bounds[:-1], self.tokens).astype(np.uint64)
            mixed = mix64(self.hashes + mix64(place))
            sums = np.zeros(len(mixed) + 1, np.uint64)
            np.cumsum(mixed, out=sums[1:])
            return mix64(sums[self.bounds[1:]] - sums[self.bounds[:-1]] + self.tokens.astype(np.uint64)).view(np.int64)

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, gram, index of its first token) of each run of ``ngram`` tokens within one text."""
        n, k = len(self.hashes), self.ngram
        if n < k:
            return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        with np.errstate(over="ignore"):
            g = self.hashes[: n - k + 1]
            for i in range(1, k):
                g = mix64(g + self.hashes[i : n - k + 1 + i] * np.uint64(2 * i + 1))
        at = np.flatnonzero(self.row[k - 1 :] == self.row[: n - k + 1])
        return self.row[at], g[at], at


def _scan(texts: DataFrame, key: str, text: str, ngram: int, min_tokens: int) -> DataFrame:
    """One row per eligible text (key, sig, tokens), and rows of the token frequency sketch (slice, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(TOKEN_SKETCH + GRAM_SKETCH, np.int64)
        for block in blocks(batches, text):
            g = Grams(block.column(text).to_pylist(), ngram)
            fit = g.tokens >= max(min_tokens, ngram)
            row, gram, _ = g.grams()
            counts[:TOKEN_SKETCH] += np.bincount(token_slot(g.hashes[fit[g.row]]), minlength=TOKEN_SKETCH)
            counts += np.bincount(gram_slot(gram[fit[row]]), minlength=len(counts))
            at = np.flatnonzero(fit)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [block.column(key).take(pa.array(at)).cast(pa.int64()), pa.array(g.signatures()[at]), pa.array(g.tokens[at], pa.int32()), pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary())],
                    ["key", "sig", "tokens", "slice", "counts"],
                )
        parts = [x.tobytes() for x in np.split(counts.astype(np.uint32), SLICES)]
        yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int32()), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["key", "sig", "tokens", "slice", "counts"])

    return texts.select(key, text).mapInArrow(run, "key bigint, sig bigint, tokens int, slice int, counts binary")


def _sketch(scanned: DataFrame) -> np.ndarray:
    """The summed sketch, as 8 times the logarithm of each counter: one byte a counter, whatever the data."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for s, raw in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist()):
                sums[s] = sums.get(s, 0) + np.frombuffer(raw, np.uint32).astype(np.int64)
        if sums:
            logs = [np.minimum(255, np.log2(x + 1) * 8).astype(np.uint8).tobytes() for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(logs, pa.binary())], ["slice", "logs"])

    logs = np.zeros(TOKEN_SKETCH + GRAM_SKETCH, np.uint8)
    partial = scanned.where("slice is not null").select("slice", "counts").repartition(SLICES, "slice")
    for r in partial.mapInArrow(add, "slice int, logs binary").collect():  # SLICES rows of fixed size
        logs[r.slice * SLICE : (r.slice + 1) * SLICE] = np.frombuffer(r.logs, np.uint8)
    return logs


def _ordered(texts: list[str | None], rank: np.ndarray, ngram: int, min_tokens: int) -> tuple[np.ndarray, ...]:
    """(signatures, row, place in the global order) of a block: each eligible text's distinct grams, in order.

    A gram's place is its rarity in the high byte and its hash below: one 64-bit number that names the gram as well.  Copies
    within the block count once.
    """
    g = Grams(texts, ngram)
    sigs = g.signatures()
    first = np.zeros(len(sigs), bool)
    first[np.unique(sigs, return_index=True)[1]] = True
    fit = first & (g.tokens >= max(min_tokens, ngram))
    row, gram, at = g.grams()
    keep = fit[row]
    row, gram, at = row[keep], gram[keep], at[keep]
    words = sum(rank[token_slot(g.hashes[at + i])].astype(np.int32) for i in range(ngram))
    weight = np.minimum(255, rank[gram_slot(gram)].astype(np.int32) + np.minimum(90, words * 3 // 20)).astype(np.uint64)
    place = weight << np.uint64(_GRAM_BITS) | gram & np.uint64((1 << _GRAM_BITS) - 1)
    order = np.argsort(place)
    order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]  # a block has at most 2**15 rows
    row, place = row[order], place[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
    return sigs, row[new], place[new]


def _sample(texts: DataFrame, key: str, text: str, rank: np.ndarray, members: int, ngram: int, min_tokens: int, threshold: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Places of prefix grams and of all grams in a bounded sample of the texts, and the share of texts that is in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            sigs, row, place = _ordered(block.column(text).to_pylist(), rank, ngram, min_tokens)
            edges = np.searchsorted(row, np.arange(len(sigs) + 1))
            size = np.diff(edges)
            lead = prefix_length(size, threshold)

            def thin(a: int, n: int) -> np.ndarray:
                return place[a : a + n][:: max(1, -(-n // SAMPLE_GRAMS))]

            some = np.flatnonzero(size)
            each = [(thin(edges[i], lead[i]).tobytes(), thin(edges[i], size[i]).tobytes()) for i in some]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in each], pa.binary()) for k in (0, 1)], ["lead", "whole"])

    every = max(1, -(-members // SAMPLE_TEXTS))
    rows = texts.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).select(text).mapInArrow(run, "lead binary, whole binary").collect()  # about SAMPLE_TEXTS rows
    lead, whole = (np.sort(np.frombuffer(b"".join(r[k] for r in rows), np.uint64)) for k in (0, 1))
    return lead, whole, 1 / every


def _quantiles(ordered: np.ndarray, parts: int) -> np.ndarray:
    """At most ``parts - 1`` distinct cuts that divide sorted values evenly."""
    return np.unique(ordered[(np.arange(1, parts) * len(ordered)) // parts]) if len(ordered) else ordered


class Cuts:
    """The fragments: ranges of the order between ``at``; grams in ``hot`` have ``salts`` fragments each, after the ranges."""

    def __init__(self, lead: np.ndarray, share: float, grams: float) -> None:
        self.at = _quantiles(lead, max(1, -(-int(grams) // FRAGMENT_GRAMS)))
        values, seen = np.unique(lead, return_counts=True)
        often = (seen >= HOT_SEEN) & (seen > HOT_MEMBERS * share)
        self.hot = values[often]
        self.salts = np.ceil(seen[often] / (share * HOT_MEMBERS)).astype(np.int64)
        self.ranges = len(self.at) + 1
        self.bases = self.ranges + np.cumsum(self.salts) - self.salts
        self.count = self.ranges + int(self.salts.sum())

    def fragment(self, place: np.ndarray, sig: np.ndarray) -> np.ndarray:
        out = np.searchsorted(self.at, place, side="right")
        if len(self.hot):
            i = np.minimum(np.searchsorted(self.hot, place), len(self.hot) - 1)
            salted = np.flatnonzero(self.hot[i] == place)
            i = i[salted]
            out[salted] = self.bases[i] + (mix64(sig[salted].view(np.uint64)) % self.salts[i].astype(np.uint64)).astype(np.int64)
        return out


def _fragments(texts: DataFrame, text: str, rank: np.ndarray, cuts: Cuts, ngram: int, min_tokens: int, threshold: float) -> DataFrame:
    """Packed prefix grams: one row per task's share of a fragment, arrays of (gram, sig, size, position)."""

    def packed(waiting: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        gram, sig, size, place = (np.concatenate(x) for x in zip(*waiting))
        part = cuts.fragment(gram, sig)
        order = np.argsort(part, kind="stable")
        names, first = np.unique(part[order], return_index=True)
        gram, sig, size, place = gram[order], sig[order], size[order].astype(np.int32), place[order].astype(np.int32)
        edges = [*first.tolist(), len(order)]
        blobs = [_pack(gram[a:b], sig[a:b], size[a:b], place[a:b]) for a, b in zip(edges, edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["fragment", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []
        for block in blocks(batches, text):
            sigs, row, gram = _ordered(block.column(text).to_pylist(), rank, ngram, min_tokens)
            sizes = np.bincount(row, minlength=len(sigs))
            place = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
            keep = place < prefix_length(sizes, threshold)[row]
            row = row[keep]
            waiting.append((gram[keep], sigs[row], sizes[row], place[keep]))
            if sum(len(w[0]) for w in waiting) > PACKED_GRAMS:
                yield packed(waiting)
                waiting = []
        if sum(len(w[0]) for w in waiting):
            yield packed(waiting)

    return texts.select(text).mapInArrow(run, "fragment bigint, packed binary")


def _pack(gram: np.ndarray, sig: np.ndarray, size: np.ndarray, place: np.ndarray) -> bytes:
    return b"".join((gram.tobytes(), sig.tobytes(), size.astype(np.int32).tobytes(), place.astype(np.int32).tobytes()))


def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Grams in order; within one gram by size; copies that came from several blocks once."""
    out: tuple[list, ...] = ([], [], [], [])
    for b in blobs:
        n, at = len(b) // 24, 0
        for k, kind in enumerate((np.uint64, np.int64, np.int32, np.int32)):
            size = n * np.dtype(kind).itemsize
            out[k].append(np.frombuffer(b[at : at + size], kind))
            at += size
    gram, sig, size, place = (np.concatenate(x) for x in out)
    order = np.lexsort((sig, size, gram))
    gram, sig, size, place = gram[order], sig[order], size[order].astype(np.int64), place[order].astype(np.int64)
    keep = np.ones(len(gram), bool)
    keep[1:] = (gram[1:] != gram[:-1]) | (sig[1:] != sig[:-1])
    return gram[keep], sig[keep], size[keep], place[keep]


class _Partial:
    """Partial overlaps of the pairs that meet: how often, and the least that can still follow; folded now and then."""

    SCHEMA = "sig_a bigint, sig_b bigint, shared int, rest int, need int"

    def __init__(self, threshold: float) -> None:
        self.threshold, self.found, self.pending = threshold, [], 0

    def add(self, sig: np.ndarray, size: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        rest = np.minimum(size[i] - place[i] - 1, size[j] - place[j] - 1)
        need = required(size[i] + size[j], self.threshold)
        fits = np.minimum(place[i], place[j]) + 1 + rest >= need
        i, j, rest, need = i[fits], j[fits], rest[fits], need[fits]
        # of the prefix that ends first, every gram has been counted or is not shared
        rest = np.minimum(rest, np.maximum(size[i] - prefix_length(size[i], self.threshold), size[j] - prefix_length(size[j], self.threshold)))
        if len(i):
            self.found.append((np.minimum(sig[i], sig[j]), np.maximum(sig[i], sig[j]), np.ones(len(i), np.int64), rest, need))
            self.pending += len(i)
            if self.pending > 4_000_000:
                self.fold()

    def fold(self) -> None:
        a, b, n, rest, need = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((b, a))
        a, b, n, rest, need = a[order], b[order], n[order], rest[order], need[order]
        cut = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        self.found = [(a[cut], b[cut], np.add.reduceat(n, cut), np.minimum.reduceat(rest, cut), need[cut])]
        self.pending = 0

    def batch(self) -> pa.RecordBatch:
        if self.found:
            self.fold()
        columns = self.found[0] if self.found else [np.zeros(0, np.int64)] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.int32()) for k, c in enumerate(columns)], ["sig_a", "sig_b", "shared", "rest", "need"])


def _partial_overlaps(packed: DataFrame, cuts: Cuts, threshold: float) -> DataFrame:
    """The partial overlaps within each fragment."""

    def run(t: pa.Table) -> pa.Table:
        gram, sig, size, place = _unpack(t.column("packed").to_pylist())
        out = _Partial(threshold)
        # within one gram, rows are sorted by size: the partners at distance k of all grams at once
        live = np.arange(len(gram))
        k = 0
        while len(live):
            k += 1
            live = live[live + k < len(gram)]
            live = live[gram[live + k] == gram[live]]
            live = live[size[live] >= threshold * size[live + k] - 1e-9]  # sizes only grow with k
            out.add(sig, size, place, live, live + k)
        return pa.Table.from_batches([out.batch()])

    return packed.repartition(max(cuts.count, 1), "fragment").groupBy("fragment").applyInArrow(run, _Partial.SCHEMA)


def _between_salts(packed: DataFrame, cuts: Cuts, threshold: float) -> DataFrame:
    """The partial overlaps between two salts of one hot gram: each pair of salts is one row, and rows are spread over tasks."""

    def merge(t: pa.Table) -> pa.Table:
        gram, sig, size, place = _unpack(t.column("packed").to_pylist())
        return pa.table({"fragment": t.column("fragment").slice(0, 1).cast(pa.int64()), "gram": pa.array(gram[:1].view(np.int64)), "least": pa.array([int(size[0])], pa.int64()), "most": pa.array([int(size[-1])], pa.int64()), "packed": pa.array([_pack(gram, sig, size, place)], pa.binary())})

    hot = packed.where(F.col("fragment") >= cuts.ranges).groupBy("fragment").applyInArrow(merge, "fragment bigint, gram bigint, least bigint, most bigint, packed binary")
    hot = written(hot, "neardup-hot")
    a, b = (hot.select("gram", *(F.col(c).alias(f"{c}_{x}") for c in ("fragment", "least", "most", "packed"))) for x in "ab")
    fits = (F.col("most_b") >= threshold * F.col("least_a") - 1e-9) & (F.col("most_a") >= threshold * F.col("least_b") - 1e-9)
    both = a.join(b, "gram").where((F.col("fragment_a") < F.col("fragment_b")) & fits).select("fragment_a", "fragment_b", "packed_a", "packed_b")

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("packed_a").to_pylist(), batch.column("packed_b").to_pylist()):
                left, right = _unpack([x]), _unpack([y])
                sig, size, place = (np.concatenate((left[k], right[k])) for k in (1, 2, 3))
                out, n, other = _Partial(threshold), len(left[0]), right[2]
                # partners of each left row: the right rows whose size fits
                low = np.searchsorted(other, np.ceil(threshold * left[2] - 1e-9))
                high = np.searchsorted(other, np.floor(left[2] / threshold + 1e-9), side="right")
                at, step = 0, max(1, 2_000_000 // max(1, len(other)))
                while at < n:
                    rows = np.arange(at, min(n, at + step))
                    count = np.maximum(high[rows] - low[rows], 0)
                    i = np.repeat(rows, count)
                    out.add(sig, size, place, i, n + low[i] + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count))
                    at += step
                yield out.batch()

    return both.repartition(max(1, cuts.count - cuts.ranges), "fragment_a", "fragment_b").mapInArrow(cross, _Partial.SCHEMA)


def overlaps(left: np.ndarray, right: np.ndarray, grams: np.ndarray, edges: np.ndarray, need: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """The overlap of each pair of records (0 where it misses ``need``), summed over segments of the order.

    ``grams[edges[r] : edges[r + 1]]`` are record r's places in order; ``segments`` are the cuts between segments.
    """
    records = len(edges) - 1
    owner = np.repeat(np.arange(records), np.diff(edges))
    segment = np.searchsorted(segments, grams, side="right")
    counts = np.bincount(owner * (len(segments) + 1) + segment, minlength=records * (len(segments) + 1)).reshape(records, -1)
    starts = edges[:-1, None] + np.cumsum(counts, axis=1) - counts
    with np.errstate(over="ignore"):
        name = mix64(grams + mix64(owner.astype(np.uint64)))  # a gram of a record
    known = np.sort(name)
    bound = np.minimum(counts[left], counts[right])  # the most that each segment can add
    rest = bound.sum(axis=1)
    total = np.zeros(len(left), np.int64)
    live = np.flatnonzero(rest >= need)
    for s in range(len(segments) + 1):
        rest[live] -= bound[live, s]
        at = 0
        n = counts[left[live], s]
        ends = np.cumsum(n)
        while at < len(live):  # in slices of bounded size
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2_000_000, side="right")))
            pairs, m = live[at:to], n[at:to]
            k = np.repeat(np.arange(len(pairs)), m)
            g = grams[starts[left[pairs], s][k] + np.arange(len(k)) - np.repeat(np.cumsum(m) - m, m)]
            with np.errstate(over="ignore"):
                asked = mix64(g + mix64(right[pairs][k].astype(np.uint64)))
            hit = known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked
            total[pairs] += np.bincount(k[hit], minlength=len(pairs))
            at = to
        live = live[total[live] + rest[live] >= need[live]]
    out = np.zeros(len(left), np.int64)
    out[live] = total[live]
    return out


def _summed(pairs: DataFrame, texts: DataFrame, key: str, text: str, members: DataFrame, rank: np.ndarray, count: int, mass: int, segments: np.ndarray, ngram: int, min_tokens: int, threshold: float) -> DataFrame:
    """Pairs whose overlap, summed over all segments, reaches the threshold.  ``count``: pairs, ``mass``: grams that they need together.

    Pairs lie in a grid of blocks by the hashes of both signatures; one text of each signature is cut into grams, which are sent
    once to each block that has a pair of it.
    """
    side = max(1, int(np.ceil(np.sqrt(2 * mass / BLOCK_GRAMS))))
    keyed = pairs.withColumn("block", (F.pmod(F.xxhash64("sig_a"), F.lit(side)) * side + F.pmod(F.xxhash64("sig_b"), F.lit(side))).cast("bigint"))
    wanted = keyed.select(F.col("sig_a").alias("sig"), F.col("block").alias("cell")).union(keyed.select("sig_b", "block")).groupBy("sig").agg(F.collect_set("cell").alias("cells"))  # at most 2 * side
    chosen = members.join(wanted.select("sig"), "sig", "left_semi").groupBy("sig").agg(F.min("key").alias("key")).join(wanted, "sig").select("key", "cells")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            sigs, row, place = _ordered(block.column("text").to_pylist(), rank, ngram, min_tokens)
            edges = np.searchsorted(row, np.arange(len(sigs) + 1))
            cells = block.column("cells").to_pylist()
            out = [(c, int(sigs[i]), place[edges[i] : edges[i + 1]].tobytes()) for i in np.flatnonzero(np.diff(edges)).tolist() for c in cells[i]]
            columns = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["cell", "sig", "grams"])

    if count <= SMALL_PAIRS:  # at most twice as many rows of a few numbers; beyond that, Spark's own choice of join
        chosen = F.broadcast(chosen)
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).join(chosen, "key").select("text", "cells")
    sent = rows.mapInArrow(cut, "cell bigint, sig bigint, grams binary")

    def run(p: pa.Table, r: pa.Table) -> pa.Table:
        sig, first = np.unique(r.column("sig").to_numpy(), return_index=True)  # a row delivered twice counts once
        raw = r.column("grams").take(pa.array(first)).to_pylist()
        edges = np.concatenate(([0], np.cumsum([len(x) // 8 for x in raw], dtype=np.int64)))
        grams = np.frombuffer(b"".join(raw), np.uint64)
        a, b = p.column("sig_a").to_numpy(), p.column("sig_b").to_numpy()
        x, y = np.searchsorted(sig, a), np.searchsorted(sig, b)
        size = np.diff(edges)
        both = size[x] + size[y]
        shared = overlaps(x, y, grams, edges, required(both, threshold), segments)
        keep = np.flatnonzero(shared)
        return pa.table({"sig_a": pa.array(a[keep]), "sig_b": pa.array(b[keep]), "similarity": pa.array(shared[keep] / (both - shared)[keep])})

    return keyed.repartition(side * side, "block").groupBy("block").cogroup(sent.repartition(side * side, "cell").groupBy("cell")).applyInArrow(run, "sig_a bigint, sig_b bigint, similarity double")


def similar_texts(texts: DataFrame, key: str, text: str, threshold: float = THRESHOLD, ngram: int = NGRAM, min_tokens: int = MIN_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(members, links): the signature class of every eligible text, and all pairs of classes that are similar.

    ``members`` has key, sig, tokens; ``links`` has sig_a < sig_b and similarity.  Texts of one class have equal
    token sequences (lower-cased).  ``key`` must identify a text; rows with a null key are left out, a null or
    short text (fewer than ``min_tokens`` tokens) is in no class, and a row delivered twice counts once.
    """
    texts = texts.where(F.col(key).isNotNull()).select(key, text)
    scanned = written(_scan(texts, key, text, ngram, min_tokens), "neardup-scan")
    members = scanned.where("slice is null").select("key", "sig", "tokens")
    rank = _sketch(scanned)
    total, count = members.agg(F.sum("tokens"), F.count("*")).first()
    lead, whole, share = _sample(texts, key, text, rank, count, ngram, min_tokens, threshold)
    cuts = Cuts(lead, share, (total or 0) * (1 - threshold))
    packed = _fragments(texts, text, rank, cuts, ngram, min_tokens, threshold)
    if len(cuts.hot):
        packed = written(packed, "neardup-packed")
    partial = _partial_overlaps(packed, cuts, threshold)
    if len(cuts.hot):
        partial = partial.unionByName(_between_salts(packed, cuts, threshold))
    # all common grams up to the last one that met are counted; beyond it, at most "rest" can follow
    summed = partial.groupBy("sig_a", "sig_b").agg(F.sum("shared").alias("shared"), F.min("rest").alias("rest"), F.max("need").alias("need"))
    pairs = written(summed.where("shared + rest >= need").select("sig_a", "sig_b", "need"), "neardup-pairs")
    found, mass = pairs.agg(F.count("*"), F.sum("need")).first()
    links = _summed(pairs.drop("need"), texts, key, text, members, rank, found, int(mass or 0), _quantiles(whole, SEGMENTS), ngram, min_tokens, threshold)
    return members.dropDuplicates(["key", "sig"]), links


_PLACE = ("repo_id", "file_path", "start_line", "end_line")
_SAME_LINES = "repo_id_a = repo_id_b and file_path_a = file_path_b and start_line_a <= end_line_b and start_line_b <= end_line_a"


def _classes(chunks: DataFrame, threshold: float, ngram: int, min_tokens: int) -> tuple[DataFrame, DataFrame]:
    """(placed, links): members of classes that are linked or hold copies, with their place and class size; and all links.

    A class of several members has a link to itself.
    """
    defs = chunks.where(F.col("qualified_name").isNotNull() & (F.col("total_parts") == 1) & F.col("content").isNotNull() & (F.length("content") >= min_tokens))
    members, links = similar_texts(defs, "chunk_id", "content", threshold, ngram, min_tokens)
    members = written(members, "neardup-members")
    sizes = members.groupBy("sig").agg(F.count("*").alias("members"))
    same = sizes.where("members > 1").select(F.col("sig").alias("sig_a"), F.col("sig").alias("sig_b"), F.lit(1.0).alias("similarity"))
    links = written(links.unionByName(same), "neardup-links")
    involved = links.select(F.col("sig_a").alias("sig")).union(links.select("sig_b")).distinct()
    place = defs.select(F.col("chunk_id").alias("key"), *_PLACE)
    placed = members.select("key", "sig").join(involved, "sig", "left_semi").join(sizes, "sig").join(place, "key").dropDuplicates(["key"])
    return placed, links


def similar_definitions(chunks: DataFrame, threshold: float = THRESHOLD, ngram: int = NGRAM, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """All pairs of similar definitions: chunk_id_a < chunk_id_b, similarity.

    Definitions are chunks with a qualified_name and total_parts = 1.  Pairs whose lines overlap in one file (a
    class and its own method) are left out; a null file_path, repo_id or line number overlaps with nothing.
    Empty tables give no rows.
    """
    placed, links = _classes(chunks, threshold, ngram, min_tokens)
    # both sides of a link are cut into salts of SALT_MEMBERS members: the pairs of two classes are a grid of bounded cells
    placed = placed.withColumn("salts", F.ceil(F.col("members") / SALT_MEMBERS).cast("int"))
    placed = written(placed.withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int")), "neardup-placed")
    salts = placed.select("sig", "salts").distinct()
    grid = links.join(salts.select(F.col("sig").alias("sig_a"), F.col("salts").alias("n_a")), "sig_a").join(salts.select(F.col("sig").alias("sig_b"), F.col("salts").alias("n_b")), "sig_b")
    grid = grid.withColumn("salt_a", F.explode(F.sequence(F.lit(0), F.col("n_a") - 1))).withColumn("salt_b", F.explode(F.sequence(F.lit(0), F.col("n_b") - 1)))
    a, b = (placed.select(*(F.col(c).alias(f"{c}_{x}") for c in ("key", "sig", "salt", *_PLACE))) for x in "ab")
    both = grid.select("sig_a", "sig_b", "salt_a", "salt_b", "similarity").join(a, ["sig_a", "salt_a"]).join(b, ["sig_b", "salt_b"]).where("sig_a <> sig_b or key_a < key_b")
    return both.where(~F.coalesce(F.expr(_SAME_LINES), F.lit(False))).select(F.least("key_a", "key_b").alias("chunk_id_a"), F.greatest("key_a", "key_b").alias("chunk_id_b"), "similarity")


def components(edges: DataFrame, left: str, right: str, rounds: int | None = None) -> DataFrame:
    """(node, component) of an undirected graph: the smallest node that each node is joined with.

    Large-star/small-star contraction: every round is two shuffles of the edges, the number of rounds is
    about the logarithm of the longest chain, and each round is written to the shared folder.  It goes on until
    nothing changes; with ``rounds``, labels that are not final by then are an error.
    """
    e = written(edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v"), "cc")
    done = 0
    while True:
        if done == rounds:
            raise RuntimeError(f"components are not final after {rounds} rounds")
        done += 1
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = written(small, "cc")
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            break
        e = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def definition_groups(chunks: DataFrame, threshold: float = THRESHOLD, ngram: int = NGRAM, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(chunk_id, group_id, links): the group of every definition that has a similar one, and its number of links.

    The groups are the components of the pairs of ``similar_definitions``; they are found on links between classes and membership,
    no pair of copies is formed.  A class counts as one node: its members are linked with each other, unless all of them
    overlap in one file, and then they have the same other links.  ``group_id`` is the least chunk_id of the group.
    """
    placed, links = _classes(chunks, threshold, ngram, min_tokens)
    placed = written(placed, "neardup-placed")
    # pairs that overlap in one file are no links: found by equal file within linked classes
    a, b = (placed.select(*(F.col(c).alias(f"{c}_{x}") for c in ("key", "sig", *_PLACE))) for x in "ab")
    directed = links.select("sig_a", "sig_b").union(links.where("sig_a <> sig_b").select("sig_b", "sig_a"))
    near = directed.join(a, "sig_a").join(b.withColumnsRenamed({"repo_id_b": "repo_id_a", "file_path_b": "file_path_a"}), ["sig_b", "repo_id_a", "file_path_a"])
    over = written(near.where("key_a <> key_b and start_line_a <= end_line_b and start_line_b <= end_line_a").select("sig_a", "sig_b", "key_a"), "neardup-over")
    sizes = placed.groupBy("sig").agg(F.max("members").alias("n"))
    sized = directed.join(sizes.select(F.col("sig").alias("sig_a"), F.col("n").alias("n_a")), "sig_a").join(sizes.select(F.col("sig").alias("sig_b"), F.col("n").alias("n_b")), "sig_b")
    sized = sized.join(over.groupBy("sig_a", "sig_b").agg(F.count("*").alias("lost")), ["sig_a", "sig_b"], "left").fillna(0, ["lost"])
    partners = F.when(F.col("sig_a") == F.col("sig_b"), F.col("n_b") - 1).otherwise(F.col("n_b"))
    real = written(sized.where(F.col("n_a") * partners > F.col("lost")).select("sig_a", "sig_b", partners.alias("partners")), "neardup-real")
    each = real.groupBy("sig_a").agg(F.sum("partners").alias("total")).withColumnRenamed("sig_a", "sig")
    lost = over.join(real, ["sig_a", "sig_b"], "left_semi").groupBy(F.col("key_a").alias("key")).agg(F.count("*").alias("lost"))
    counted = placed.select("key", "sig").join(each, "sig").join(lost, "key", "left").withColumn("links", F.col("total") - F.coalesce("lost", F.lit(0))).where("links > 0")
    found = components(real, "sig_a", "sig_b").select(F.col("node").alias("sig"), "component")
    labelled = counted.join(found, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    least = labelled.groupBy("component").agg(F.min("key").alias("group_id"))
    return labelled.join(least, "component").select(F.col("key").alias("chunk_id"), "group_id", F.col("links").cast("bigint").alias("links"))
