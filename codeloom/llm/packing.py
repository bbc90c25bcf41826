"""Documents packed into containers of fixed capacity (problem 8).

Method: swap-based local search.  Items are packed best-fit decreasing, then moved one-for-one,
two-for-one or singly between underfull bins whenever that raises the sum of squared fills, until
bins become empty or nothing improves.

The search has no budget of moves.  Takers are indexed by the space they have left and the sizes they hold, as bit sets, so a step asks each
space and each size (or sum of two sizes) of the giver once, however many bins there are; it ends when no step raises the squared fill, or
when no fewer bins are possible.

Scale: items are spread by hash over blocks of bounded size, each block is packed by one task, and
only what lies in underfull bins goes on to a second packing over far fewer, again bounded, blocks.
The loss against one global packing is at most about one open bin per block of the last round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.blocks import blocks
from codeloom.functions.tokens import column_token_counts

CAPACITY = 2048
#: Items that one packing task holds.
BLOCK_ITEMS = 20_000


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing: the bin of each item, and the number of bins."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by space left
    spaces = 0  # bit s is set where stacks[s] has a bin
    bins, count = np.zeros(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = spaces >> s
        if fits:
            left = s + (fits & -fits).bit_length() - 1
            b = stacks[left].pop()
            if not stacks[left]:
                spaces &= ~(1 << left)
        else:
            left, b, count = capacity, count, count + 1
        bins[i] = b
        stacks[left - s].append(b)
        if left > s:
            spaces |= 1 << (left - s)
    return bins, count


class _Bins:
    """Underfull bins by space left; each space knows, as a bit set, which sizes its bins hold."""

    def __init__(self, sizes: np.ndarray, bins: np.ndarray, fill: np.ndarray, capacity: int) -> None:
        self.sizes, self.capacity = sizes.tolist(), capacity
        self.fill = fill.tolist()
        self.held: dict[int, dict[int, list[int]]] = {}  # bin: size: items
        under = (fill > 0) & (fill < capacity)
        for i in np.flatnonzero(under[bins]).tolist():
            self.held.setdefault(int(bins[i]), {}).setdefault(self.sizes[i], []).append(i)
        self.at: dict[int, set[int]] = {}  # space: bins
        self.bits: dict[int, dict[int, set[int]]] = {}  # space: size: bins that hold it
        self.mask: dict[int, int] = {}
        for b in self.held:
            self.enter(b)

    def enter(self, b: int) -> None:
        space = self.capacity - self.fill[b]
        if not space or not self.held[b]:
            return
        self.at.setdefault(space, set()).add(b)
        sizes = self.bits.setdefault(space, {})
        mask = self.mask.get(space, 0)
        for s in self.held[b]:
            sizes.setdefault(s, set()).add(b)
            mask |= 1 << s
        self.mask[space] = mask

    def leave(self, b: int) -> None:
        space = self.capacity - self.fill[b]
        if b not in self.at.get(space, ()):
            return
        self.at[space].discard(b)
        sizes = self.bits[space]
        for s in self.held[b]:
            sizes[s].discard(b)
            if not sizes[s]:
                del sizes[s]
                self.mask[space] &= ~(1 << s)
        if not self.at[space]:
            del self.at[space], self.bits[space], self.mask[space]

    def take(self, b: int, size: int) -> int:
        items = self.held[b][size]
        i = items.pop()
        if not items:
            del self.held[b][size]
        return i

    def step(self, giver: int) -> tuple[int, tuple[int, ...], int] | None:
        """(taker, sizes that go, size that comes back or 0): the fullest taker that gains, and the step by which it gains most."""
        mine = self.held[giver]
        ones = sorted(mine, reverse=True)
        twos = {a + b: (a, b) for k, a in enumerate(ones) for b in ones[k:] if (a != b or len(mine[a]) > 1)}
        least = self.capacity - self.fill[giver]
        for space in sorted(self.at):
            if space > least:  # only bins at least as full take: the squared fill rises with every step
                return None
            best: tuple[int, tuple[int, ...], int] | None = None
            gained = 0
            for s in ones:  # move one document
                if s <= space:
                    best, gained = (0, (s,), 0), s
                    break
            mask = self.mask[space]
            for go, sums in ((1, ones), (2, twos)):
                if gained == space:
                    break
                for s in sums:
                    low = max(1, s - space)  # what comes back makes the gain s - size, at most the space
                    size = mask >> low
                    if not size:
                        continue
                    back = low + (size & -size).bit_length() - 1
                    if gained < s - back:
                        best, gained = (back, (s,) if go == 1 else twos[s], back), s - back
                        if gained == space:
                            break
            if best:
                takers = self.bits[space][best[0]] if best[0] else self.at[space]
                return min(takers), best[1], best[2]
        return None


def improve(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Local search on underfull bins: single moves, one-for-one and two-for-one swaps that raise squared fill.

    The emptiest bins give, the others take; a bin that becomes empty is gone.  A step brings a larger
    item (or two that are together larger) into a bin that is at least as full, so the squared fill rises with every step and
    the search ends: where no step is left, or where the number of bins can't be smaller.
    """
    if not len(bins):
        return bins
    fill = np.bincount(bins, weights=sizes).astype(np.int64)
    spare = int((fill > 0).sum()) - -(-int(sizes.sum()) // capacity)  # bins that might become empty
    if spare <= 0:
        return bins
    bins = bins.copy()
    open_bins = _Bins(sizes, bins, fill, capacity)
    moved = True
    while moved and spare > 0:
        moved = False
        for giver in sorted(open_bins.held, key=lambda b: open_bins.fill[b]):
            open_bins.leave(giver)
            while open_bins.held[giver] and (step := open_bins.step(giver)) is not None:
                taker, out, back = step
                open_bins.leave(taker)
                returned = open_bins.take(taker, back) if back else None
                for s in out:
                    i = open_bins.take(giver, s)
                    open_bins.held[taker].setdefault(s, []).append(i)
                    bins[i] = taker
                if returned is not None:
                    open_bins.held[giver].setdefault(back, []).append(returned)
                    bins[returned] = giver
                gain = sum(out) - back
                open_bins.fill[taker] += gain
                open_bins.fill[giver] -= gain
                open_bins.enter(taker)
                moved = True
            if open_bins.held[giver]:
                open_bins.enter(giver)
            else:
                del open_bins.held[giver]
                spare -= 1
                if spare <= 0:
                    break
    return bins


def pack_block(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """A bin for each item of one block, bins numbered from 0 without gaps."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    bins, _ = best_fit(sizes, capacity)
    return np.unique(improve(sizes, bins, capacity), return_inverse=True)[1]


def sized_pieces(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, tokens, token_start) of each document with tokens; a larger one yields pieces of exactly ``capacity`` and a rest."""

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", 1 << 23):
            n = column_token_counts(block.column("text"))
            pieces = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.minimum(capacity, n[row] - k * capacity)
            ids = block.column("doc_id").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([ids, pa.array(k + 1, pa.int32()), pa.array(size, pa.int32()), pa.array(k * capacity, pa.int64())], ["doc_id", "piece", "tokens", "token_start"])

    return documents.select("doc_id", "text").where("doc_id is not null").mapInArrow(size, "doc_id bigint, piece int, tokens int, token_start bigint")


def pack(documents: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """A container for each document or piece of one: doc_id, piece, token_start, tokens, container.

    Input: doc_id, text.  Defined results: a document without tokens (null, empty or white space) gets no row;
    a document delivered twice is packed once; only a document larger than the capacity is cut, into full
    pieces and a rest; no container exceeds the capacity; a row without an id
    can't be referred to and is left out.
    """
    from codeloom.session import written

    sized = written(sized_pieces(documents, capacity).dropDuplicates(["doc_id", "piece"]), "pack-sizes")
    total = sized.count()
    if not total:
        return sized.withColumn("container", F.lit(None).cast("string"))
    parts = max(1, -(-total // block_items))

    def one_round(items: DataFrame, count: int, tag: str) -> DataFrame:
        def run(t: pa.Table) -> pa.Table:
            sizes = t.column("tokens").to_numpy().astype(np.int64)
            # a fixed order, so that a task that is run again packs alike
            order = np.lexsort((t.column("piece").to_numpy(), t.column("doc_id").to_numpy(), sizes))
            bins = np.empty(len(sizes), np.int64)
            bins[order] = pack_block(sizes[order], capacity)
            fill = np.bincount(bins, weights=sizes)[bins].astype(np.int32) if len(bins) else np.zeros(0, np.int32)
            return t.append_column("bin", pa.array(bins)).append_column("fill", pa.array(fill, pa.int32()))

        # partitions by number: what a task packs stays bounded, adaptive execution doesn't join them
        blocked = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(count)).cast("int")).repartition(count, "block")
        packed = blocked.groupBy("block").applyInArrow(run, "doc_id bigint, piece int, tokens int, token_start bigint, block int, bin bigint, fill int")
        return packed.withColumn("container", F.concat(F.lit(tag), F.col("block").cast("string"), F.lit("."), F.col("bin").cast("string")))

    keep = ["doc_id", "piece", "token_start", "tokens", "container"]
    full = sized.where(F.col("tokens") == capacity).withColumn("container", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), F.col("piece").cast("string"))).select(keep)
    rest = sized.where(F.col("tokens") < capacity)
    # first round: blocks of bounded size; bins that are not nearly full are packed again, over few blocks
    first = written(one_round(rest, parts, "a"), "pack-first")
    done = F.col("fill") >= capacity * 49 // 50
    left = first.where(~done).select("doc_id", "piece", "tokens", "token_start")
    again = max(1, -(-left.count() // block_items))
    return full.unionByName(first.where(done).select(keep)).unionByName(one_round(left, again, "b").select(keep))
