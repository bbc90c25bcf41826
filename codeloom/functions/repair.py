"""Re-Pair grammars of many sequences at once, in NumPy.

Re-Pair replaces a frequent pair of adjacent symbols by a new symbol, again and again, until no pair occurs twice.  Here every
round looks at all unfinished sequences of a block together: it counts the pairs of each sequence with one sort, takes those with at least half
the count of the sequence's most frequent pair, and replaces their occurrences that don't overlap, left to right.  A sequence in which
nothing is replaced is finished and leaves the rounds.  A rule's name is a hash of what it derives, so equal rules of different sequences have equal names.
"""

from __future__ import annotations

import numpy as np

from codeloom.functions.tokens import mix64

_ODD = np.uint64(0x9FB21C651E98DF25)


class Grammar:
    """Per sequence: length, final length, number of rules, uses, and symbols under rules; and all rules with what they derive."""

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray) -> None:
        n = len(bounds) - 1
        self.length = np.diff(bounds)
        row = np.repeat(np.arange(n), self.length)
        sym = symbols.astype(np.uint64)
        weight = np.ones(len(sym), np.int64)
        self.rules = np.zeros(n, np.int64)
        self.uses = np.zeros(n, np.int64)
        self.covered = np.zeros(n, np.int64)
        self.final = np.zeros(n, np.int64)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(sym):
            place = np.zeros(0, np.int64)
            if len(sym) > 1:
                with np.errstate(over="ignore"):
                    pair = mix64(sym[:-1] * _ODD + mix64(sym[1:]))
                    key = mix64(pair + row[:-1].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                place = self._places(key, row, n)
            going = np.zeros(n, bool)
            if len(place):
                firsts = np.unique(key[place], return_index=True)[1]
                name, owners = pair[place], row[place]
                derived = weight[place] + weight[place + 1]
                self.uses += np.bincount(owners, minlength=n)
                self.rules += np.bincount(owners[firsts], minlength=n)
                kept.append((owners[firsts], name[firsts], derived[firsts]))
                going[owners] = True
                sym[place] = name
                weight[place] = derived
                drop = np.ones(len(sym), bool)
                drop[place + 1] = False
                sym, weight, row = sym[drop], weight[drop], row[drop]
            ready = ~going[row]
            if ready.any():
                self.final += np.bincount(row[ready], minlength=n)
                under = ready & (weight > 1)
                self.covered += np.bincount(row[under], weights=weight[under], minlength=n).astype(np.int64)
                sym, weight, row = sym[~ready], weight[~ready], row[~ready]
        self.owner, self.name, self.derived = (np.concatenate([k[i] for k in kept]) if kept else np.zeros(0, kind) for i, kind in enumerate((np.int64, np.uint64, np.int64)))

    @staticmethod
    def _places(key: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Where this round replaces: at least two occurrences of each pair, none overlapping another."""
        at = np.flatnonzero(row[1:] == row[:-1])
        if not len(at):
            return at
        order = at[np.argsort(key[at])]
        sorted_key = key[order]
        cut = np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])))
        size = np.diff(np.concatenate((cut, [len(order)])))
        owner = row[order[cut]]
        most = np.zeros(n, np.int64)
        np.maximum.at(most, owner, size)
        good = (size >= 2) & (size * 2 >= most[owner])
        chosen = np.zeros(len(key), bool)
        chosen[order[np.repeat(good, size)]] = True
        # of a run of adjacent chosen places only every other one can be replaced
        place = np.flatnonzero(chosen)
        if not len(place):
            return place
        start = np.concatenate(([True], place[1:] != place[:-1] + 1))
        first = np.maximum.accumulate(np.where(start, np.arange(len(place)), 0))
        place = place[(np.arange(len(place)) - first) % 2 == 0]
        _, where, times = np.unique(key[place], return_inverse=True, return_counts=True)
        return place[times[where] >= 2]  # a rule that is used once would save nothing

    def ratio(self) -> np.ndarray:
        """Size of the grammar against the sequence: near 1 where nothing repeats."""
        return (self.final + 2 * self.rules) / np.maximum(self.length, 1)
