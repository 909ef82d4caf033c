"""Recompression of sequences into a run-length grammar, and longest common extensions answered by the grammar.

Levels alternate between block compression (a maximal block of one symbol becomes one symbol) and pair compression (symbols
are dealt to a left and a right class by a hash; a left symbol and the right one after it become one symbol). Equal parts of
the sequence are therefore compressed alike but for a few symbols at their ends, which is what extensions walk over.
All steps are array operations over many sequences, or many queries, at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from grantlake.llm.common import mixed

# Levels are added until every sequence has at most so many symbols, which a query at the top compares one by one.
TOP_SYMBOLS = 4
MAX_ROUNDS = 400


@dataclass
class Level:
    """Symbols of one level and how they stand below the next one: `first` marks those that begin a symbol above."""

    symbols: np.ndarray
    block: bool = False
    first: np.ndarray | None = None
    # Symbol above, by symbol of this level; first symbol of this level, by symbol above; what is left of its block, by symbol.
    above: np.ndarray | None = None
    below: np.ndarray | None = None
    left: np.ndarray | None = None


def _named(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


class Grammar:
    """The levels over `symbols`, whose separators (`is_end`) occur once each, stay single and are the first and last of all."""

    def __init__(self, symbols: np.ndarray, is_end: np.ndarray) -> None:
        self.levels = [Level(_named(symbols))]
        ends = is_end
        for turn in range(MAX_ROUNDS):
            if np.diff(np.flatnonzero(ends)).max(initial=0) <= TOP_SYMBOLS + 1:
                break
            ends = self._blocks(ends)
            ends = self._pairs(ends, turn)

    def _raise(self, first: np.ndarray, keys: np.ndarray, ends: np.ndarray, block: bool) -> np.ndarray:
        level = self.levels[-1]
        level.block, level.first = block, first
        level.above, level.below = np.cumsum(first) - 1, np.flatnonzero(first)
        if block:
            stops = np.append(level.below[1:], len(first))
            level.left = stops[level.above] - np.arange(len(first))
        self.levels.append(Level(_named(keys)))
        return ends[level.below]

    def _blocks(self, ends: np.ndarray) -> np.ndarray:
        symbols = self.levels[-1].symbols
        first = np.ones(len(symbols), bool)
        first[1:] = symbols[1:] != symbols[:-1]
        if first.all():
            return ends
        at = np.flatnonzero(first)
        lengths = np.diff(np.append(at, len(symbols)))
        return self._raise(first, symbols[at] * (lengths.max() + 1) + lengths, ends, True)

    def _pairs(self, ends: np.ndarray, turn: int) -> np.ndarray:
        symbols = self.levels[-1].symbols
        right = (mixed(symbols.astype(np.uint64) + (np.uint64(turn) << np.uint64(40))) >> np.uint64(63)).astype(bool)
        inner = ~(ends[1:] | ends[:-1])
        joined = inner & ~right[:-1] & right[1:]
        turned = inner & right[:-1] & ~right[1:]
        if turned.sum() > joined.sum():
            joined = turned
        first = np.ones(len(symbols), bool)
        first[1:] = ~joined
        at = np.flatnonzero(first)
        pair = np.append(joined, False)[at]
        second = np.where(pair, symbols[np.minimum(at + 1, len(symbols) - 1)] + 1, 0)
        return self._raise(first, symbols[at] * (symbols.max() + 2) + second, ends, False)

    def extensions(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each query, how many symbols are equal from places i and j on (i < j, no separator repeats)."""
        p, q = i.copy(), j.copy()
        top = np.zeros(len(i), np.int64)
        going = np.arange(len(i))
        for h, level in enumerate(self.levels):
            # Walk on this level to a place where a symbol above begins on both sides, or to a mismatch.
            open_ = going
            while len(open_):
                if level.first is not None:
                    open_ = open_[~(level.first[p[open_]] & level.first[q[open_]])]
                same = level.symbols[p[open_]] == level.symbols[q[open_]]
                top[open_[~same]] = h
                p[open_[~same]] = ~p[open_[~same]]
                open_ = open_[same]
                step = np.minimum(level.left[p[open_]], level.left[q[open_]]) if level.block else 1
                p[open_] += step
                q[open_] += step
            stopped = p[going] < 0
            p[going[stopped]] = ~p[going[stopped]]
            going = going[~stopped]
            if level.above is not None:
                p[going], q[going] = level.above[p[going]], level.above[q[going]]
        for h in range(len(self.levels) - 1, 0, -1):
            level = self.levels[h - 1]
            down = np.flatnonzero(top >= h)
            p[down], q[down] = level.below[p[down]], level.below[q[down]]
            while len(down):
                down = down[level.symbols[p[down]] == level.symbols[q[down]]]
                step = np.minimum(level.left[p[down]], level.left[q[down]]) if level.block else 1
                p[down] += step
                q[down] += step
        return p - i
