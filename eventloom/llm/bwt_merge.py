"""Burrows-Wheeler transforms of shards, merged by refining their interleave.

The transform of each shard is made alone. To merge them, the rows of all shards are
interleaved, first in shard order, and the interleave is refined symbol by symbol: after h
rounds rows stand in the order of their first h symbols. A round takes each row's preceding
symbol, puts the rows in the order of those symbols, equal ones as they stood, and so gets
the interleave of the suffixes one symbol longer. Nothing is sorted but single symbols.

A gap between rows that opens in round h means that their suffixes share h - 1 symbols. A
row with a gap on both sides shares fewer than h symbols with any other, and so do, one
symbol longer, all rows that would come from it: it is left out from then on. The rows left
after ``depth`` rounds, cut at the gaps, are the intervals of equal strings of that length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Transform:
    """Rows of one shard in suffix order: preceding symbol, place in the text and in its string,
    row of the suffix one symbol longer."""

    symbols: np.ndarray
    positions: np.ndarray
    offsets: np.ndarray
    previous: np.ndarray


def transform(text: np.ndarray) -> Transform:
    """Of strings of symbols >= 1, each closed by a 0; equal suffixes stand in string order."""
    n = len(text)
    ends = np.nonzero(text == 0)[0]
    string = np.concatenate([[0], np.cumsum(text[:-1] == 0)])
    left = ends[string] - np.arange(n)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((n,), ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)
    # Symbols behind the end of the own string do not count.
    over = np.minimum(np.maximum(7 - left, 0), 7).astype(np.uint64) * np.uint64(8)
    words = (words >> over) << over
    order = np.argsort(words, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], words[order][1:] != words[order][:-1]]))
    length = 8
    while True:
        done = left < length
        ahead = rank[np.minimum(np.arange(n) + length, n - 1)] + len(ends)
        pair = rank * (n + len(ends) + 1) + np.where(done, string, ahead)
        order = np.argsort(pair, kind="stable")
        rank[order] = np.cumsum(np.concatenate([[0], pair[order][1:] != pair[order][:-1]]))
        if rank[order[-1]] == n - 1:
            break
        length *= 2
    starts = np.concatenate([[0], ends[:-1] + 1])
    before = np.arange(n) - 1
    before[starts] = ends
    offsets = np.arange(n) - starts[string]
    return Transform(text[before[order]], order, offsets[order], rank[before[order]])


def repeated_intervals(shards: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges the shards and returns their repeated strings of ``depth`` symbols.

    Positions, in the shards' texts put end to end, of all suffixes whose first ``depth``
    symbols another suffix has as well, in order of those symbols, and the number of the
    interval that each belongs to.
    """
    bases = np.cumsum([0, *[len(s.symbols) for s in shards[:-1]]])
    symbols = np.concatenate([s.symbols for s in shards])
    previous = np.concatenate([s.previous + b for s, b in zip(shards, bases)]).astype(np.int32)
    positions = np.concatenate([s.positions + b for s, b in zip(shards, bases)])
    deep = np.concatenate([s.offsets for s in shards]) >= depth
    interleave = np.nonzero(deep)[0].astype(np.int32)
    interval = np.zeros(len(interleave), np.int32)
    for _ in range(depth):
        if not len(interleave):
            break
        before = symbols[interleave]
        step = np.argsort(before, kind="stable")
        old = interval[step]
        opened = np.empty(len(step) + 1, bool)
        opened[1:-1] = old[1:] != old[:-1]
        # A new symbol begins where the counts of the smaller ones end.
        opened[np.cumsum(np.bincount(before))] = True
        opened[0] = opened[-1] = True
        shared = np.nonzero(~(opened[:-1] & opened[1:]))[0]
        interval = np.cumsum(opened[:-1], dtype=np.int32)[shared]
        interleave = previous[interleave[step[shared]]]
    return positions[interleave], interval
