"""Burrows-Wheeler transforms of shards of text and their merge by iterative interleave refinement.

Strings are read over an alphabet of STEP-byte symbols, at every byte offset: the suffix at i begins with the
symbol at i and goes on with the suffix at i + STEP. Symbols are numbered in byte order. What is left of a
string when a symbol doesn't fit any more is an end of its own, unlike any other, so no match runs over an end.

A shard's suffixes are sorted apart, ends last; its transform holds, in that order, the symbol that stands before each
suffix (none at a string's first STEP places). Only the transforms are merged: suffixes are not compared again.
An interleave says for every place of the merged order which shard's next suffix stands there. From one that
is right to a depth of t symbols follows one that is right to t + 1: the transforms' symbols, read in the order of the
interleave, are counted into buckets, and a bucket's entries keep their order. Each round also refines the
blocks of suffixes that agree so far; the round in which a border appears is the common prefix there, in symbols.
Blocks of two or more after DEPTH / STEP rounds are the repeated strings of DEPTH bytes.
"""

from __future__ import annotations

import numpy as np

STEP = 40
#: Bytes of a shard: what is sorted at once. A bucket of pieces has many of them.
SHARD = 32 << 10


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the pairs, in their order and without gaps."""
    return np.unique(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64), return_inverse=True)[1].astype(np.int64)


class Strings:
    """Strings one after another, each followed by a place for its end, and the number of the symbol at every place."""

    def __init__(self, strings: list[bytes], step: int) -> None:
        sizes = np.array([len(s) for s in strings], np.int64)
        self.step = step
        self.at = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.n = int(self.at[-1])
        if self.n >= 1 << 31:
            raise ValueError("a bucket of strings must be under 2 GB")
        raw = np.frombuffer(b"\0".join(strings) + b"\0" * (step + 1), np.uint8)
        text = np.repeat(np.arange(len(strings)), sizes + 1)
        self.left = (self.at[1:] - 1)[text] - np.arange(self.n)  # bytes up to the string's end
        self.inside = np.arange(self.n) - self.at[:-1][text]  # bytes from its start
        value = np.zeros(self.n, np.uint64)
        width = min(8, step)
        for j in range(width):
            value = value << np.uint64(8) | raw[j : j + self.n]
        symbol = np.unique(value, return_inverse=True)[1].astype(np.int64)
        while width < step:  # two strings of the width before, overlapping in the last round
            move = min(width, step - width)
            symbol = _pairs(symbol, np.append(symbol[move:], np.zeros(min(move, self.n), np.int64)))
            width += move
        self.symbol = symbol


def shard_order(s: Strings, lo: int, hi: int, depth: int) -> np.ndarray:
    """The places lo..hi (whole strings): those with a full symbol in the order of their first `depth` bytes, by doubling, then the ends."""
    step = s.step
    left = s.left[lo:hi]
    full, ends = np.flatnonzero(left >= step), np.flatnonzero(left < step)
    rank = np.zeros(hi - lo, np.int64)
    rank[ends] = len(full) + np.arange(len(ends))
    order = full[np.argsort(s.symbol[lo + full], kind="stable")]
    keys = s.symbol[lo + order]
    active, k = np.arange(len(order)), step
    while True:
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        size = np.diff(np.append(first, len(keys)))
        rank[order[active]] = np.repeat(active[first], size)
        active = active[np.repeat(size > 1, size)]
        if k >= depth or not len(active):
            return np.concatenate([order, ends]) + lo
        move = min(k, depth - k)
        own = order[active]
        keys = rank[own] << 32 | rank[own + move]
        by = np.argsort(keys, kind="stable")
        order[active], keys = own[by], keys[by]
        k += move


class Transform:
    """A shard's suffixes in order (`places`, of which `full` have a full symbol), and the symbol before each, -1 at a string's start."""

    def __init__(self, s: Strings, lo: int, hi: int, depth: int) -> None:
        self.places = shard_order(s, lo, hi, depth)
        self.full = int((s.left[lo:hi] >= s.step).sum())
        before = np.where(s.inside[self.places] >= s.step, self.places - s.step, 0)
        self.symbols = np.where(s.inside[self.places] >= s.step, s.symbol[before], -1)


def merge(shards: list[Transform], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of the merged order, symbols shared with the slot before: 0 at first, `rounds` for as many at least).

    A slot is a place in the shards' orders, one after another; the merged order holds those with a full symbol.
    """
    base = np.concatenate([[0], np.cumsum([len(x.places) for x in shards])])
    symbols = np.concatenate([x.symbols for x in shards])
    shard = np.repeat(np.arange(len(shards), dtype=np.int16 if len(shards) < 1 << 15 else np.int32), np.diff(base))
    ends = np.concatenate([np.arange(b + x.full, b + len(x.places)) for x, b in zip(shards, base, strict=False)])
    slots = np.concatenate([np.arange(b, b + x.full) for x, b in zip(shards, base, strict=False)])
    n = len(slots)
    block = np.zeros(n, np.int64)
    common = np.full(n, rounds, np.int64)
    if n:
        common[0] = 0
    for t in range(rounds):
        # the interleave so far, the ends behind it; to a depth of no symbol they are like all others, then each is a block of its own
        read = np.concatenate([slots, ends])
        blocks = np.concatenate([block, n + np.arange(len(ends)) if t else np.zeros(len(ends), np.int64)])
        follows = np.flatnonzero(symbols[read] >= 0)
        # counting into buckets: by symbol, and within it as they were read
        keys = np.sort(symbols[read[follows]].astype(np.uint64) << np.uint64(32) | follows.astype(np.uint64))
        come = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        symbol, source = (keys >> np.uint64(32)).astype(np.int64), blocks[come]
        # the shards alone make the new interleave: a shard's next suffix comes where its number does
        turn = shard[read[come]]
        size = np.bincount(turn, minlength=len(shards))
        slots[np.argsort(turn, kind="stable")] = np.repeat(base[:-1] - (np.cumsum(size) - size), size) + np.arange(len(turn))
        border = np.ones(n, bool)
        border[1:] = (symbol[1:] != symbol[:-1]) | (source[1:] != source[:-1])
        common[border & (common == rounds)] = t
        block = np.cumsum(border) - 1
        if border.all():
            break
    return slots, common


def shards_of(s: Strings, depth: int) -> list[Transform]:
    out, lo, count = [], 0, len(s.at) - 1
    while lo < count:
        hi = max(lo + 1, int(np.searchsorted(s.at, s.at[lo] + SHARD, "right")) - 1)
        out.append(Transform(s, int(s.at[lo]), int(s.at[hi]), depth))
        lo = hi
    return out


def repeated_places(strings: list[bytes], depth: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(mask over all places of those whose `depth` bytes occur at another place too, first place of each string)."""
    if depth % step:
        raise ValueError(f"depth must be a multiple of {step}")
    s = Strings(strings, step)
    mask = np.zeros(s.n, bool)
    if strings:
        shards = shards_of(s, depth)
        slots, common = merge(shards, depth // step)
        order = np.concatenate([x.places for x in shards])[slots]
        same = common == depth // step
        mask[order[same]] = True
        mask[order[:-1][same[1:]]] = True
    return mask, s.at[:-1]
