"""Anchors: a content-made choice of places that every repeated window shares.

Each window of ``n`` consecutive symbols (words or bytes) is named by the least hash among its runs of ``k`` symbols.
Equal windows have equal anchors wherever they stand, so a window can only repeat if its anchor does. Consecutive
windows with one anchor form a run; that takes one row for about ``(n - k + 2) / 2`` windows.
"""

from __future__ import annotations

import numpy as np
from numpy.typing import NDArray

BASE = np.uint64(0x9E3779B97F4A7C15)
U64 = NDArray[np.uint64]


def powers(n: int) -> U64:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, BASE, np.uint64))])


def mixed(x: U64) -> U64:
    """A one-to-one mix of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(h: U64, k: int) -> U64:
    """The polynomial hash of each run of ``k`` symbols, by doubling."""
    power, have, out, done, tail = powers(k), 1, h, 0, None
    while True:
        if k >> (have.bit_length() - 1) & 1:
            tail = out[: len(h) - have + 1] if tail is None else tail[: len(h) - done - have + 1] * power[have] + out[done : len(h) - have + 1]
            done += have
        if done == k:
            return tail
        out = out[: len(h) - 2 * have + 1] * power[have] + out[have : len(h) - have + 1]
        have *= 2


def least(x: U64, w: int) -> U64:
    """The least of each ``w`` consecutive values, by doubling."""
    have = 1
    while 2 * have <= w:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


def runs(h: U64, sizes: NDArray[np.int64], n: int, k: int, within: bool) -> tuple[NDArray[np.int64], NDArray[np.int64], NDArray[np.int64], U64, NDArray[np.bool_]]:
    """Runs of windows with one anchor, over texts of ``sizes`` symbols that stand one after the other in ``h``.

    For each run: its text, where in the text it starts, how many windows it has, the anchor, and (if ``within``, else
    False) whether the anchor may stand in it more than once, as it does where a window repeats within the run.
    """
    if len(h) < n:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, bool)
    w = n - k + 1
    gram = mixed(grams(h, k))
    windows = np.maximum(sizes - n + 1, 0)
    text = np.repeat(np.arange(len(sizes)), windows)
    at = np.arange(len(text)) - (np.cumsum(windows) - windows)[text]
    place = (np.cumsum(sizes) - sizes)[text] + at
    low = least(gram, w)[place]
    new = np.ones(len(text), bool)
    new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(text)))
    if not within:
        return text[start], at[start], size, low[start], np.zeros(len(start), bool)
    # a gram is an anchor if one of the windows around it has nothing less: then their greatest least is the gram
    around = np.zeros(len(gram) + w - 1, np.uint64)
    around[place + w - 1] = low
    anchors = np.flatnonzero(~least(~around, w) == gram)
    pair = np.concatenate([[0], np.cumsum((gram[anchors[1:]] == gram[anchors[:-1]]) & (np.diff(anchors) < w))])
    first, last = np.searchsorted(anchors, place[start]), np.searchsorted(anchors, place[start] + size + w - 2, "right") - 1
    twice = (size > w) | (pair[np.maximum(last, first)] > pair[np.minimum(first, len(pair) - 1)]) if len(anchors) else size > w
    return text[start], at[start], size, low[start], twice
