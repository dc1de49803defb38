"""Anchors: for every window of `width` bytes of a text, the place of its smallest gram.

Equal windows have their smallest gram at the same place, so windows that are
equal meet under the gram's hash; neighbouring windows mostly share an anchor,
so there are far fewer anchors than windows. All windows with one anchor begin
in one range of places; the bytes they cover are the anchor's context.
"""

from __future__ import annotations

import numpy as np

from quarry.llm import spans

GRAM = 20
PLACE = np.uint64((1 << 24) - 1)


def anchors(data: np.ndarray, at: np.ndarray, width: int, gram: int = GRAM):
    """(text, first window, last window, anchor, gram hash, context hash) arrays, places within data, for a batch of under 16 MB (or one text, cut by the caller)."""
    n = len(data) - width + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = spans.prefix_sums(data)
    _, down = spans.powers(len(data) + 1)
    g = np.arange(len(data) - gram + 1)
    h = spans.mix((sums[gram:] - sums[:-gram]) * down[: len(g)])
    low = (h & ~PLACE) | g.astype(np.uint64)
    span, have = width - gram + 1, 1  # grams of a window
    while have * 2 <= span:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    place = (low[:n] & PLACE).astype(np.int64)
    end = np.repeat(at[1:], np.diff(at))[:n]
    inside = np.arange(n) + width <= end
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    # a run ends where the next begins, or where windows leave the text
    stop = np.flatnonzero(new | ~inside)
    last = np.r_[stop, n][np.searchsorted(stop, first, "right")] - 1
    a = place[first]
    context = spans.mix(spans.hashes(sums, first, last + width) + spans.P * (a - first).astype(np.uint64))
    return np.searchsorted(at, first, "right") - 1, first, last, a, h[a], context
