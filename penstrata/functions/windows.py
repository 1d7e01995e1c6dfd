"""Sums over all windows of a text."""

from __future__ import annotations

import numpy as np

MATTR_WINDOW = 100
GRAM = 4
#: Texts are put together up to so many characters, which a processor's cache holds; a place takes PLACE bits beside the 42 of a bigram.
TOGETHER, PLACE = 1 << 14, 20


def window_sums(text: str, window: int = MATTR_WINDOW, n: int = GRAM) -> tuple[int, int, int, int]:
    """Of a text without punctuation: bigrams, distinct bigrams summed over all windows, n-grams, distinct n-grams.

    A bigram at p whose last equal one is at q is new in every window that
    begins behind q and holds p; their number is a difference of bounds, so
    that no window is visited.
    """
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    t = c[:-1] << 21 | c[1:] if len(c) >= 2 else c
    m = len(t)
    if not m:
        return 0, 0, 0, 0
    order = np.argsort(t, kind="stable")
    last = np.full(m, -1)
    same = t[order[1:]] == t[order[:-1]]
    last[order[1:][same]] = order[:-1][same]
    w, p = min(window, m), np.arange(m)
    total = np.maximum(0, np.minimum(p, m - w) - np.maximum(last + 1, np.maximum(p - w + 1, 0)) + 1).sum()
    if len(c) < n:
        return m, int(total), 0, 0
    pairs = np.unique(t[: len(t)], return_inverse=True)[1]
    g = pairs[:-2] * (m + 1) + pairs[2:]
    return m, int(total), len(g), len(np.unique(g))


def sums_of(texts: list[str]) -> list[tuple[int, int, int, int]]:
    """``window_sums`` of many texts, put together so that a text costs no calls of its own."""
    out: list = [None] * len(texts)
    some, size = [], 0
    for i, text in enumerate(texts):
        if not 2 <= len(text) <= TOGETHER:
            out[i] = window_sums(text)
            continue
        if size + len(text) > TOGETHER:
            _together(texts, some, out)
            some, size = [], 0
        some.append(i)
        size += len(text)
    if some:
        _together(texts, some, out)
    return out


def _together(texts: list[str], some: list[int], out: list) -> None:
    """``window_sums`` of the texts ``some``: one sort of (bigram, place), one of (text, n-gram)."""
    own = [texts[i] for i in some]
    c = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).astype(np.int64)
    size = np.fromiter(map(len, own), np.int64, len(own))
    inside = np.ones(len(c) - 1, bool)
    inside[np.cumsum(size)[:-1] - 1] = False
    t = (c[:-1] << 21 | c[1:])[inside]
    m, at = size - 1, np.arange(len(t))
    first = np.cumsum(m) - m
    key = t << PLACE | at
    key.sort()
    place, same = key & ((1 << PLACE) - 1), key[1:] >> PLACE == key[:-1] >> PLACE
    start, left = np.repeat(first, m), np.repeat(m, m)
    last = np.full(len(t), -1)
    last[place[1:][same]] = place[:-1][same]
    last = np.maximum(last - start, -1)  # one that stands in a text before is none
    w, p = np.minimum(MATTR_WINDOW, left), at - start
    total = np.add.reduceat(np.maximum(0, np.minimum(p, left - w) - np.maximum(last + 1, np.maximum(p - w + 1, 0)) + 1), first)
    rank = np.empty(len(t), np.int64)
    rank[place] = np.cumsum(np.concatenate(([0], ~same)))
    whole = p[:-2] + 2 < left[:-2]
    g = (np.repeat(np.arange(len(own)), m)[:-2][whole] << 2 * PLACE) | rank[:-2][whole] << PLACE | rank[2:][whole]
    g.sort()
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    distinct = np.bincount(g[new] >> 2 * PLACE, minlength=len(own))
    for i, *sums in zip(some, m.tolist(), total.tolist(), np.maximum(m - 2, 0).tolist(), distinct.tolist()):
        out[i] = tuple(sums)
