"""Anchors: positions of a text that depend on nothing but the bytes around them.

Of the hashes of the ``GRAM``-byte strings in a run of ``SPAN`` bytes the least one, the first of equals, is the
run's anchor. Equal runs have it at the same place. Runs that follow each other mostly share their anchor; such a
row of runs is a segment: its first run, how many there are, the anchor's hash and a hash of all its bytes.
"""

from __future__ import annotations

import numpy as np

from tessella.llm.words import mixed

SPAN, GRAM = 100, 32
WINDOW = SPAN - GRAM + 1
#: Of a hash that is compared, the lowest bits give way to the place. Longer data are read in parts.
PLACE_BITS = 26
PLACE = np.uint64((1 << PLACE_BITS) - 1)
#: Odd multipliers.
FACTORS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place that has as many."""
    n = len(data) - GRAM + 1
    words = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    words = np.ascontiguousarray(words).view("u8")[:, 0]
    out = words[:n] * FACTORS[0]
    for i in range(1, GRAM // 8):
        out ^= out >> np.uint64(29)
        out += words[8 * i : 8 * i + n] * FACTORS[i]
    return mixed(out)


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` values in a row."""
    size = 1
    while 2 * size <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = n - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _segments(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    hashes = gram_hashes(data)
    anchor = sliding_least((hashes & ~PLACE) | np.arange(len(hashes), dtype="u8"), WINDOW) & PLACE
    inside = np.ones(len(anchor), bool)
    for end in starts[1:-1].tolist():  # runs over the border of two texts
        inside[max(0, end - SPAN + 1) : end] = False
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    new &= inside
    first = np.flatnonzero(new)
    if not len(first):
        return first, first, first.astype("u8"), first.astype("u8")
    counts = np.add.reduceat(inside.astype("i8"), first)
    last = first + counts + SPAN - 1 - GRAM
    content = counts.astype("u8")
    for i, factor in enumerate(FACTORS):
        content = (content ^ (content >> np.uint64(31))) + hashes[np.minimum(first + GRAM * i, last)] * factor
    return first, counts, hashes[anchor[first].astype("i8")], mixed(content)


def segments(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end in ``data``, ``starts`` having their beginnings and the end: first run, number of runs, anchor's hash and content's hash of each segment."""
    part = 1 << (PLACE_BITS - 1)
    found = []
    for at in range(0, max(1, len(data)), part):
        piece = data[at : at + part + SPAN - 1]
        if len(piece) >= SPAN:
            its = starts[(starts > at) & (starts < at + len(piece))] - at
            first, *rest = _segments(piece, np.concatenate([[0], its, [len(piece)]]))
            found.append((first + at, *rest))
    if not found:
        return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "u8"), np.zeros(0, "u8")
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
