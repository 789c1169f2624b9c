"""Boundaries in texts: cohesion of neighbouring blocks, depth of its valleys, and measures of segmentations."""

from __future__ import annotations

import math
from collections import Counter


def gap_cosines(lines: list[list[str]], width: int) -> list[float]:
    """Cosine of the words of up to ``width`` lines before and after each gap; 0 if a side has none."""
    out = []
    for g in range(1, len(lines)):
        a = Counter(w for line in lines[max(0, g - width) : g] for w in line)
        b = Counter(w for line in lines[g : g + width] for w in line)
        size = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        out.append(sum(v * b[k] for k, v in a.items()) / size if size else 0.0)
    return out


def depths(curve: list[float]) -> list[float]:
    """How far each value lies below the peaks that one reaches going up to either side."""
    out = []
    for i, v in enumerate(curve):
        climbed = 0.0
        for way in (-1, 1):
            top, j = v, i + way
            while 0 <= j < len(curve) and curve[j] >= top:
                top, j = curve[j], j + way
            climbed += top - v
        out.append(climbed)
    return out


def pk(reference: list[int], proposed: list[int], k: int) -> float:
    """The share of windows of ``k`` gaps about which two segmentations (1 for a boundary) disagree whether there is one; NaN if too short."""
    n = len(reference) - k + 1
    return sum((sum(reference[i : i + k]) > 0) != (sum(proposed[i : i + k]) > 0) for i in range(n)) / n if n > 0 else math.nan


def window_diff(reference: list[int], proposed: list[int], k: int) -> float:
    """As ``pk``, about how many there are."""
    n = len(reference) - k + 1
    return sum(sum(reference[i : i + k]) != sum(proposed[i : i + k]) for i in range(n)) / n if n > 0 else math.nan
