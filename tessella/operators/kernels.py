"""Alignments and chains: dynamic programmes on single sequences or pairs, run beside the plan on Arrow batches."""

from __future__ import annotations

from collections import defaultdict

import numpy as np


def local_alignment(a: list[str], b: list[str], weight: dict[str, float] | None = None, mismatch: float = 1.0, gap: float = 1.5) -> tuple[float, list[tuple[int, int]]]:
    """The best local alignment of two token lists: its score and the matched places.

    A match earns the token's weight (1 if unknown). Of equal cells the first in reading order ends the alignment; going
    back, a diagonal step is preferred to one up and that to one left.
    """
    if weight is None:
        return _unit_alignment(a, b, mismatch, gap)
    above, moves, best, end = [0.0] * (len(b) + 1), [], 0.0, None
    for i, x in enumerate(a, 1):
        row, step = [0.0], [0]
        for j, y in enumerate(b, 1):
            earned = (weight or {}).get(x, 1.0) if x == y else -mismatch
            options = (above[j - 1] + earned, above[j] - gap, row[j - 1] - gap)
            top = max(options)
            row.append(max(0.0, top))
            step.append(0 if top <= 0 else 1 + options.index(top))
            if row[j] > best:
                best, end = row[j], (i, j)
        above = row
        moves.append(step)
    places = []
    while end:
        i, j = end
        move = moves[i - 1][j] if i and j else 0
        if not move:
            break
        if move == 1 and a[i - 1] == b[j - 1]:
            places.append((i - 1, j - 1))
        end = (i - 1, j - 1) if move == 1 else (i - 1, j) if move == 2 else (i, j - 1)
    return best, places[::-1]


def _unit_alignment(a: list[str], b: list[str], mismatch: float, gap: float) -> tuple[float, list[tuple[int, int]]]:
    """``local_alignment`` with weights of 1, a row at a time: a gap within a row is a running maximum."""
    number = {w: n for n, w in enumerate(dict.fromkeys(a))}
    there = np.fromiter((number.get(w, -1) for w in b), "i8", len(b))
    score, slope = np.zeros((len(a) + 1, len(b) + 1)), gap * np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        row = score[i]
        row[1:] = np.maximum(score[i - 1, :-1] + np.where(there == number[x], 1.0, -mismatch), score[i - 1, 1:] - gap)
        np.maximum(row, 0.0, out=row)
        row[:] = np.maximum.accumulate(row + slope) - slope
    end = int(score.argmax())  # the first of equals
    i, j = divmod(end, len(b) + 1)
    best, places = float(score[i, j]), []
    while score[i, j] > 0:
        hit = a[i - 1] == b[j - 1]
        if score[i, j] == score[i - 1, j - 1] + (1.0 if hit else -mismatch):
            i, j = i - 1, j - 1
            if hit:
                places.append((i, j))
        elif score[i, j] == score[i - 1, j] - gap:
            i -= 1
        else:
            j -= 1
    return best, places[::-1]


def word_operations(a: list[str], b: list[str], match: float = 2.0, mismatch: float = -1.0, gap: float = -1.0) -> list[tuple[str, int | None, int | None]]:
    """A global alignment as operations: same, changed, omitted, added, and moved for a word that is omitted here and added there."""
    table = [[j * gap for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [i * gap]
        for j, y in enumerate(b, 1):
            row.append(max(table[-1][j - 1] + (match if x == y else mismatch), table[-1][j] + gap, row[-1] + gap))
        table.append(row)
    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and table[i][j] == table[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            i, j = i - 1, j - 1
            out.append(("same" if a[i] == b[j] else "changed", i, j))
        elif i and table[i][j] == table[i - 1][j] + gap:
            i -= 1
            out.append(("omitted", i, None))
        else:
            j -= 1
            out.append(("added", None, j))
    out.reverse()
    gone, come = defaultdict(list), defaultdict(list)
    for n, (kind, i, j) in enumerate(out):
        if kind == "omitted":
            gone[a[i]].append(n)
        elif kind == "added":
            come[b[j]].append(n)
    for word, places in gone.items():
        for x, y in zip(places, come.get(word, ()), strict=False):
            out[x], out[y] = ("moved", out[x][1], None), ("moved", None, out[y][2])
    return out


def longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def chains(pairs: list[tuple[int, int, float]], max_step: int = 3, gap: float = 0.25, least: int = 3, backward: bool = False) -> list[list[int]]:
    """Chains of pairs (a, b, weight) that go on together: numbers of pairs in order, best chain first, each pair once.

    A pair goes on from one 1 to ``max_step`` places before it on both sides (after it on the second if ``backward``), at a
    cost of ``gap`` for each place left out; only from one whose own score is positive.
    """
    at = {(a, b): n for n, (a, b, _) in enumerate(pairs)}
    sign = -1 if backward else 1
    score, before = {}, {}
    for n in sorted(range(len(pairs)), key=lambda n: (pairs[n][0], sign * pairs[n][1])):
        a, b, w = pairs[n]
        best, came = 0.0, None
        for da in range(1, max_step + 1):
            for db in range(1, max_step + 1):
                m = at.get((a - da, b - sign * db))
                if m is not None and score.get(m, 0) > 0 and score[m] - gap * (da + db - 2) > best:
                    best, came = score[m] - gap * (da + db - 2), m
        score[n], before[n] = w + best, came
    used, out = set(), []
    for n in sorted(score, key=lambda n: (-score[n], n)):
        path, m = [], n
        while m is not None and m not in used:
            path.append(m)
            m = before[m]
        path.reverse()
        if len(path) < least or n in used:
            continue
        a, b = ([pairs[m][i] for m in path] for i in (0, 1))
        if min(a) <= max(b) and min(b) <= max(a):
            continue
        used.update(path)
        out.append(path)
    return out


def equidistant(letters: str, term: str, least: int, most: int) -> list[tuple[int, int]]:
    """(start, skip) of every occurrence of a term at equal distances; backward ones have negative skips, palindromes are met once."""
    found = []
    for skip in range(least, most + 1):
        for way in (1, -1) if term != term[::-1] else (1,):
            word = term if way == 1 else term[::-1]
            span = skip * (len(word) - 1)
            start = letters.find(word[0])
            while 0 <= start < len(letters) - span:
                if letters[start : start + span + 1 : skip] == word:
                    found.append((start if way == 1 else start + span, way * skip))
                start = letters.find(word[0], start + 1)
    return found
