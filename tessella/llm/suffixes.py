"""Two-stage sorting of suffixes, in numpy.

The suffixes of many short strings are sorted as far as ``DEPTH`` bytes. Only those that are smaller than the suffix
after them are sorted directly, by eight bytes at a time and as long as there are ties; the others come from
scans over the buckets of the first bytes, from the smallest up: a suffix that was met puts the one before it, if
that is a greater one, at the next free place of its own bucket.
"""

from __future__ import annotations

import numpy as np

DEPTH = 100
#: Zero bytes that have to follow the last string; one has to follow each of them.
PADDING = 2 * DEPTH


def word_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number that sorts as they do."""
    view = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    return view[at].view(">u8")[:, 0].astype("u8")


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """Whether the suffix from each place is smaller than the one after it, or the data end in this byte repeated."""
    change = np.flatnonzero(data[:-1] != data[1:])
    which = np.searchsorted(change, np.arange(len(data)))
    last = which == len(change)
    after = change[np.where(last, 0, which)] + 1 if len(change) else np.zeros(len(data), "i8")
    return last | (data < data[after])


def sort_directly(data: np.ndarray, at: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """``at`` in the order of the ``depth`` bytes from there; ties are in no order."""
    at = at[np.argsort(word_at(data, at), kind="stable")]
    tied, done = np.arange(len(at)), 0
    group = np.zeros(len(at), "i8")
    while True:
        places = at[tied]
        words = word_at(data, places + done)
        new = np.ones(len(tied), bool)
        new[1:] = (words[1:] != words[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new)
        sizes = np.bincount(group)
        keep = sizes[group] > 1
        tied, group, done = tied[keep], group[keep], done + 8
        if done >= depth or not len(tied):
            return at
        places = at[tied]
        order = np.lexsort((word_at(data, places + done), group))
        at[tied] = places[order]


def suffix_array(data: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places ``starts[i] + 0 .. counts[i] - 1`` in the order of the ``DEPTH`` bytes that follow."""
    if not len(starts):
        return np.zeros(0, "i8")
    smaller = smaller_than_next(data)
    # on from the last place of each string to one that is sorted directly
    direct_at = np.flatnonzero(smaller)
    ends = direct_at[np.searchsorted(direct_at, starts + counts - 1)] + 1
    wanted = np.zeros(len(data) + 1, "i1")
    np.add.at(wanted, starts, 1)
    np.add.at(wanted, ends, -1)
    wanted = np.cumsum(wanted[:-1], dtype="i4") > 0
    places = np.flatnonzero(wanted)
    first_byte = data[places]
    direct = places[smaller[places]]
    direct = sort_directly(data, direct)
    direct_of = np.searchsorted(data[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []
    follows = wanted & ~smaller
    for byte in np.unique(first_byte).tolist():
        bucket = []
        found = np.concatenate(induced[byte]) if induced[byte] else np.zeros(0, "i8")
        while len(found):  # greater suffixes of this bucket, then those that they put behind themselves
            bucket.append(found)
            before = found[found > 0] - 1
            found = before[follows[before] & (data[before] == byte)]
        bucket.append(direct[direct_of[byte] : direct_of[byte + 1]])
        bucket = np.concatenate(bucket)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[follows[before] & (data[before] > byte)]
        theirs = data[before]
        order = np.argsort(theirs, kind="stable")
        before, theirs = before[order], theirs[order]
        cuts = np.flatnonzero(theirs[1:] != theirs[:-1]) + 1
        for part in np.split(before, cuts) if len(before) else ():
            induced[int(data[part[0]])].append(part)
        induced[byte] = []
    array = np.concatenate(out)
    mine = np.zeros(len(data) + 1, "i1")
    np.add.at(mine, starts, 1)
    np.add.at(mine, starts + counts, -1)
    return array[np.cumsum(mine[:-1], dtype="i4")[array] > 0]


def common_prefixes(data: np.ndarray, array: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each entry but the first, how many of its first ``depth`` bytes are those of the entry before."""
    out = np.full(max(0, len(array) - 1), depth, "i4")
    alive = np.arange(len(out))
    for done in range(0, depth, 8):
        differ = word_at(data, array[alive] + done) ^ word_at(data, array[alive + 1] + done)
        unlike = np.flatnonzero(differ)
        zeros = np.zeros(len(unlike), "i4")
        left = differ[unlike]
        for step in (32, 16, 8):
            low = left < (np.uint64(1) << np.uint64(64 - step))
            zeros += np.where(low, step // 8, 0).astype("i4")
            left = np.where(low, left << np.uint64(step), left)
        out[alive[unlike]] = np.minimum(depth, done + zeros)
        alive = np.delete(alive, unlike)
        if not len(alive):
            break
    return out
