"""The mixture: how near it comes to its targets, that its draws are exact, and that reruns agree."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessella.llm import mixing

DOCS = "doc_id long, text string, source string, key string, size long, part int, drawn int, row string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, 3, "r") for r in rows], DOCS).repartition(3)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """Of the words of each source, by handing the excess on again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest, free = total - sum(3 * sizes[s] for s in full), [s for s in names if s not in full]
        out = {s: 3 * sizes[s] for s in full} | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if out[s] > 3 * sizes[s]}
        if not over:
            return out
        full |= over


def check(got, docs):
    """Of rows of op10: sizes, targets, at most three times, and near the targets."""
    assert len(got) == len(docs)
    sizes, drawn, each = Counter(), Counter(), defaultdict(list)
    for _, t, s in docs:
        sizes[s] += words(t)
        each[s].append(words(t))
    want = targets(sizes)
    for r in got:
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        drawn[r["source"]] += r["taken"]
    for s, target in want.items():
        # what is nearest to the target of all that whole rounds and any documents once more add up to
        reach = 1
        for n in each[s]:
            reach |= reach << n
        rest = target - int(target // max(1, sizes[s])) * sizes[s]
        nearest = min(abs(i - rest) for i, bit in enumerate(bin(reach)[:1:-1]) if bit == "1")
        least = min((n for n in each[s] if n), default=0)
        assert abs(drawn[s] - target) <= max(nearest + least, 0.01 * target) + 1, (s, drawn[s], target, nearest)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sources_come_near_their_targets(spark, sf):
    folder = f"/root/testdata/{sf}"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = mixing.op10_mixing(spark, folder).collect()
    check(got, docs)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.op10_mixing(spark, folder).collect()))


def made(n, seed, most=20_000):
    rng = random.Random(seed)
    return [(i, " ".join("w" * rng.randint(1, 3) for _ in range(min(most, int(rng.paretovariate(0.8))))), rng.choice(["a", "a", "a", "b", "c", None, "é", "z"])) for i in range(n)]


HARD = [(1, None, "a"), (2, "", "b"), (3, " \n", "c"), (None, "one two", "a"), (4, "x\x85y \x1f", None), (5, "w " * 3000, "d"), (6, "one", "d"), (7, "s t", None), (7, "s t", None), (8, "s t", None)]


@pytest.mark.parametrize("rows", [HARD, made(40, 1), made(4000, 2), HARD[:2], [(1, "a b c", None)]])
def test_hard_tables(spark, rows, tmp_path):
    docs = table(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op10_mixing(spark, str(tmp_path)).collect()
    if rows is not HARD:
        check(got, rows)
    mixed = mixing.mix(docs, shards=3)
    assert mixed.columns == docs.columns and mixed.rdd.getNumPartitions() in (0, 3)
    first, again = (Counter(map(tuple, mixing.mix(docs).collect())) for _ in range(2))
    assert first == again
    in_mix = defaultdict(int)
    for (_, t, s, *_), n in first.items():
        in_mix[s] += n * words(t)
    for s in in_mix:
        assert in_mix[s] == sum(r["taken"] for r in got if r["source"] == s)


def test_a_border_that_is_looked_into(spark, tmp_path):
    """Few blocks, so that the rest comes from parts and documents."""
    rows = made(6000, 5, 60)
    docs = mixing.sized(table(spark, rows), blocks=4)
    by_block, _ = mixing.decisions(docs, blocks=4, shards=2)
    got = mixing.taken(docs, by_block).collect()
    assert any(r["last"] is not None and r["keys"] for r in by_block.collect())
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    want = targets(sizes)
    for s in want:
        assert abs(sum(r["size"] * len(r["drawn"]) for r in got if r["source"] == s) - want[s]) <= 2


def test_many_sources(spark):
    rows = [(i, "a b c d", f"s{i:05}") for i in range(3000)]
    by_block, shards = mixing.decisions(mixing.sized(table(spark, rows)), shards=5)
    drawn = [d for r in by_block.collect() for d in r["drawn"]]
    assert shards == 5
    per_shard = Counter(d["shard"] for d in drawn)
    assert len(per_shard) == 5 and max(per_shard.values()) - min(per_shard.values()) <= 1


def test_empty_table(spark, tmp_path):
    docs = table(spark, HARD).limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert mixing.op10_mixing(spark, str(tmp_path)).count() == 0 and mixing.mix(docs).count() == 0


def test_splitting_tree_keeps_quotas_and_totals():
    quotas, totals = np.array([17, 400, 0, 3, 5 * 10**9]), mixing.even(420 + 5 * 10**9, 7)
    parted = mixing.splitting_tree(quotas, totals, [1])
    assert (parted.sum(axis=1) == quotas).all() and (parted.sum(axis=0) == totals).all() and (parted >= 0).all()
    # a draw without replacement: mean and spread of a hypergeometric one
    first = np.array([mixing.splitting_tree(np.array([30, 70]), mixing.even(100, 4), [i])[0, 2] for i in range(3000)])
    assert abs(first.mean() - 7.5) < 0.15 and abs(first.var() - 25 * 0.3 * 0.7 * 75 / 99) < 0.4


def test_nearest_sum_by_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        sizes, room = np.array([rng.randint(1, 60) for _ in range(rng.randint(0, 9))], "i8"), rng.randint(1, 200)
        sums = [sum(c) for n in range(len(sizes) + 1) for c in itertools.combinations(sizes.tolist(), n)]
        assert sizes[mixing.nearest_sum(sizes, room, False)].sum() == max(x for x in sums if x <= room)
        assert abs(sizes[mixing.nearest_sum(sizes, room, True)].sum() - room) == min(abs(x - room) for x in sums)


def test_large_rooms_are_filled_from_below():
    rng = np.random.default_rng(4)
    sizes = rng.integers(10**9, 10**10, 1024)
    taken = mixing.fill(sizes, 10**12, rng.permutation(1024))
    assert 0 <= 10**12 - sizes[taken].sum() <= 3 * 10**7
