"""Best lists by blocks against brute force, and lists whose gold is a unit."""

import numpy as np
import pytest

from tessella.operators import dense, lists


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 7)


def made(n: int):
    x = np.random.default_rng(5).normal(size=(n, 6)).astype("f4").astype("f8")
    x[n // 2 :: 9] = x[0]  # copies, so that scores tie across blocks
    return x / np.sqrt((x * x).sum(1, keepdims=True)), x


def test_best_k_over_many_blocks(spark, small_blocks):
    unit, x = made(90)
    rows = spark.createDataFrame([(i, v.tolist(), 0.0) for i, v in enumerate(x)], "id long, v array<double>, minus double").repartition(3)
    score = np.round(unit @ unit.T, 6)
    want = {(i, t, r) for i in range(90) for r, t in enumerate(sorted((j for j in range(90) if j != i), key=lambda j: (-score[i, j], j))[:8], 1)}
    assert {(r["src"], r["tgt"], r["rank"]) for r in dense.best_k(rows, rows, 8).collect()} == want


def test_a_source_leaves_a_task_once(spark, small_blocks):
    """No row for each source, block of targets and entry of its list is made."""
    _, x = made(90)
    rows = spark.createDataFrame([(i, v.tolist(), 0.0) for i, v in enumerate(x)], "id long, v array<double>, minus double").repartition(3)
    pairs, width = dense._beside(rows, rows)
    assert pairs.mapInArrow(dense._best(8, 1.0, True, width), "src long, best array<struct<less: double, tgt: long>>").count() == 90


def test_best_in_units(spark, small_blocks):
    unit, x = made(60)
    rows = spark.createDataFrame([(i, v.tolist(), 0.0, i % 4 if i % 4 < 3 else None) for i, v in enumerate(x)], "id long, v array<double>, minus double, unit int")
    c = unit @ unit.T
    want = {(i, i % 4, u): max(c[i, j] for j in range(u, 60, 4)) for i in range(60) if i % 4 < 3 for u in range(3) if u != i % 4}
    got = {(r["src"], r["unit"], r["other"]): r["m"] for r in dense.best_in_units(rows).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_gold_by_units_is_never_spelled_out(spark):
    """20,000 vectors of one unit would be 400 million pairs."""
    unit_of = spark.range(20_000).selectExpr("id", "1 as unit").unionByName(spark.createDataFrame([(20_000, 2), (20_001, None)], "id long, unit int"))
    found = spark.createDataFrame([(0, 20_000, 1, 0.9), (0, 5, 2, 0.8), (20_001, 5, 1, 0.7)], "src long, tgt long, rank long, score double")
    got = {r["src"]: r for r in lists.measures_by_unit(unit_of, found, 10).where("src in (0, 1, 20000, 20001)").collect()}
    assert set(got) == {0, 1} and got[0]["recall"] == pytest.approx(1 / 19_999) and got[0]["mrr"] == 0.5 and got[1]["recall"] == 0.0
    assert [tuple(r) for r in lists.discoveries(found, unit_of, 10).collect()] == [(0, 20_000, 0.9, 1, None)]
