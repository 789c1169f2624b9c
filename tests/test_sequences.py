"""q values, cuts and permutations of long sequences against brute force."""

import numpy as np
import pytest

from tessella.functions import stats
from tessella.operators import permutation, runs


@pytest.mark.parametrize("by", [None, ["g"]])
def test_q_values_of_many_rows(spark, by):
    """40,000 rows; with frames that reach to the end each row reads all later ones."""
    p = np.random.default_rng(1).integers(0, 9000, 40_000) / 9001
    g = np.arange(40_000) % 3 if by else np.zeros(40_000, "i8")
    rows = spark.createDataFrame(list(zip(range(40_000), g.tolist(), p.tolist(), strict=True)) + [(-1, 0, None), (-2, 0, float("nan"))], "id long, g long, p double")
    got = {r["id"]: r["q"] for r in stats.with_bh_q(rows, "p", by=by).collect()}
    assert len(got) == 40_002 and got[-1] is None and got[-2] is None
    for family in np.unique(g):
        at = np.nonzero(g == family)[0]
        raw = p[at] * len(at) / np.searchsorted(np.sort(p[at]), p[at], side="right")
        order = np.argsort(-p[at], kind="stable")
        q = np.empty(len(at))
        q[order] = np.minimum(np.minimum.accumulate(raw[order]), 1)
        best = {v: q[p[at] == v].min() for v in np.unique(p[at])[::500]}
        assert all(got[int(i)] == pytest.approx(best[v]) for i, v in zip(at, p[at], strict=True) if v in best)


def test_three_parts_of_a_long_sequence(spark):
    """6,000 positions are 18 million pairs of cuts."""
    rate = np.repeat([0.2, 0.6, 0.3], 2000)
    hits = np.random.default_rng(2).binomial(40, rate)
    rows = spark.createDataFrame([(i, int(h), 40) for i, h in enumerate(hits)], "at long, h long, n long")
    got = runs.best_three_parts(rows.repartition(4), "at", "h", "n", 3).first()
    assert abs(got["i"] - 2000) < 20 and abs(got["j"] - 4000) < 20
    assert runs.best_three_parts(rows.limit(5), "at", "h", "n", 3).count() == 0 and runs.best_three_parts(rows.limit(0), "at", "h", "n", 3).count() == 0


def test_differences_are_those_of_permuted_rows(spark):
    """the packed draws equal those of the windows."""
    r = np.random.default_rng(3)
    data = [(int(n), int(n) % 3, bool(r.random() < 0.3), float(r.random())) for n in r.permutation(90)] + [(1000, 7, True, 1.0)]
    rows = spark.createDataFrame(data, "n long, stratum long, inside boolean, value double")
    sums = permutation.permuted(rows, "n", ["stratum"], "inside", 12).selectExpr("stratum", "draw", "case when inside then value end a", "case when not inside then value end b").groupBy("stratum", "draw").agg({"a": "avg", "b": "avg"})
    want = {(x["stratum"], x["draw"]): x["avg(a)"] - x["avg(b)"] if x["avg(b)"] is not None else None for x in sums.collect()}
    got = {(x["stratum"], x["draw"]): x["diff"] for x in permutation.permuted_differences(rows, 12).collect()}
    assert got == {k: v if v is None else pytest.approx(v) for k, v in want.items()}
