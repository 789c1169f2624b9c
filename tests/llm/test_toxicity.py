"""The fit of the severity model: its features and its optimum by brute force, and what few labels are worth."""

import random
from collections import Counter

import numpy as np
import pytest

from tessella.llm import toxicity

MARKS = ["vilex", "grubnot", "zorkel", "snivver", "blatherg", "muckrat"]


def corpus(n, seed=4):
    """Documents of made-up words; every sixth one is toxic and has three to six marked words."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(2000)]
    rows = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(60)] + ([rng.choice(MARKS) for _ in range(rng.randint(3, 6))] if i % 6 == 0 else [])
        rng.shuffle(t)
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize("n", [60, 100, 200, 400])
def test_few_labels_find_held_out_documents(spark, n):
    rows = corpus(1200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(n)], "doc_id long, toxic int"))
    score = model.scorer()
    caught = [score(t)[0] >= 0.5 for i, t in rows if i >= n and i % 6 == 0]
    wrong = [score(t)[0] >= 0.5 for i, t in rows if i >= n and i % 6]
    assert np.mean(caught) >= 0.9 and np.mean(wrong) <= 0.02


def test_features_by_brute_force(spark):
    rows, n = corpus(90), 90
    toxic = {i: int(i % 6 == 0) for i, _ in rows}
    docs, hits = Counter(), Counter()
    for i, t in rows:
        its = {f for w in toxicity.words_of(t) for f in toxicity.features(w)}
        docs.update(its)
        if toxic[i]:
            hits.update(its)
    share = sum(toxic.values()) / n
    chi2 = {}
    for f, d in docs.items():
        if d >= 2:
            a, b = hits[f], d - hits[f]  # toxic and clean documents that have it, and by chance would
            c, e = n * share - a, n * (1 - share) - b
            chi2[f] = round(sum((o - x) ** 2 / x for o, x in ((a, d * share), (b, d * (1 - share)), (c, (n - d) * share), (e, (n - d) * (1 - share)))), 6)
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int"))
    least = min(chi2[f] for f in model.known)
    assert len(model.known) == n // 2
    assert {f for f, x in chi2.items() if x > least} <= set(model.known)


def test_the_fit_is_an_optimum():
    rng = np.random.default_rng(3)
    n, k = 300, 5
    x = rng.poisson(0.7, (n, k))
    grades = np.clip((x @ np.array([1.5, 0.8, 0, 0, -1]) + rng.logistic(0, 0.7, n)).round(), 0, 3).astype("i8")
    doc_of, at = np.nonzero(x)
    strength = toxicity.strength(x[doc_of, at])
    weights, thresholds = toxicity.descend(doc_of, at, strength, grades, k)

    def loss(w, theta):
        """Of each document's grade directly, one document at a time."""
        total = 0.0
        for i in range(n):
            s = sum(w[j] * (1 + np.log(x[i, j])) for j in range(k) if x[i, j])
            above = [1.0, *(1 / (1 + np.exp(t - s)) for t in theta), 0.0]
            total -= np.log(above[grades[i]] - above[grades[i] + 1])
        return total / n + toxicity.RIDGE / n * (w @ w) / 2

    best = loss(weights, thresholds)
    assert (np.diff(thresholds) > 0).all()
    for _ in range(60):
        step = rng.standard_normal(k + 3) * 10.0 ** rng.uniform(-3, -1)
        assert loss(weights + step[:k], thresholds + step[k:]) > best - 1e-6


def test_one_label_of_each_kind(spark):
    docs = spark.createDataFrame([(1, "vilex you"), (2, "good day"), (3, "vilex"), (4, "day")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["severity"] for r in toxicity.score(docs, model).collect()}
    assert got[3] >= got[4]
