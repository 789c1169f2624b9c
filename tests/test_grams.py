"""Frequent n-grams against brute force: copies, rows of the same doc_id, short and empty texts, hashes that collide."""

from collections import Counter

import numpy as np
import pytest

from tessella.operators import grams


def brute(rows, least, most, more):
    docs, total = {}, Counter()
    for i, t in rows:
        ws = (t or "").lower().split()
        for n in range(least, most + 1):
            for k in range(len(ws) - n + 1):
                g = (n, " ".join(ws[k : k + n]))
                docs.setdefault(g, set()).add(i)
                total[g] += 1
    return {(*g, len(d), total[g]) for g, d in docs.items() if len(d) > more}


@pytest.mark.parametrize("again", [False, True])
def test_frequent_ngrams(spark, monkeypatch, again):
    monkeypatch.setattr(grams, "HELD", 500)
    monkeypatch.setattr(grams, "ENTRIES", 200)
    r = np.random.default_rng(4)
    rows = [(i, " ".join(r.choice(["a", "B", "c", "dd"], int(r.integers(0, 40))))) for i in range(60)] + [(60, None), (61, "x y"), (62, "a a a a a a a a")]
    rows += [(5, "a a a dd dd")] * again
    data = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {(x["n"], x["ngram"], x["n_docs"], x["n_total"]) for x in grams.frequent_ngrams(data, 3, 6, 5).collect()} == brute(rows, 3, 6, 5)


def test_only_hashes_of_the_shortest_move(spark):
    """A report has four bytes for a document's distinct 3-gram, whatever the words' lengths."""
    data = spark.createDataFrame([(i, " ".join(f"{'w' * 40}{i}x{k}" for k in range(1000))) for i in range(20)], "doc_id long, text string")
    held = grams.worded(data, "doc_id").select("hs").mapInArrow(grams._report(3, 16, 4), "slot int, held binary").selectExpr("sum(length(held)) x").first()["x"]
    assert held == 20 * 998 * 4


def test_marks_move_no_words(spark):
    """Words inside formulas are marked in their document's row; a place that only the flattened words have is no occurrence."""
    from tessella.operators import lexical

    rows = [(1, "a b c x a b c"), (2, "z a b"), (3, "c q"), (4, None), (5, "b c"), (5, "a b c d"), (None, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    formulas = spark.createDataFrame([(3, "a b c"), (2, "b c")], "n int, ngram string")
    got = {r["doc_id"]: (round(r["weight"], 6), r["n_inside"]) for r in lexical.document_weights(docs, formulas, 0.2).collect()}
    # both rows of 5 have what is inside in one of them: words 0, 1 (and 2, which only the longer one has)
    assert got == {1: (2.2, 6), 2: (3.0, 0), 3: (2.0, 0), 5: (2.0, 5), None: (3.0, 0)}
    assert "SortMergeJoin" not in lexical.document_weights(docs, formulas, 0.2)._jdf.queryExecution().executedPlan().toString()
    assert lexical.document_weights(docs, formulas.where("n > 9"), 0.2).where("doc_id = 1").first()["weight"] == 7.0
