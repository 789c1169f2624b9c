"""Best lists of sets of terms against brute force, searches on odd tables against their SQL."""

import duckdb
import numpy as np
import pytest

from tessella.operators import sparse
from tessella.plans import passages, retrieval  # noqa: F401
from tessella.plans.registry import QUERIES, SQL


@pytest.mark.parametrize(("least", "own", "dense"), [(0.0, True, 64), (3.0, False, 2), (0.0, False, 10**9)])
def test_best_k_over_many_blocks(spark, monkeypatch, least, own, dense):
    for name, v in (("SOURCES", 7), ("TARGETS", 11), ("HELD", 3000), ("DENSE", dense), ("PAIRS", 50)):
        monkeypatch.setattr(sparse, name, v)
    r = np.random.default_rng(8)
    sets = [sorted({int(t) for t in r.zipf(1.3, int(r.integers(0, 25))) if t < 60}) for _ in range(80)]
    sets[40:50] = [sets[0]] * 10  # copies, so that scores tie
    weight = r.random((80, 60)).round(1)
    weight[40:50] = weight[0]
    rows = spark.createDataFrame([(i, s, [float(weight[i, t]) for t in s]) for i, s in enumerate(sets)], "id long, terms array<int>, weights array<double>").repartition(3)
    want = set()
    for i, s in enumerate(sets):
        all_of = [(-round(sum(weight[j, t] for t in s if t in o), 6), j, len({*s} & {*o})) for j, o in enumerate(sets) if own or i != j]
        best = sorted(x for x in all_of if -x[0] >= least and x[0] < 0)[:6]
        want |= {(i, j, -score, rank, n) for rank, (score, j, n) in enumerate(best, 1)}
    found = sparse.best_k(rows, rows, 6, least=least, own=own)
    assert {(x["src"], x["tgt"], x["score"], x["rank"], x["n_shared"]) for x in found.collect()} == want


def odd_documents(again):
    """A hundred documents, some without text, language or doc_id; with ``again`` also rows that share a doc_id."""
    r = np.random.default_rng(9)
    text = lambda: " ".join(r.choice(["a", "b", "Cc", "dd", "e", "f", "g", "h"], int(r.integers(0, 12)), p=[0.4, 0.3, 0.1, 0.1, 0.04, 0.03, 0.02, 0.01]))
    rows = [(i, text(), "en" if i % 3 else None) for i in range(120)] + [(None, "a dd h", "en"), (500, None, "en")]
    return rows + [(50, "h h g a", "de"), (50, None, None), (53, "a b e", "en"), (None, "h", "en")] * again


def agree(spark, folder, name, **tables):
    connection = duckdb.connect()
    for table, rows in tables.items():
        rows.write.parquet(f"{folder}/{table}.parquet")
        connection.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    want = connection.sql(SQL[name])
    got = QUERIES[name](spark, str(folder)).select(*want.columns)
    show = lambda rows: sorted(repr([round(float(v), 6) if v is not None else None for v in r]) for r in rows)
    rows = got.collect()
    assert rows and show(rows) == show(want.fetchall())


@pytest.mark.parametrize("name", ["search_lexical", "search_fused"])
@pytest.mark.parametrize("again", [0, 1])
def test_search_on_odd_tables(spark, tmp_path, name, again):
    """words of rows that share a doc_id are those of one document."""
    docs = spark.createDataFrame(odd_documents(again), "doc_id long, text string, lang string")
    x = np.random.default_rng(7).normal(size=(120, 4))
    vectors = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    agree(spark, tmp_path, name, documents=docs.selectExpr("*", "'s' source"), embeddings=vectors)


def test_search_shuffles_no_tokens(spark):
    """what is exchanged for a search has a row for each document or query, not one for each token or pair."""
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(300)), "en") for i in range(60)], "doc_id long, text string, lang string")
    queries = docs.limit(5).selectExpr("doc_id query_id", "text")
    found = retrieval.search(docs, queries, docs.select("doc_id"), "lexical", k=3)
    assert found.count() == 15
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(terms" not in plan and "CartesianProduct" in plan


def test_documents_are_weighed_where_they_are_packed(spark, monkeypatch):
    """one Python worker a task, not one that weighs documents and hands them to another that packs them."""
    docs = spark.createDataFrame([(i, f"w{i % 3} w{i % 5} x", "en") for i in range(60)], "doc_id long, text string, lang string")
    put, seen = sparse.kept, []
    monkeypatch.setattr(sparse, "kept", lambda rows, name: seen.append(rows) or put(rows, name))
    found = retrieval.search(docs, docs.limit(5).selectExpr("doc_id query_id", "text"), docs.where("doc_id % 2 = 0").select("doc_id"), "lexical", k=3)
    assert found.count() == 15 and found.where("doc_id % 2 = 1").count() == 0
    _, targets = seen
    assert str(targets._jdf.queryExecution().executedPlan()).count("MapInArrow") == 1


def test_conversations_share_words(spark, tmp_path):
    """conversations without conv_id or words, and turns that repeat; no row for each word that two of them share."""
    r = np.random.default_rng(3)
    rows = [(int(c), " ".join(f"W{w}" for w in r.zipf(1.2, 12) if w < 400)) for c in r.integers(0, 60, 200)] + [(70, None), (None, "w3 w4 w9"), (None, "w3 w90"), (71, " ")]
    talks = spark.createDataFrame([(c, i, t) for i, (c, t) in enumerate(rows)], "conv_id long, turn long, text string")
    agree(spark, tmp_path, "typescene_candidates", conversations=talks)
    plan = QUERIES["typescene_candidates"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "MergeJoin" not in plan and "HashJoin" not in plan
    talks.where("text is null").write.parquet(f"{tmp_path}/few/conversations.parquet")
    assert QUERIES["typescene_candidates"](spark, f"{tmp_path}/few").count() == 0
