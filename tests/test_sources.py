"""Readers and writers give back what was written; orders and graphs by brute force."""

import random

import numpy as np

from tessella.functions import stats, text
from tessella.operators import dense, graphs, permutation, runs
from tessella.sources import tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_topk_lists(spark, tmp_path):
    path = f"file://{tmp_path}/topk"
    listed = spark.createDataFrame([("verse", "v:1", 1, "v:17", 0.5), ("verse", "v:1", 2, "v:3", 0.25)], tables.TOPK)
    tables.write_topk(listed, path, {"model": "m", "k": "50"})
    got = tables.read_topk(spark, f"{path}/rows")
    assert rows(got.select("src", "tgt", "rank", "score")) == [(1, 17, 1, 0.5), (1, 3, 2, 0.25)]
    assert rows(spark.read.json(f"{path}/meta").select("model", "k")) == [("m", "50")]


def test_separated_files(spark, tmp_path):
    path, schema = f"file://{tmp_path}/csv", "id int, name string, x double"
    data = spark.createDataFrame([(1, 'a, "b"', 0.5), (2, None, None), (3, "é", -1.0)], schema)
    tables.write_csv(data, path)
    assert rows(tables.read_separated(spark, path, schema)) == rows(data)


def test_link_files(spark, tmp_path):
    for name, its in (("one", [("Gen", "Exod", 1), ("Gen", "Nope", 2)]), ("two", [("Lev", "Gen", 3), ("Nope", "Gen", 4)])):
        tables.write_csv(spark.createDataFrame(its, "a string, b string, n int"), f"file://{tmp_path}/{name}")
    known = spark.createDataFrame([("Gen",), ("Exod",), ("Lev",), ("Gen",)], "book string")
    got = tables.read_link_files(spark, [f"file://{tmp_path}/one", f"file://{tmp_path}/two"], "a string, b string, n int", known)
    assert sorted(r["n"] for r in got.collect()) == [1, 3]


def test_json_and_xml(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"a": 1, "b": "x"}\n{"a": 2}\n')
    assert rows(tables.read_json_lines(spark, f"file://{tmp_path}/lines.json", "a int, b string")) == [(1, "x"), (2, None)]
    (tmp_path / "book.json").write_text('{"title": "T", "text": [["one", "two"], [], ["three"]]}')
    got = tables.read_nested_verses(spark, f"file://{tmp_path}/book.json")
    assert rows(got.select("title", "chapter", "verse", "text")) == [("T", 1, 1, "one"), ("T", 1, 2, "two"), ("T", 3, 1, "three")]
    (tmp_path / "book.xml").write_text('<book><w id="1">one</w><w id="2">two</w></book>')
    assert rows(tables.read_xml_rows(spark, f"file://{tmp_path}/book.xml", "w", "_VALUE string, _id long").select("_id", "_VALUE")) == [(1, "one"), (2, "two")]


def test_partitioned_and_kept_tables(spark, tmp_path):
    data = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "id int, kind string")
    tables.write_partitioned(data, f"file://{tmp_path}/parts", ["kind"])
    assert rows(spark.read.parquet(f"file://{tmp_path}/parts").where("kind = 'a'").select("id")) == sorted([(i,) for i in range(0, 20, 2)], key=repr)
    assert rows(tables.kept(data, "test")) == rows(data)


def test_exchanges_by_hand(spark):
    rng, turns = random.Random(5), []
    for c in range(30):
        for t in range(rng.randint(1, 12)):
            turns.append((c, t, rng.choice("abc")))
    want = []
    for c in range(30):
        said = [r for k, _, r in turns if k == c]
        i = 0
        while i + 1 < len(said):
            if said[i] == said[i + 1]:
                i += 1
                continue
            j = i + 1
            while j + 1 < len(said) and said[j + 1] == said[j - 1] and said[j + 1] != said[j]:
                j += 1
            want.append((c, i, j, j - i + 1, said[i], said[i + 1]))
            i = j
    got = runs.exchanges(spark.createDataFrame(turns, "conv long, turn long, role string"), "conv", "turn", "role")
    assert rows(got) == sorted(want, key=repr)


def test_page_rank_by_power_iteration(spark):
    rng = random.Random(1)
    edges = [(a, b, rng.random()) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.4 or b == a + 1]
    weight = np.zeros((12, 12))
    for a, b, w in edges:
        weight[a, b] = weight[b, a] = w
    rank = np.full(12, 1 / 12)
    for _ in range(20):
        rank = 0.15 / 12 + 0.85 * (weight / weight.sum(axis=1, keepdims=True)).T @ rank
    got = {r["id"]: r["rank"] for r in graphs.page_rank(spark.createDataFrame(edges, "a long, b long, weight double")).collect()}
    assert np.allclose([got[i] for i in range(12)], rank)


def test_communities_of_two_cliques(spark):
    edges = [(a, b, 1.0) for base in (0, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 10, 0.1)]
    got = {r["id"]: r["community"] for r in graphs.communities(spark.createDataFrame(edges, "a long, b long, weight double")).collect()}
    assert len({got[i] for i in range(5)}) == len({got[i] for i in range(10, 15)}) == 1 and got[0] != got[12]


def test_permuted_labels_keep_their_numbers(spark):
    data = spark.createDataFrame([(i, i % 3, i % 4 == 0) for i in range(60)], "n long, g long, inside boolean")
    drawn = permutation.permuted(data, "n", ["g"], "inside", 5)
    counts = {(r["draw"], r["g"]): r["c"] for r in drawn.where("inside").groupBy("draw", "g").count().withColumnRenamed("count", "c").collect()}
    assert counts == {(d, g): 5 for d in range(6) for g in range(3)}
    assert rows(drawn.where("draw = 0").select("n", "g", "inside")) == rows(data)


def test_small_functions(spark):
    one = spark.createDataFrame([(1994, "One.  Two one. ", [1.0, 2.0, 3.0])], "y int, t string, null_ array<double>")
    got = one.select(text.roman(one["y"]).alias("r"), text.sentences(one["t"]).alias("s"), stats.empirical_p(one["y"], one["null_"]).alias("p")).first()
    assert tuple(got) == ("MCMXCIV", ["One", "Two one"], 0.25)
    pairs = spark.createDataFrame([("A", 1, "B", 5, 0.5), ("A", 1, "B", 6, 0.75), ("A", 2, "B", 5, 0.25), ("A", 2, "B", 6, 0.0)], "a_unit string, a int, b_unit string, b int, score double")
    assert dense.best_match_average(pairs).first()["score"] == (0.5 + 0.625) / 2
