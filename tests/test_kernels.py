"""Alignments, chains and statistics against answers worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tessella.functions import stats, text
from tessella.operators import graphs, kernels, lexical, lists, runs, serving


def test_local_alignment_of_unit_weights():
    assert kernels.local_alignment("x p q r y".split(), "p q z r".split())[1] == [(1, 0), (2, 1)]


def test_local_alignment_crosses_a_gap_for_heavy_words():
    score, places = kernels.local_alignment("x p q r y".split(), "p q z r".split(), {"p": 5, "q": 5, "r": 5}, gap=1.5)
    assert score == 13.5 and places == [(1, 0), (2, 1), (3, 3)]


def test_local_alignment_keeps_order():
    assert len(kernels.local_alignment("p q r".split(), "r q p".split())[1]) == 1


def test_word_operations_find_moves():
    ops = kernels.word_operations("a b c d".split(), "b c d a".split())
    assert [o for o, _, _ in ops].count("same") == 3
    assert [o for o, _, _ in ops].count("moved") == 2


def test_longest_common():
    assert kernels.longest_common(list("abcbdab"), list("bdcaba")) == 4
    assert kernels.longest_common([], ["a"]) == 0


def test_chain_of_pairs():
    pairs = [(2, 22, 1.0), (3, 23, 1.0), (5, 25, 1.0), (6, 26, 1.0)]
    assert kernels.chains(pairs) == [[0, 1, 2, 3]]
    assert kernels.chains(pairs[:2]) == []
    assert kernels.chains([(a, 30 - b, w) for a, b, w in pairs]) == []
    assert kernels.chains([(a, 60 - b, w) for a, b, w in pairs], backward=True) == [[0, 1, 2, 3]]
    assert kernels.chains([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)]) == []


def test_equidistant_letters():
    assert kernels.equidistant("axbxcx", "abc", 1, 3) == [(0, 2)]
    assert kernels.equidistant("axbxcx", "cba", 1, 3) == [(4, -2)]
    assert kernels.equidistant("aba", "aba", 1, 2) == [(0, 1)]


def test_empirical_p(spark):
    row = spark.range(1).select(stats.empirical_p(F.lit(5.0), F.array(*map(F.lit, (1.0, 2.0, 3.0)))).alias("a"), stats.empirical_p(F.lit(2.0), F.array(*map(F.lit, (1.0, 2.0, 3.0)))).alias("b")).first()
    assert (row["a"], row["b"]) == (0.25, 0.75)


def test_bh_q(spark):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate((0.04, 0.01, 0.03, 0.5, float("nan"), None))], "i int, p double")
    q = {r["i"]: r["q"] for r in stats.with_bh_q(rows, "p").collect()}
    assert [round(q[i], 4) for i in range(4)] == [0.0533, 0.04, 0.0533, 0.5]
    assert q[4] is None and q[5] is None


def test_pooled_q(spark):
    seen = spark.createDataFrame([(5.0,), (3.0,), (3.0,), (1.0,)], "score double")
    null = spark.createDataFrame([(x,) for x in (4.0, 2.0, 2.0, 1.0)], "score double")
    q = {r["score"]: r["q"] for r in stats.pooled_q(seen, null, 2).collect()}
    assert q == {5.0: 0.0, 3.0: pytest.approx(0.5 / 3), 1.0: 0.5}


def test_g2_and_tail(spark):
    a, b, c, d = 12, 30, 8, 150
    n, want = a + b + c + d, 0.0
    for o, r, k in ((a, a + b, a + c), (b, a + b, b + d), (c, c + d, a + c), (d, c + d, b + d)):
        want += 2 * o * math.log(o * n / (r * k))
    row = spark.range(1).select(stats.g2_two_by_two(*(F.lit(float(x)) for x in (a, b, c, d))).alias("g"), stats.g2_two_by_two(*(F.lit(float(x)) for x in (0, 5, 0, 7))).alias("zero"), stats.chi2_tail(F.lit(3.841458820694124)).alias("p")).first()
    assert row["g"] == pytest.approx(want) and row["zero"] == 0.0 and row["p"] == pytest.approx(0.05, abs=1e-6)


def test_rrf(spark):
    ddl = "src long, tgt long, rank long, score double"
    lex = spark.createDataFrame([(0, 1, 1, 9.0), (0, 2, 2, 8.0)], ddl)
    sem = spark.createDataFrame([(0, 3, 1, 0.9), (0, 1, 2, 0.8)], ddl)
    got = lists.rrf([("lex", 0.5, lex), ("sem", 1.0, sem)]).orderBy("rank").collect()
    assert [(r["tgt"], r["score"]) for r in got] == [(1, pytest.approx(0.5 / 61 + 1 / 62)), (3, pytest.approx(1 / 61)), (2, pytest.approx(0.5 / 62))]
    assert got[1]["lex_rank"] is None


def test_ties_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(0, t, 1.0) for t in (5, 4, 3)], "src long, tgt long, score double")
    assert [r["tgt"] for r in lexical.ranked(rows, 2, "src", "tgt").orderBy("rank").collect()] == [3, 4]


def test_pair_weight_takes_the_better_direction(spark):
    rows = spark.createDataFrame([(1, 2, 4, 0.1), (2, 1, 1, 0.1), (1, 3, 3, 0.1)], "src long, tgt long, rank long, score double")
    assert {(r["a"], r["b"]): r["weight"] for r in lists.pair_weights(rows, 3).collect()} == {(1, 2): 1.0, (1, 3): pytest.approx(1 / 3)}


def test_mutual_best_keeps_ties(spark):
    pairs = spark.createDataFrame([(1, 2, 5.0), (2, 3, 5.0), (3, 4, 1.0)], "a long, b long, score double")
    assert lists.mutual_best(pairs).count() == 2


def test_measures_count_queries_without_a_list(spark):
    gold = spark.createDataFrame([(0, 1), (0, 2), (9, 1)], "src long, tgt long")
    rows = spark.createDataFrame([(0, 7, 1, 0.5), (0, 1, 2, 0.4)], "src long, tgt long, rank long, score double")
    got = {r["src"]: r for r in lists.measures(gold, rows, 10).collect()}
    assert (got[0]["recall"], got[0]["mrr"]) == (0.5, 0.5)
    assert got[0]["ndcg"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert (got[9]["recall"], got[9]["mrr"], got[9]["ndcg"]) == (0.0, 0.0, 0.0)


def test_auc_has_ties_half(spark):
    rows = spark.createDataFrame([(1, 3.0), (0, 1.0), (1, 1.0), (0, 0.0)], "y int, s double")
    assert lists.auc(rows, "y", "s").first()["auc"] == pytest.approx(3.5 / 4)


def test_exchange_ends_with_a_third_party(spark):
    turns = [(1, i, r) for i, r in enumerate(["u", "a", "u", "s", "u", "s"])] + [(2, 0, "u"), (2, 1, "u")]
    got = runs.exchanges(spark.createDataFrame(turns, "c long, t long, r string"), "c", "t", "r").collect()
    assert sorted((r["first"], r["last"], r["turns"], r["a"], r["b"]) for r in got) == [(0, 2, 3, "u", "a"), (2, 5, 4, "u", "s")]


def test_ranges_expand(spark):
    links = spark.createDataFrame([(1, 2, 11, 12), (20, 20, 30, 31), (40, 44, 50, 51)], "a long, a_end long, b long, b_end long")
    got = {(r["src"], r["tgt"]): r["rule"] for r in serving.expand_ranges(links).collect()}
    assert got == {(1, 11): "positional", (11, 1): "positional", (2, 12): "positional", (12, 2): "positional", (20, 30): "cartesian", (30, 20): "cartesian", (20, 31): "cartesian", (31, 20): "cartesian"}


def test_builds_compare_null_safe(spark):
    ddl = "k long, v double, s string"
    old = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b"), (None, 3.0, "c")], ddl)
    new = spark.createDataFrame([(1, 1.0001, "a"), (3, 2.0, "b"), (None, 3.0, None)], ddl)
    got = {r["k"]: r["change"] for r in serving.compare_builds(old, new, ["k"], ["v", "s"], 0.01).collect()}
    assert got == {2: "removed", 3: "added", None: "s"}


def test_closure_and_rank(spark):
    links = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (5, 4)], "child long, parent long")
    assert {(r["child"], r["ancestor"]): r["depth"] for r in graphs.ancestors(links).collect()}[(5, 1)] == 4
    ring = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0)], "a long, b long, weight double")
    assert all(r["rank"] == pytest.approx(1 / 3) for r in graphs.page_rank(ring).collect())


def test_text_functions(spark):
    row = spark.createDataFrame([("Abc  d\n", 1994)], "t string, n int").select(text.words(F.col("t")).alias("w"), text.ngrams(text.words(F.col("t")), 2).alias("g"), text.ordinal_value(F.lit("abz")).alias("o"), text.mirror_cipher(F.lit("az")).alias("m"), text.roman(F.col("n")).alias("r")).first()
    assert (row["w"], row["g"], row["o"], row["m"], row["r"]) == (["abc", "d"], ["abc d"], 29, "za", "MCMXCIV")


def test_formula_weights_and_closed(spark):
    docs = spark.createDataFrame([(i, "a b c d") for i in range(3)] + [(9, "x a b c")], "doc_id long, text string")
    grams = lexical.frequent_ngrams(docs, 2, 4, 2)
    assert {(r["ngram"], r["n_docs"]) for r in lexical.closed(grams).collect()} == {("a b c d", 3), ("a b c", 4)}
    weights = lexical.formula_weights(docs, grams.where("n = 3"), 0.2)
    assert {r["idx"]: r["weight"] for r in weights.where("doc_id = 9").collect()} == {0: 1.0, 1: 0.2, 2: 0.2, 3: 0.2}


def test_segment_measures():
    from tessella.operators import segments

    assert segments.gap_cosines([["a"], ["a"], ["b"]], 1) == [1.0, 0.0]
    assert segments.depths([0.9, 0.1, 0.5]) == pytest.approx([0.0, 1.2, 0.0])
    assert segments.pk([0, 1, 0, 0], [0, 0, 0, 1], 2) == pytest.approx(1.0)
    assert segments.window_diff([0, 1, 1, 0], [0, 1, 0, 0], 2) == pytest.approx(2 / 3)
    assert math.isnan(segments.pk([0], [0], 2))
