"""Queries on vectors and on the lists that they give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import dense, lists
from tessella.plans.registry import query
from tessella.sources.tables import kept, load

SQL_COS = """v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
cos AS (SELECT a.id AS src, b.id AS tgt, a.label AS src_label, b.label AS tgt_label, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.id <> b.id),
knn AS (SELECT src, tgt, round(c, 6) AS score, row_number() OVER (PARTITION BY src ORDER BY round(c, 6) DESC, tgt) AS rank FROM cos QUALIFY rank <= 50),
r AS (SELECT src AS id, avg(score) AS r FROM knn WHERE rank <= 10 GROUP BY src),
csls AS (SELECT src, tgt, score, row_number() OVER (PARTITION BY src ORDER BY score DESC, tgt) AS rank FROM
  (SELECT src, tgt, round(2 * c - x.r - y.r, 6) AS score FROM cos JOIN r x ON x.id = src JOIN r y ON y.id = tgt) QUALIFY rank <= 50)"""


def knn(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    v = dense.vectors(load(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return dense.best_k(v, v, k)


def csls(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    return dense.csls_topk(dense.vectors(load(spark, sf_dir, "embeddings"), "vec_id", "embedding"), k)


def knn_and_csls(spark: SparkSession, sf_dir: str, k: int = 50) -> tuple[DataFrame, DataFrame]:
    """Both lists from two passes: that of cosines is put aside and gives the means that the other one needs."""
    v = dense.vectors(load(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    near = kept(dense.best_k(v, v, k), "nearest")
    return near, dense.csls_topk(v, k, near=near)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("unit"))


def vector_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` of the rows that have a vector."""
    rows = load(spark, sf_dir, "embeddings").where("vec_id is not null and embedding is not null")
    return rows.select(F.col("vec_id").alias("id"), F.col("label").alias("unit"))


def labelled(rows: DataFrame, unit_of: DataFrame) -> DataFrame:
    """With src_label and tgt_label."""
    a = unit_of.select(F.col("id").alias("src"), F.col("unit").alias("src_label"))
    return rows.join(a, "src").join(a.toDF("tgt", "tgt_label"), "tgt")


@query("cosine_topk", f"WITH {SQL_COS} SELECT src, tgt, score, rank FROM knn")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(spark, sf_dir).select("src", "tgt", "score", "rank")


@query("hubness", f"WITH {SQL_COS} SELECT id, round(r, 6) AS r FROM r")
def hubness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.hubness(dense.vectors(load(spark, sf_dir, "embeddings"), "vec_id", "embedding")).select("id", F.round("r", 6).alias("r"))


@query("csls_topk", f"WITH {SQL_COS} SELECT src, tgt, score, rank FROM csls WHERE rank <= 10")
def csls_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csls(spark, sf_dir, 10).select("src", "tgt", "score", "rank")


@query("mean_unit_vectors", """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM embeddings), m AS (SELECT label, dim, avg(x) AS x FROM e GROUP BY ALL)
SELECT label, dim::INT AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m""")
def mean_unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    return dense.mean_vectors(rows, "label").select("label", F.posexplode("v").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query("bma_units", f"""WITH {SQL_COS}, p AS (SELECT src_label AS a_unit, tgt_label AS b_unit, src, tgt, c FROM cos WHERE src_label < tgt_label),
x AS (SELECT a_unit, b_unit, avg(m) AS x FROM (SELECT a_unit, b_unit, src, max(c) AS m FROM p GROUP BY ALL) GROUP BY ALL), y AS (SELECT a_unit, b_unit, avg(m) AS y FROM (SELECT a_unit, b_unit, tgt, max(c) AS m FROM p GROUP BY ALL) GROUP BY ALL)
SELECT a_unit, b_unit, round((x + y) / 2, 5) AS score FROM x JOIN y USING (a_unit, b_unit)""")
def bma_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-match averages of labels: every vector's best one in each other label, in one pass over all pairs of blocks."""
    v = dense.unit_vectors(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    each = dense.best_in_units(v).groupBy("unit", "other").agg(F.avg("m").alias("x"))
    back = each.select(F.col("unit").alias("b_unit"), F.col("other").alias("a_unit"), F.col("x").alias("y"))
    out = each.select(F.col("unit").alias("a_unit"), F.col("other").alias("b_unit"), "x").where("a_unit < b_unit").join(back, ["a_unit", "b_unit"])
    return out.select("a_unit", "b_unit", F.round((F.col("x") + F.col("y")) / 2, 5).alias("score"))


SQL_RRF = SQL_COS + """, fused AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, tgt) AS rank FROM
  (SELECT src, tgt, round(coalesce(0.5 / (60 + k.rank), 0) + coalesce(1.0 / (60 + c.rank), 0), 9) AS score, k.rank AS cos_rank, c.rank AS csls_rank FROM knn k FULL JOIN csls c USING (src, tgt)) QUALIFY rank <= 50)"""


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    near, far = knn_and_csls(spark, sf_dir)
    return lists.rrf([("cos", 0.5, near), ("csls", 1.0, far)])


@query("rrf_fuse", f"WITH {SQL_RRF} SELECT src, tgt, score, rank, cos_rank, csls_rank FROM fused")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).select("src", "tgt", "score", "rank", "cos_rank", "csls_rank")


SQL_DOT = SQL_COS + """, dot AS (SELECT src, tgt, score, row_number() OVER (PARTITION BY src ORDER BY score DESC, tgt) AS rank FROM
  (SELECT a.id AS src, b.id AS tgt, round(list_dot_product(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.id <> b.id) QUALIFY rank <= 50)"""


@query("rrf_three_lists", SQL_DOT.join(["WITH ", """, f AS (SELECT src, tgt, round(coalesce(0.5 / (60 + k.rank), 0) + coalesce(1.0 / (60 + c.rank), 0) + coalesce(0.25 / (60 + d.rank), 0), 9) AS score
FROM knn k FULL JOIN csls c USING (src, tgt) FULL JOIN dot d USING (src, tgt)) SELECT src, tgt, score, row_number() OVER (PARTITION BY src ORDER BY score DESC, tgt) AS rank FROM f QUALIFY rank <= 20"""]))
def rrf_three_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = dense.vectors(load(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    near, far = knn_and_csls(spark, sf_dir)
    three = [("cos", 0.5, near), ("csls", 1.0, far), ("dot", 0.25, dense.best_k(v, v, 50, cosine=False))]
    return lists.rrf(three, most=20).select("src", "tgt", "score", "rank")


@query("rerank_blend", f"""WITH {SQL_COS}, s AS (SELECT k.src, k.tgt, k.rank AS fused_rank, c.score AS ce, row_number() OVER (PARTITION BY k.src ORDER BY c.score DESC, k.tgt) AS second_rank FROM knn k JOIN csls c ON k.src = c.src AND k.tgt = c.tgt)
SELECT src, tgt, fused_rank, second_rank, blend, row_number() OVER (PARTITION BY src ORDER BY blend DESC, tgt) AS rank FROM (SELECT *, round(0.5 / (60 + second_rank) + 1.0 / (60 + fused_rank), 9) AS blend FROM s)""")
def rerank_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    near, far = knn_and_csls(spark, sf_dir)
    rows = near.drop("score").join(far.select("src", "tgt", F.col("score").alias("ce")), ["src", "tgt"])
    return lists.rerank_blend(rows, "ce", 0.5).select("src", "tgt", "fused_rank", "second_rank", "blend", "rank")


SQL_FILTERED = SQL_COS + ", kept AS (SELECT k.*, a.label AS src_label, b.label AS tgt_label FROM knn k JOIN v a ON a.id = src JOIN v b ON b.id = tgt WHERE NOT (a.label = b.label AND abs(src - tgt) <= 20))"


def filtered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, object]:
    rows = labelled(knn(spark, sf_dir), labels(spark, sf_dir)).withColumnsRenamed({"src_label": "src_book", "tgt_label": "tgt_book"})
    return rows, lists.excluded(window=20)


@query("filters_rerank", f"WITH {SQL_FILTERED} SELECT src, tgt, score, row_number() OVER (PARTITION BY src ORDER BY rank) AS rank FROM kept")
def filters_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, drop = filtered(spark, sf_dir)
    return lists.filter_and_rerank(rows, drop).select("src", "tgt", "score", "rank")


@query("similar_lookup", f"WITH {SQL_FILTERED} SELECT src, tgt, score, rank FROM kept QUALIFY row_number() OVER (PARTITION BY src ORDER BY rank) <= 10")
def similar_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten that the exclusions leave, with their stored ranks."""
    rows, drop = filtered(spark, sf_dir)
    return lists.filter_and_rerank(rows.withColumn("stored", F.col("rank")), drop).where("rank <= 10").select("src", "tgt", "score", F.col("stored").alias("rank"))


SQL_GOLD = SQL_COS + ", gold AS (SELECT a.id AS src, b.id AS tgt FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id)"


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label are relevant to each other."""
    unit_of = labels(spark, sf_dir)
    return unit_of.toDF("src", "unit").join(unit_of.toDF("tgt", "unit"), "unit").where("src <> tgt").select("src", "tgt")


@query("discoveries", f"""WITH {SQL_COS} SELECT least(k.src, k.tgt) AS a, greatest(k.src, k.tgt) AS b, max(k.score) AS score, max(CASE WHEN k.src < k.tgt THEN k.rank END) AS rank_ab, max(CASE WHEN k.src > k.tgt THEN k.rank END) AS rank_ba
FROM knn k JOIN v x ON x.id = k.src JOIN v y ON y.id = k.tgt WHERE k.rank <= 10 AND x.label <> y.label GROUP BY ALL""")
def discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.discoveries(knn(spark, sf_dir, 10), vector_labels(spark, sf_dir), 10)


@query("unit_pair_scores", f"""WITH {SQL_COS}, p AS (SELECT least(src, tgt) AS a, greatest(src, tgt) AS b, max((11 - rank) / 10) AS weight FROM knn WHERE rank <= 10 GROUP BY ALL), u AS (SELECT x.label AS s, y.label AS t, weight FROM p JOIN v x ON x.id = a JOIN v y ON y.id = b WHERE x.label <> y.label)
SELECT src, tgt, round(sum(weight), 6) AS score FROM (SELECT s AS src, t AS tgt, weight FROM u UNION ALL SELECT t, s, weight FROM u) GROUP BY ALL""")
def unit_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lists.unit_pairs(lists.pair_weights(knn(spark, sf_dir), 10), labels(spark, sf_dir))
    return out.withColumn("score", F.round("score", 6))


@query("mutual_best", f"""WITH {SQL_COS}, p AS (SELECT least(src, tgt) AS a, greatest(src, tgt) AS b, max(score) AS score FROM knn GROUP BY ALL), e AS (SELECT x, max(score) AS best FROM (SELECT a AS x, score FROM p UNION ALL SELECT b, score FROM p) GROUP BY x)
SELECT a, b, score FROM p JOIN e ea ON ea.x = a JOIN e eb ON eb.x = b WHERE score >= ea.best AND score >= eb.best""")
def mutual_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.mutual_best(lists.unordered(knn(spark, sf_dir)).groupBy("a", "b").agg(F.max("score").alias("score")))


@query("symmetric_closure", f"""WITH {SQL_COS}, l AS (SELECT src, tgt, CASE WHEN rank <= 3 THEN 'positional' ELSE 'cartesian' END AS rule FROM knn WHERE rank <= 10)
SELECT src, tgt, max(rule) AS rule FROM (SELECT * FROM l UNION ALL SELECT tgt, src, rule FROM l) GROUP BY ALL""")
def symmetric_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.when(F.col("rank") <= 3, "positional").otherwise("cartesian").alias("rule")
    return lists.symmetric_closure(knn(spark, sf_dir).where("rank <= 10").select("src", "tgt", rule))


@query("overlap_at_k", f"WITH {SQL_COS} SELECT k.src, round(count(c.tgt) / 10, 6) AS overlap FROM knn k LEFT JOIN csls c ON c.src = k.src AND c.tgt = k.tgt AND c.rank <= 10 WHERE k.rank <= 10 GROUP BY k.src")
def overlap_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.overlap_at_k(knn(spark, sf_dir), csls(spark, sf_dir), 10).withColumn("overlap", F.round("overlap", 6))


@query("missed_pairs", f"WITH {SQL_GOLD} SELECT g.src, count(*) AS n_missed FROM gold g WHERE NOT EXISTS (SELECT 1 FROM knn k WHERE k.src = g.src AND k.tgt = g.tgt) GROUP BY g.src")
def missed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold(spark, sf_dir).join(knn(spark, sf_dir), ["src", "tgt"], "left_anti").groupBy("src").agg(F.count("*").alias("n_missed"))


@query("recall_mrr_ndcg", f"""WITH {SQL_GOLD}, n AS (SELECT src, count(*) AS n FROM gold GROUP BY src), h AS (SELECT k.src, count(*) AS hits, min(rank) AS f, sum(1 / log2(rank + 1)) AS dcg FROM knn k JOIN gold g ON g.src = k.src AND g.tgt = k.tgt WHERE rank <= 10 GROUP BY k.src)
SELECT src, round(coalesce(hits, 0) / n, 6) AS recall, round(coalesce(1 / f, 0), 6) AS mrr, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM n LEFT JOIN h USING (src)""")
def recall_mrr_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lists.measures_by_unit(vector_labels(spark, sf_dir), knn(spark, sf_dir, 10), 10)
    return out.select("src", *(F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")))


@query("book_affinity_lift", f"""WITH {SQL_COS}, p AS (SELECT DISTINCT least(src, tgt) AS a, greatest(src, tgt) AS b FROM knn WHERE rank <= 10), o AS (SELECT least(x.label, y.label) AS a, greatest(x.label, y.label) AS b, count(*) AS n FROM p JOIN v x ON x.id = p.a JOIN v y ON y.id = p.b WHERE x.label <> y.label GROUP BY ALL),
s AS (SELECT label, count(*) AS n FROM v GROUP BY label), e AS (SELECT x.label AS a, y.label AS b, x.n * y.n AS w FROM s x JOIN s y ON x.label < y.label)
SELECT e.a AS a, e.b AS b, coalesce(o.n, 0) AS observed, round(coalesce(o.n, 0) / ((SELECT sum(n) FROM o) * w / (SELECT sum(w) FROM e)), 6) AS lift FROM e LEFT JOIN o ON o.a = e.a AND o.b = e.b""")
def book_affinity_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed over expected pairs of every two labels, zeros as well."""
    unit_of = labels(spark, sf_dir)
    pairs = lists.pair_weights(knn(spark, sf_dir), 10).join(unit_of.toDF("a", "x"), "a").join(unit_of.toDF("b", "y"), "b").where("x <> y")
    observed = pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("observed"))
    size = unit_of.groupBy("unit").agg(F.count("*").alias("n"))
    both = size.toDF("a", "na").join(size.toDF("b", "nb"), F.col("a") < F.col("b")).withColumn("w", F.col("na") * F.col("nb"))  # labels, not vectors
    out = both.join(observed, ["a", "b"], "left").withColumn("observed", F.coalesce("observed", F.lit(0)).cast("long"))
    share = lambda c: F.col(c) / F.sum(c).over(Window.partitionBy())
    return out.select("a", "b", "observed", F.round(share("observed") / share("w"), 6).alias("lift"))
