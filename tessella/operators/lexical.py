"""Lexical retrieval: formulas, BM25, TF-IDF, best k lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import words
from tessella.operators import sparse
from tessella.operators.grams import flat, frequent_ngrams, marked  # noqa: F401
from tessella.sources.tables import kept

K1, B = 1.2, 0.75


def ranked(rows: DataFrame, k: int | None, src: str, tgt: str, score: str = "score") -> DataFrame:
    """With rank from 1 within ``src`` by score, ties to the smaller ``tgt``; the best ``k`` if given."""
    order = Window.partitionBy(src).orderBy(F.desc(score), F.asc(tgt))
    rows = rows.withColumn("rank", F.row_number().over(order).cast("long"))
    return rows.where(F.col("rank") <= k) if k else rows


def closed(ngram_rows: DataFrame) -> DataFrame:
    """Without n-grams that begin or end a longer one of equal support."""
    parts = F.split("ngram", " ")
    longer = ngram_rows.select(F.explode(F.array(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " "), F.array_join(F.slice(parts, F.lit(2), F.size(parts) - 1), " "))).alias("ngram"), "n_docs").distinct()
    return ngram_rows.join(longer, ["ngram", "n_docs"], "left_anti")


def formula_weights(docs: DataFrame, formulas: DataFrame, alpha: float) -> DataFrame:
    """Token rows with weight ``alpha`` inside an occurrence of a formula (n, ngram), else 1."""
    rows = marked(docs, formulas).select("doc_id", F.posexplode(F.arrays_zip("ws", "inside")).alias("idx", "x"))
    return rows.select("doc_id", "idx", F.col("x.ws").alias("token"), F.when(F.col("x.inside"), F.lit(alpha)).otherwise(F.lit(1.0)).alias("weight"))


def document_weights(docs: DataFrame, formulas: DataFrame, alpha: float) -> DataFrame:
    """doc_id, weight, n_inside: sums of ``formula_weights``; where rows share a doc_id, what is inside in one is so in all. A document without doc_id has nothing inside."""
    places = F.filter(F.transform("inside", lambda x, i: F.when(x & F.col("doc_id").isNotNull(), i)), lambda i: i.isNotNull())
    rows = marked(docs, formulas).where(F.size("ws") > 0).select("doc_id", F.size("ws").alias("size"), places.alias("at"))
    each = rows.groupBy("doc_id").agg(F.collect_list("size").alias("sizes"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
    inside = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + F.size(F.filter("at", lambda i: i < n)))
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n)
    return each.select("doc_id", size.alias("size"), inside.alias("n_inside")).select("doc_id", (F.col("size") - F.col("n_inside") + alpha * F.col("n_inside")).alias("weight"), "n_inside")


def with_bigrams(rows: DataFrame) -> DataFrame:
    """Token rows (doc_id, idx, token, weight) and their bigrams, whose weight is the lesser of the two."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    pairs = rows.select("doc_id", "idx", F.concat_ws(" ", "token", F.lead("token").over(order)).alias("token"), F.least("weight", F.lead("weight").over(order)).alias("weight"), F.lead("token").over(order).isNotNull().alias("whole"))
    return rows.select("doc_id", "idx", "token", "weight").unionByName(pairs.where("whole").drop("whole"))


def bm25_postings(weighted: DataFrame, all_docs: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """doc_id, token, dw of weighted token rows; N and the average length count documents without tokens as well."""
    tf = weighted.groupBy("doc_id", "token").agg(F.sum("weight").alias("tf"))
    lengths = weighted.groupBy("doc_id").agg(F.sum("weight").alias("dl"))
    totals = all_docs.select("doc_id").join(lengths, "doc_id", "left").agg(F.count("*").alias("n"), F.avg(F.coalesce("dl", F.lit(0.0))).alias("avgdl"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    rows = tf.join(lengths, "doc_id").join(df, "token").crossJoin(F.broadcast(totals))  # totals are one row
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return rows.select("doc_id", "token", (idf * part).alias("dw"))


def bm25_of_tokens(docs: DataFrame, wanted: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """``bm25_postings`` of unit weights for the tokens in ``wanted`` alone: others leave before anything moves, lengths come from the words' arrays."""
    sized = docs.select("doc_id", words(F.col("text")).alias("ws")).withColumn("dl", F.size("ws").cast("double"))
    totals = sized.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    rows = sized.select("doc_id", "dl", F.explode("ws").alias("token")).join(wanted.select("token").distinct(), "token", "left_semi")
    tf = rows.groupBy("token", "doc_id", "dl").agg(F.count("*").cast("double").alias("tf"))
    df = F.count("*").over(Window.partitionBy("token"))
    rows = tf.withColumn("df", df).crossJoin(F.broadcast(totals))  # totals are one row
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return rows.select("doc_id", "token", (idf * part).alias("dw"))


def bm25_of_marked(docs: DataFrame, formulas: DataFrame, alpha: float, wanted: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """``bm25_postings`` of ``with_bigrams`` of ``formula_weights`` for the terms in ``wanted`` alone, which are broadcast: other terms never move, lengths come from the words' arrays."""
    w = F.transform("inside", lambda x: F.when(x, F.lit(alpha)).otherwise(F.lit(1.0)))
    later = lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
    rows = marked(docs, formulas).select("doc_id", "ws", w.alias("w"))
    one = F.zip_with("ws", "w", lambda t, x: F.struct(t.alias("token"), x.alias("weight")))
    rows = rows.select("doc_id", one.alias("one"))
    first = F.slice("one", F.lit(1), F.greatest(F.size("one") - 1, F.lit(0)))
    two = F.zip_with(first, later("one"), lambda p, q: F.struct(F.concat_ws(" ", p["token"], q["token"]).alias("token"), F.least(p["weight"], q["weight"]).alias("weight")))
    rows = rows.select("doc_id", F.concat("one", two).alias("terms"))
    rows = rows.withColumn("dl", F.aggregate("terms", F.lit(0.0), lambda a, x: a + x["weight"]))
    totals = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    found = rows.select("doc_id", "dl", F.explode("terms").alias("x")).select("doc_id", "dl", "x.token", "x.weight").join(F.broadcast(wanted.select("token").distinct()), "token", "left_semi")
    tf = found.groupBy("token", "doc_id", "dl").agg(F.sum("weight").alias("tf"))
    rows = tf.withColumn("df", F.count("*").over(Window.partitionBy("token"))).crossJoin(F.broadcast(totals))  # totals are one row
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return rows.select("doc_id", "token", (idf * part).alias("dw"))


def lexical_topk(queries: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """Queries (query_id, token, qw) against postings: query_id, doc_id, score, rank."""
    scores = queries.join(postings, "token").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qw") * F.col("dw")), 6).alias("score"))
    return ranked(scores.where("score > 0"), k, "query_id", "doc_id")


def _weighed(told):
    def weigh(batch):
        allowed, idf, avgdl, k1, b = told.value
        ids = batch.column("doc_id").to_numpy()
        batch = batch.filter(pa.array(np.searchsorted(allowed, ids, "right") > np.searchsorted(allowed, ids)))
        terms, starts = flat(batch.column("terms"))
        tf = flat(batch.column("counts"))[0].to_numpy().astype("f8")
        dl = np.repeat(batch.column("size").to_numpy().astype("f8"), np.diff(starts))
        dw = idf[terms.to_numpy()] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
        offsets = pa.array(starts.astype("i4"))
        listed = [pa.ListArray.from_arrays(offsets, x) for x in (terms, pa.array(dw))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *listed], names=["id", "terms", "weights"])

    return weigh


def _whole(rows: DataFrame) -> DataFrame:
    """Coded rows (doc_id, size, terms, counts) with those of a doc_id as one, and ``n``, how many these were."""
    one = F.lit(1).cast("long").alias("n")
    ids = rows.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("c")).where("c > 1").select("id")
    if not ids.limit(1).count():
        return rows.select("*", one)
    same = rows["doc_id"].eqNullSafe(ids["id"])
    alone, shared = rows.join(ids, same, "left_anti").select("*", one), kept(rows.join(ids, same, "left_semi"), "shared")
    sizes = shared.groupBy("doc_id").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    each = shared.select("doc_id", F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("doc_id", "x.terms").agg(F.sum("x.counts").cast("int").alias("counts"))
    packed = each.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("terms", "counts")).alias("x"))
    merged = sizes.join(packed, sizes["doc_id"].eqNullSafe(packed["id"]), "left").withColumn("x", F.coalesce("x", F.array().cast(packed.schema["x"].dataType)))
    return kept(alone.unionByName(merged.select("doc_id", "size", F.col("x.terms").alias("terms"), F.col("x.counts").alias("counts"), "n")), "whole")


def bm25_topk(docs: DataFrame, queries: DataFrame, allowed: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """Free-text queries (query_id, text) against ``allowed`` documents (doc_id), statistics of all: query_id, doc_id, score, rank.

    Asked tokens and allowed doc_ids are broadcast, and a document's tokens are put aside as numbers in one row; pairs are scored by blocks, so neither tokens
    nor pairs are shuffled.
    """
    spark = docs.sparkSession
    asked = queries.where("query_id is not null").select(F.col("query_id").alias("id"), F.array_distinct(words(F.col("text"))).alias("ws"))
    tokens = sparse.column(asked.select(F.explode("ws").alias("token")).distinct().toArrow(), "token", pa.string())
    sources = sparse.coded(asked, tokens).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    rows = _whole(kept(sparse.coded(docs.select("doc_id", words(F.col("text")).alias("ws")), tokens), "coded"))
    # a document without doc_id counts as one, has no length and is never found, as in joins
    n, total = rows.agg(F.sum("n"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("size") * F.col("n")))).first()
    dfs = rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()
    df = np.zeros(len(tokens))
    df[dfs.column("t").to_numpy()] = dfs.column("df").to_numpy()  # a number for each asked token
    idf = np.log1p(((n or 0) - df + 0.5) / (df + 0.5))
    ids = np.unique(sparse.column(allowed.where("doc_id is not null").select("doc_id").toArrow(), "doc_id", pa.int64()).to_numpy())
    told = spark.sparkContext.broadcast((ids, idf, (total or 0) / max(n or 0, 1) or 1.0, k1, b))
    targets = rows.where("doc_id is not null").select("doc_id", "size", "terms", "counts")
    best = sparse.best_k(sources, targets, k, weigh=_weighed(told))
    return best.select(F.col("src").alias("query_id"), F.col("tgt").alias("doc_id"), "score", "rank")


def unit_tfidf(rows: DataFrame, unit: list[str]) -> DataFrame:
    """Normalised weights of each unit's tokens: (1 + ln count), smooth idf over units, length 1."""
    tf = rows.groupBy(*unit, "token").agg(F.count("*").alias("c"))
    n = tf.select(*unit).distinct().agg(F.count("*").alias("n"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    raw = tf.join(df, "token").crossJoin(F.broadcast(n)).withColumn("x", (1 + F.log("c")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))  # n is one row
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(*unit)))
    return raw.select(*unit, "token", (F.col("x") / norm).alias("x"))


def rare_keys(rows: DataFrame, least: int, most: int) -> DataFrame:
    """token, df of tokens in ``least`` to ``most`` documents."""
    return rows.select("doc_id", "token").distinct().groupBy("token").agg(F.count("*").alias("df")).where(F.col("df").between(least, most))


