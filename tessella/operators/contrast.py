"""Contrast of parts of a corpus: keyness, sets against each other, co-occurrence, ordered pairs, style."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.stats import chi2_tail, g2_two_by_two, g2_two_cells, with_bh_q


def keyness(rows: DataFrame, unit: str, key: str, min_count: int) -> DataFrame:
    """Over-represented keys of each unit against the rest: unit, key, a, expected, g2; only a above its expectation."""
    counts = rows.groupBy(unit, key).agg(F.count("*").alias("a"))
    sizes = counts.groupBy(unit).agg(F.sum("a").alias("size_a"))
    whole = sizes.agg(F.sum("size_a").alias("n"))
    sized = counts.withColumn("all_key", F.sum("a").over(Window.partitionBy(key))).join(sizes, unit).crossJoin(F.broadcast(whole))  # one row
    expected = F.col("size_a") * F.col("all_key") / F.col("n")
    g2 = g2_two_cells(F.col("a"), F.col("all_key") - F.col("a"), F.col("size_a"), F.col("n") - F.col("size_a"))
    return sized.where((F.col("a") >= min_count) & (F.col("a") > expected)).select(unit, key, "a", expected.alias("expected"), g2.alias("g2"))


def set_contrast(rows: DataFrame, in_a, in_b, key: str, min_count: int) -> DataFrame:
    """Keys of set A against those of set B (rows in both count for A): counts, G2, p, q, log2 ratio with a half added, side."""
    side = F.when(in_a, "a").when(in_b, "b")
    counts = rows.withColumn("side", side).where("side is not null").groupBy(key).agg(F.count(F.when(F.col("side") == "a", 1)).alias("a"), F.count(F.when(F.col("side") == "b", 1)).alias("b"))
    totals = counts.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    counts = counts.crossJoin(F.broadcast(totals)).where(F.col("a") + F.col("b") >= min_count)  # totals are one row
    g2 = g2_two_by_two(F.col("a"), F.col("b"), F.col("ta") - F.col("a"), F.col("tb") - F.col("b"))
    ratio = F.log2(((F.col("a") + 0.5) / (F.col("ta") + 0.5)) / ((F.col("b") + 0.5) / (F.col("tb") + 0.5)))
    out = counts.withColumn("g2", g2).withColumn("p", chi2_tail(F.col("g2"))).withColumn("log2_ratio", ratio).withColumn("side", F.when(F.col("a") * F.col("tb") >= F.col("b") * F.col("ta"), "a").otherwise("b"))
    return with_bh_q(out, "p").drop("ta", "tb")


def cooccurrence(rows: DataFrame, group: str, name: str, min_together: int) -> DataFrame:
    """Pairs of names that share more groups than their numbers let expect: a, b, n, expected, g2."""
    once = rows.where(F.col(name).isNotNull() & F.col(group).isNotNull()).select(group, name).distinct()
    n = once.select(group).distinct().agg(F.count("*").alias("groups"))
    of = once.groupBy(name).agg(F.count("*").alias("n_of"))
    names = once.groupBy(group).agg(F.sort_array(F.collect_list(name)).alias("names"))  # a group's distinct names
    pairs = names.select(F.explode("names").alias("a"), "names").select("a", F.explode("names").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    out = pairs.join(of.toDF("a", "na"), "a").join(of.toDF("b", "nb"), "b").crossJoin(F.broadcast(n))  # n is one row
    expected = F.col("na") * F.col("nb") / F.col("groups")
    g2 = g2_two_by_two(F.col("n"), F.col("na") - F.col("n"), F.col("nb") - F.col("n"), F.col("groups") - F.col("na") - F.col("nb") + F.col("n"))
    return out.where((F.col("n") >= min_together) & (F.col("n") > expected)).select("a", "b", "n", expected.alias("expected"), g2.alias("g2"))


def feature_rates(rows: DataFrame, unit: str, key: str, features: DataFrame) -> DataFrame:
    """unit, key, rate per 1,000 of the given features (zeros as well)."""
    sizes = rows.groupBy(unit).agg(F.count("*").alias("size"))
    counts = rows.join(features, key, "left_semi").groupBy(unit, key).agg(F.count("*").alias("n"))
    return sizes.crossJoin(features).join(counts, [unit, key], "left").select(unit, key, (1000 * F.coalesce("n", F.lit(0)) / F.col("size")).alias("rate"))  # units and features are few


def burrows_delta(rates: DataFrame, unit: str, key: str) -> DataFrame:
    """a, b, delta: the mean absolute difference of z-scores (population deviation, 0 where there is none)."""
    over = Window.partitionBy(key)
    sd = F.stddev_pop("rate").over(over)
    z = rates.select(F.col(unit).alias("a"), key, F.when(sd > 0, (F.col("rate") - F.avg("rate").over(over)) / sd).otherwise(0.0).alias("z"))
    other = z.toDF("b", key, "y")
    return z.join(other, key).where("a < b").groupBy("a", "b").agg(F.avg(F.abs(F.col("z") - F.col("y"))).alias("delta"))
