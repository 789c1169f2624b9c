"""Statistics as column expressions and small plans: G2, tails, false-discovery control, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cell(observed: Column, expected: Column) -> Column:
    return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)


def g2_two_by_two(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Log-likelihood of a table (a b; c d) against independence; empty cells add nothing."""
    n = a + b + c + d
    total = _cell(a, (a + b) * (a + c) / n) + _cell(b, (a + b) * (b + d) / n) + _cell(c, (c + d) * (a + c) / n) + _cell(d, (c + d) * (b + d) / n)
    return F.greatest(2 * total, F.lit(0.0))


def g2_two_cells(a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """Log-likelihood of a key's counts in two corpora, from those two cells only."""
    share = (a + b) / (size_a + size_b)
    return 2 * (_cell(a, size_a * share) + _cell(b, size_b * share))


def erfc(x: Column) -> Column:
    """The complementary error function for x >= 0, to about 1e-7 of its value: a fixed rational-exponential form."""
    #: Coefficients of the Chebyshev fit, lowest order first.
    coefficients = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)


def chi2_tail(x: Column) -> Column:
    """P(chi-squared with one degree of freedom >= x)."""
    return erfc(F.sqrt(F.greatest(x, F.lit(0.0)) / 2))


def empirical_p(observed: Column, null: Column, less: bool = False) -> Column:
    """(1 + how many of the null values are as extreme) / (1 + how many there are); ``null`` is an array."""
    hits = F.size(F.filter(null, lambda v: (v <= observed) if less else (v >= observed)))
    return (1 + hits) / (1 + F.size(null))


#: Stretches of p values that are ordered on their own where there is one family.
STRETCHES = 256


def with_bh_q(rows: DataFrame, p: str, q: str = "q", by: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg q values: p * m / rank, from the largest p down never rising, at most 1. Null and NaN stay null.

    Equal p values are one row with their number. Without ``by`` they are dealt to stretches between quantiles, which only their
    totals and least values join; with ``by`` each family is ordered by itself. Both orders are run through once.
    """
    keys = list(by or [])
    each = rows.where(F.col(p).isNotNull() & ~F.isnan(p)).select(*keys, (F.col(p) + F.lit(0.0)).alias("_p")).groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
    if by:
        up, whole = Window.partitionBy(*keys).orderBy("_p"), Window.partitionBy(*keys)
        each = each.withColumn("_raw", F.col("_p") * F.sum("_n").over(whole) / F.sum("_n").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        least = F.min("_raw").over(whole.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    else:
        bounds = each.agg(F.percentile_approx("_p", [i / STRETCHES for i in range(1, STRETCHES)], 10_000).alias("_bounds"))  # one row
        each = each.crossJoin(F.broadcast(bounds)).withColumn("_at", F.size(F.filter("_bounds", lambda x: x < F.col("_p")))).drop("_bounds")
        within = lambda *order: Window.partitionBy("_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        stretch = Window.orderBy("_at")  # a row a stretch
        totals = each.groupBy("_at").agg(F.sum("_n").alias("_c")).withColumn("_before", F.sum("_c").over(stretch) - F.col("_c")).withColumn("_m", F.sum("_c").over(Window.partitionBy()))
        each = each.join(F.broadcast(totals.select("_at", "_before", "_m")), "_at")
        each = each.withColumn("_raw", F.col("_p") * F.col("_m") / (F.col("_before") + F.sum("_n").over(within("_p"))))
        lows = each.groupBy("_at").agg(F.min("_raw").alias("_low")).withColumn("_later", F.min("_low").over(Window.orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1)))
        each = each.join(F.broadcast(lows.select("_at", "_later")), "_at")
        least = F.least(F.min("_raw").over(within(F.desc("_p"))), F.coalesce("_later", F.lit(float("inf"))))
    found = each.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "_p", F.least(least, F.lit(1.0)).alias(q))
    same = F.when(~F.isnan(p), F.col(p) + F.lit(0.0)) == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.drop(q).join(found, same, "left").drop("_p", *(f"_k_{k}" for k in keys))


def pooled_q(observed: DataFrame, null: DataFrame, reps: int) -> DataFrame:
    """q of each observed score: (null scores as high / reps) / observed ones as high, the least of these over all scores no higher, at most 1."""
    both = observed.select("score", F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(null.select("score", F.lit(0).alias("o"), F.lit(1).alias("n")))
    per = both.groupBy("score").agg(F.sum("o").alias("o"), F.sum("n").alias("n"))
    down = Window.orderBy(F.desc("score"))
    per = per.withColumn("ratio", (F.sum("n").over(down) / reps) / F.sum("o").over(down)).where("o > 0")
    low = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.withColumn("q", F.least(F.min("ratio").over(low), F.lit(1.0))).select("score", "q")
    return observed.join(per, "score")


def mutual_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information of two columns in bits, from their table of counts."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    cells = cells.crossJoin(F.broadcast(cells.agg(F.sum("n").alias("t"))))  # one row
    cells = cells.select("n", "t", F.sum("n").over(Window.partitionBy(a)).alias("na"), F.sum("n").over(Window.partitionBy(b)).alias("nb"))
    return cells.agg(F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi_bits"))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two labellings."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    n = cells.groupBy("a", "b").agg(F.count("*").alias("n"))
    sides = n.select("a", F.lit(0).alias("side"), "n").unionByName(n.select(F.col("b").alias("a"), F.lit(1).alias("side"), "n"))
    margins = sides.groupBy("a").agg(F.sum(F.when(F.col("side") == 0, F.col("n"))).alias("x"), F.sum(F.when(F.col("side") == 1, F.col("n"))).alias("y"))
    chance = margins.agg(F.sum(F.coalesce("x", F.lit(0)) * F.coalesce("y", F.lit(0))).alias("xy"))
    agree = n.agg(F.sum("n").alias("t"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    both = agree.crossJoin(chance)  # one row each
    po, pe = F.col("same") / F.col("t"), F.col("xy") / (F.col("t") * F.col("t"))
    return both.select(po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))
