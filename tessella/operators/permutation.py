"""Resampling: labels permuted within strata, sets redrawn within their groups, p values and intervals of the draws.

Draws follow from a linear congruence of a row's number and the draw's, so that they are the same everywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.tables import kept

#: Fixed values of the congruence.
BY_ROW, BY_DRAW, MODULUS = 7919, 104_729, 1_000_003


def draw_order(number: Column, draw: Column) -> Column:
    return (number * BY_ROW + draw * BY_DRAW + number * draw) % MODULUS


def permuted(rows: DataFrame, number: str, strata: list[str], label: str, draws: int) -> DataFrame:
    """Rows once a draw (``draw``, from 0, which is as observed), with ``label`` permuted within each stratum.

    A stratum's labels are put in order of its rows' numbers, and its rows in the order of the draw. Each stratum and draw is a window of its own.
    """
    every = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    keys = [*strata, "draw"]
    place = F.when(F.col("draw") == 0, F.col(number).cast("long")).otherwise(draw_order(F.col(number).cast("long"), F.col("draw").cast("long")))
    nth = every.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(number))).withColumn("_j", F.row_number().over(Window.partitionBy(*keys).orderBy(place, number)))
    labels = nth.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_i").alias("_at"), F.col(label).alias("_label"))
    same = F.col("_j") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return nth.join(labels, same).withColumn(label, F.col("_label")).drop("_i", "_j", "_at", "_label", *(f"_{k}" for k in keys))


#: Draws that a task makes of a stratum at once.
DRAWS = 10
STRATUM = pa.schema([("stratum", pa.int64()), ("n", pa.binary()), ("inside", pa.binary()), ("value", pa.binary())])
MEANS = pa.schema([("stratum", pa.int64()), ("draw", pa.int32()), ("diff", pa.float64())])


def _gather(batches):
    """Rows that are sorted by stratum and number: a row of arrays a stratum."""
    held, parts = None, []
    for batch in batches:
        strata = batch.column("stratum").to_numpy()
        cuts = [0, *(np.nonzero(np.diff(strata))[0] + 1), len(strata)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held is not None and strata[a] != held:
                yield _stratum(held, parts)
                parts = []
            held = strata[a]
            parts.append([batch.column(c).slice(a, b - a).to_numpy(zero_copy_only=False) for c in ("n", "inside", "value")])
    if parts:
        yield _stratum(held, parts)


def _stratum(stratum, parts):
    n, inside, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.RecordBatch.from_pydict({"stratum": [int(stratum)], "n": [n.astype("i8").tobytes()], "inside": [inside.astype("i1").tobytes()], "value": [value.astype("f8").tobytes()]}, schema=STRATUM)


def _differences(batches):
    for batch in batches:
        for at in range(batch.num_rows):
            n, inside, value = (np.frombuffer(batch.column(c)[at].as_py(), k) for c, k in (("n", "i8"), ("inside", "i1"), ("value", "f8")))
            labels = inside.astype(bool)  # in order of the rows' numbers
            total, m = value.sum(), int(labels.sum())
            for draw in batch.column("draws")[at].as_py():
                drawn = value if draw == 0 else value[np.argsort(np.fmod(n * BY_ROW + draw * BY_DRAW + n * draw, MODULUS), kind="stable")]
                one = drawn[labels].sum()
                diff = one / m - (total - one) / (len(n) - m) if 0 < m < len(n) else None
                yield pa.RecordBatch.from_pydict({"stratum": [batch.column("stratum")[at].as_py()], "draw": [draw], "diff": [diff]}, schema=MEANS)


def permuted_differences(rows: DataFrame, draws: int) -> DataFrame:
    """stratum, draw, diff: the mean ``value`` inside less that outside, as observed (draw 0) and with labels ``permuted`` within strata.

    From n, stratum (long), inside, value. A stratum's rows are packed once, by 17 bytes, and read again by the tasks that draw.
    """
    spark = rows.sparkSession
    there = rows.select(F.col("stratum").cast("long").alias("stratum"), F.col("n").cast("long").alias("n"), F.col("inside").cast("int").alias("inside"), F.col("value").cast("double").alias("value"))
    strata = kept(there.repartition("stratum").sortWithinPartitions("stratum", "n").mapInArrow(_gather, "stratum long, n binary, inside binary, value binary"), "strata")
    of = -(-(draws + 1) // DRAWS)
    numbers = spark.range(0, of, 1, of).select(F.sequence((F.col("id") * DRAWS).cast("int"), F.least((F.col("id") + 1) * DRAWS - 1, F.lit(draws)).cast("int")).alias("draws"))
    return numbers.crossJoin(strata.hint("shuffle_replicate_nl")).mapInArrow(_differences, "stratum long, draw int, diff double")


def p_values(draws: DataFrame, by: list[str], statistic: str) -> DataFrame:
    """by, observed, p_more, p_less, low, high: (1 + draws as extreme) / (1 + draws), and the 2.5 and 97.5 percentiles of the draws."""
    observed = draws.where("draw = 0").select(*by, F.col(statistic).alias("observed"))
    null = draws.where("draw > 0").join(observed, by) if by else draws.where("draw > 0").crossJoin(F.broadcast(observed))  # one row
    of = lambda hit: (1 + F.count_if(hit)) / (1 + F.count("*"))
    return null.groupBy(*by, "observed").agg(of(F.col(statistic) >= F.col("observed") - 1e-12).alias("p_more"), of(F.col(statistic) <= F.col("observed") + 1e-12).alias("p_less"), F.percentile(statistic, F.lit(0.025)).alias("low"), F.percentile(statistic, F.lit(0.975)).alias("high"))
