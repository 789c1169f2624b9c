"""Ordered rows: islands, exchanges, moving contrasts, percentiles, splits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.tables import kept


def islands(rows: DataFrame, by: list[str], position: str, max_gap: int) -> DataFrame:
    """Rows with ``run``: a new one begins where the gap to the row before is over ``max_gap``."""
    order = Window.partitionBy(*by).orderBy(position)
    new = (F.col(position) - F.lag(position).over(order)) > max_gap
    return rows.withColumn("run", F.sum(F.coalesce(new.cast("long"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def value_runs(rows: DataFrame, by: list[str], position: str, value: str) -> DataFrame:
    """Maximal runs of one value: by, run, value, first, last, n."""
    order = Window.partitionBy(*by).orderBy(position)
    new = ~F.col(value).eqNullSafe(F.lag(value).over(order)) | F.row_number().over(order).eqNullSafe(1)
    marked = rows.withColumn("run", F.sum(new.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*by, "run", value).agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n"))


def block_contrast(rows: DataFrame, by: list[str], position: str, value: str, width: int) -> DataFrame:
    """The mean of ``width`` rows after a row less that of as many up to it; null at the edges."""
    order = Window.partitionBy(*by).orderBy(position)
    before, after = order.rowsBetween(1 - width, 0), order.rowsBetween(1, width)
    full = (F.count("*").over(before) == width) & (F.count("*").over(after) == width)
    return rows.withColumn("shift", F.when(full, F.avg(value).over(after) - F.avg(value).over(before)))


def percentile(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """The mean rank of a value less a half, over the number of rows."""
    keys = by or []
    at_most = Window.partitionBy(*keys).orderBy(value)
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    mean_rank = F.count("*").over(at_most) - (ties - 1) / 2
    return rows.withColumn("percentile", (mean_rank - 0.5) / F.count("*").over(Window.partitionBy(*keys)))


def exchanges(turns: DataFrame, conversation: str, turn: str, speaker: str) -> DataFrame:
    """Stretches of a conversation in which exactly two parties speak in turn, with their numbers of turns."""
    order = Window.partitionBy(conversation).orderBy(turn)
    alternates = (F.lag(speaker, 2).over(order) == F.col(speaker)) & (F.lag(speaker).over(order) != F.col(speaker))
    second = F.lag(speaker).over(order).isNotNull() & (F.lag(speaker).over(order) != F.col(speaker))
    marked = turns.withColumn("joins", alternates).withColumn("opens", second & ~F.coalesce(alternates, F.lit(False)))
    run = F.sum((~F.coalesce("joins", F.lit(False))).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = marked.withColumn("run", run).withColumn("partner", F.lag(speaker).over(order))
    out = marked.groupBy(conversation, "run").agg(F.min(turn).alias("first"), F.max(turn).alias("last"), F.count("*").alias("n"), F.min_by(speaker, turn).alias("b"), F.min_by("partner", turn).alias("a"))
    return out.where(F.col("a").isNotNull() & (F.col("a") != F.col("b"))).select(conversation, (F.col("first") - 1).alias("first"), "last", (F.col("n") + 1).alias("turns"), "a", "b")


def _three_parts(least: int):
    """Each first cut, in a task's rows, against all second ones: the best of them by gain to six digits, ties to the smaller cuts."""

    def ll(k, n):
        with np.errstate(all="ignore"):
            return np.where((k > 0) & (k < n), k * np.log(k / n) + (n - k) * np.log(1 - k / n), 0.0)

    def run(batches):
        for batch in batches:
            best = None
            for at in range(batch.num_rows):
                h, s = (np.frombuffer(batch.column(c)[at].as_py(), "f8") for c in ("h", "s"))
                n, flat = len(h), ll(h[-1], s[-1])
                second = ll(h[-1] - h, s[-1] - s)  # what the third part adds, by the second cut
                for i in range(max(batch.column("first")[at].as_py(), least), min(batch.column("last")[at].as_py(), n - 2 * least) + 1):
                    j = slice(i + least - 1, n - least)
                    gain = np.round(np.maximum(ll(h[i - 1], s[i - 1]) + ll(h[j] - h[i - 1], s[j] - s[i - 1]) + second[j] - flat, 0.0), 6)
                    to = int(gain.argmax())
                    if best is None or gain[to] > best[2]:
                        best = (i, i + least + to, float(gain[to]))
            if best:
                yield pa.RecordBatch.from_pydict({"i": [best[0]], "j": [best[1]], "gain": [best[2]]}, schema=pa.schema([("i", pa.int32()), ("j", pa.int32()), ("gain", pa.float64())]))

    return run


#: First cuts that a task tries.
CUTS = 256


def best_three_parts(counts: DataFrame, position: str, hits: str, size: str, least: int) -> DataFrame:
    """The two cuts of a sequence that raise the binomial likelihood most over one rate: all pairs of cuts, in arrays of prefix sums.

    The counts of the sequence are one row of 16 bytes a position; its first cuts are dealt to tasks.
    """
    schema = pa.schema([("n", pa.int64()), ("h", pa.binary()), ("s", pa.binary())])

    def sums(batches):
        table = pa.Table.from_batches(list(batches))
        if table.num_rows:
            table = table.sort_by("position")
            h, s = (np.cumsum(table.column(c).to_numpy().astype("f8")) for c in ("hits", "size"))
            yield pa.RecordBatch.from_pydict({"n": [table.num_rows], "h": [h.tobytes()], "s": [s.tobytes()]}, schema=schema)

    spark = counts.sparkSession
    rows = counts.select(F.col(position).alias("position"), F.col(hits).cast("long").alias("hits"), F.col(size).cast("long").alias("size"))
    whole = kept(rows.where("position is not null").coalesce(1).mapInArrow(sums, "n long, h binary, s binary"), "sums")
    n = (whole.agg(F.max("n")).first()[0] or 0)
    tasks = max(1, -(-n // CUTS))
    firsts = spark.range(0, tasks, 1, min(tasks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 24))).select((F.col("id") * CUTS + 1).alias("first"), ((F.col("id") + 1) * CUTS).alias("last"))
    found = firsts.crossJoin(whole.select("h", "s").hint("shuffle_replicate_nl")).mapInArrow(_three_parts(least), "i int, j int, gain double")
    return found.orderBy(F.desc("gain"), "i", "j").limit(1)
