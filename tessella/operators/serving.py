"""Reads of results: pages, examples, comparisons of builds, splits without leakage, expansion of ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(rows: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """One page in a total order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def examples(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col("nth") <= n)


def compare_builds(old: DataFrame, new: DataFrame, key: list[str], values: list[str], tolerance: float) -> DataFrame:
    """key, change: added, removed, or the names of the columns that differ (numbers by more than ``tolerance``)."""
    a = old.select(*key, F.struct(*values).alias("o"))
    b = new.select(*key, F.struct(*values).alias("n"))
    for i, k in enumerate(key):
        a, b = a.withColumnRenamed(k, f"ok{i}"), b.withColumnRenamed(k, f"nk{i}")
    same_key = None
    for i in range(len(key)):
        part = F.col(f"ok{i}").eqNullSafe(F.col(f"nk{i}"))
        same_key = part if same_key is None else same_key & part
    both = a.join(b, same_key, "full")
    numeric = {f.name for f in old.schema if f.dataType.typeName() in ("double", "float", "decimal")}
    differ = lambda v: F.coalesce(F.abs(F.col(f"o.{v}") - F.col(f"n.{v}")) > tolerance, ~F.col(f"o.{v}").eqNullSafe(F.col(f"n.{v}"))) if v in numeric else ~F.col(f"o.{v}").eqNullSafe(F.col(f"n.{v}"))
    changed = F.array_join(F.array_compact(F.array(*(F.when(differ(v), F.lit(v)) for v in values))), ",")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise(changed)
    return both.select(*(F.coalesce(f"ok{i}", f"nk{i}").alias(k) for i, k in enumerate(key)), change.alias("change")).where("change <> ''")


def multiset_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows with how many more (or, below zero, fewer) of them ``new`` has."""
    signed = old.withColumn("sign", F.lit(-1)).unionByName(new.withColumn("sign", F.lit(1)))
    return signed.groupBy(*old.columns).agg(F.sum("sign").alias("more")).where("more <> 0")


def expand_ranges(links: DataFrame, most: int = 3) -> DataFrame:
    """Links of ranges (a, a_end, b, b_end) as links of places: side by side where ranges are as long, all with all where both have at most ``most`` places; both ways, without a place and itself, side by side before all with all."""
    na, nb = F.col("a_end") - F.col("a") + 1, F.col("b_end") - F.col("b") + 1
    side = links.where(na == nb).select(F.explode(F.sequence(F.lit(0).cast("long"), (na - 1).cast("long"))).alias("i"), "a", "b").select((F.col("a") + F.col("i")).alias("src"), (F.col("b") + F.col("i")).alias("tgt"), F.lit("positional").alias("rule"))
    every = links.where((na != nb) & (na <= most) & (nb <= most)).select(F.explode(F.sequence("a", "a_end")).alias("src"), "b", "b_end").select("src", F.explode(F.sequence("b", "b_end")).alias("tgt"), F.lit("cartesian").alias("rule"))
    one = side.unionByName(every).where("src <> tgt")
    both = one.unionByName(one.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), "rule"))
    return both.groupBy("src", "tgt").agg(F.max("rule").alias("rule"))


#: Of two splits the later one here wins.
PRECEDENCE = ("train", "dev", "test")


def pair_split(a: Column, b: Column) -> Column:
    code = lambda c: F.array_position(F.array(*map(F.lit, PRECEDENCE)), c)
    return F.element_at(F.array(*map(F.lit, PRECEDENCE)), F.greatest(code(a), code(b)).cast("int"))


def kilometres(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6,371 km."""
    a, b = F.radians(lat), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
