"""Tables of a folder, top-k lists and the usual text formats."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TOPK = "unit_type string, src_id string, rank int, tgt_id string, score float"


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def kept(rows: DataFrame, name: str) -> DataFrame:
    """Rows cut from their lineage: written to the folder that driver and executors share, ``spark.checkpoint.dir``.

    Where that is unset, a folder of our own is used if all executors are threads of this machine; else it is an error.
    """
    spark = rows.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{(folder or '/tmp/tessella-checkpoint').rstrip('/')}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def read_topk(spark: SparkSession, path: str) -> DataFrame:
    """A stored top-k list with the number in each id (``v:17`` is 17) as src and tgt."""
    rows = spark.read.schema(TOPK).parquet(path)
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("long")
    return rows.withColumn("src", number("src_id")).withColumn("tgt", number("tgt_id"))


def write_topk(rows: DataFrame, path: str, meta: dict[str, str]) -> None:
    """Rows of ``TOPK`` as Parquet beside a one-row table of metadata."""
    rows.write.parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame([tuple(meta.values())], list(meta)).coalesce(1).write.json(f"{path}/meta")


def read_separated(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",", header: bool = True) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep, header=header)


def read_link_files(spark: SparkSession, paths: list[str], schema: StructType | str, known: DataFrame, sides: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Link files one after the other; rows stay whose both sides are among ``known`` (one column, ``book``)."""
    rows = spark.read.csv(paths, schema=schema, header=True)
    for side in sides:
        rows = rows.join(known.select(F.col("book").alias(side)).distinct(), side, "left_semi")
    return rows


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def read_nested_verses(spark: SparkSession, path: str) -> DataFrame:
    """JSON files with text[chapter][verse]: chapter, verse (from 1), text."""
    books = spark.read.schema("title string, text array<array<string>>").json(path, multiLine=True)
    chapters = books.select("title", F.posexplode("text").alias("chapter", "verses"))
    return chapters.select("title", (F.col("chapter") + 1).alias("chapter"), F.posexplode("verses").alias("verse", "text")).withColumn("verse", F.col("verse") + 1)


def read_xml_rows(spark: SparkSession, path: str, row_tag: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True)


def write_partitioned(rows: DataFrame, path: str, by: list[str]) -> None:
    """Parquet in a folder for each value, each value's rows together so that there are few files."""
    rows.repartition(*by).write.partitionBy(*by).parquet(path)
