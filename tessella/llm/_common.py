"""What the operators of this subpackage share: table reading, the shared work folder, row kernels."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows handed to a Python worker at once. Texts may be very long, so the default of 10,000 is too many.
ROWS_PER_BATCH = 512


#: Bytes of a batch on its way to a Python worker, beside the number of rows.
BYTES_PER_BATCH = 32 << 20


def short_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, where they are larger. A plan reads these settings when it runs, so they stay."""
    for name, most in (("maxRecordsPerBatch", ROWS_PER_BATCH), ("maxBytesPerBatch", BYTES_PER_BATCH)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a folder of our own is used if all executors are threads of this machine; else it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found or "/tmp/tessella-checkpoint"


class Scope:
    """What operators that are called within it put aside; ``release`` deletes that, and nothing else.

    Results are lazy, so a scope is released by its owner when those have been stored elsewhere. What is put aside outside
    of any scope is never deleted here.
    """

    current: list[Scope] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables = spark, [], []

    def __enter__(self) -> Scope:
        Scope.current.append(self)
        return self

    def __exit__(self, *_) -> None:
        Scope.current.remove(self)

    def release(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.paths, self.tables = [], []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if Scope.current:
        Scope.current[-1].paths.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` cut from its lineage: written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``written``, bucketed by ``key`` so that joins by it don't move the rows."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    path = fresh_path(spark, name)
    if Scope.current:
        Scope.current[-1].tables.append(name)
    df.write.bucketBy(shuffle_partitions(spark), key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def per_batch(schema: pa.Schema, kernel: Callable[[pa.RecordBatch], dict]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from one that turns a batch into columns by name."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield to_batch(kernel(batch), schema)

    return run


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)


def texts_of(column: pa.Array) -> list[str]:
    """Whole texts; null is the empty text."""
    return [t or "" for t in column.to_pylist()]
