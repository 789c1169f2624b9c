"""Token-id files: ORC stripes with run-length encoded integers, row indexes and Bloom filters on document ids.

``write_tokens`` puts documents in ascending ``doc_id`` order, encodes them where they lie after that
one shuffle and writes ORC, one file a shard. ``read_tokens`` reads the files back: Spark reads the
stripes of a file side by side, and a filter on ``doc_id`` skips files, stripes and row groups by
their statistics and Bloom filters.

Defined cases: null text is the empty text (its only id is the end id); null ids come first;
repeated rows stay, in order of their texts; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm._common import fresh_path, per_batch, short_batches, shuffle_partitions, table, texts_of, to_batch
from tessella.llm.pretokens import encoder

END_ID = 2
#: Writer options of the format.
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.encoding.strategy": "SPEED",
    "compression": "zstd",
}
#: Shards of a data set at most: their starts, 16 bytes each, are broadcast.
MOST_SHARDS = 1_000_000
FILE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("start_in_shard", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
FILE_DDL = "doc_id long, shard int, start_in_shard long, n_tokens long, ids array<int>"


def encoded(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Rows of ``FILE_DDL`` in ascending order of ``doc_id``, shard after shard."""

    def encode(batches):
        from pyspark import TaskContext

        pieces, shard, at, end = encoder(vocabulary), TaskContext.get().partitionId(), 0, np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            texts, blobs = texts_of(batch.column("text")), []
            for text in texts:
                blobs.append(pieces.encode(text) + end)
            sizes = np.fromiter((len(b) // 4 for b in blobs), "i8", len(blobs))
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(blobs))])
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype("i4")), flat)
            yield to_batch({"doc_id": batch.column("doc_id"), "shard": np.full(len(texts), shard, "i4"), "start_in_shard": at + offsets[:-1], "n_tokens": sizes, "ids": ids}, FILE_SCHEMA)
            at += int(offsets[-1])

    short_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(encode, FILE_DDL)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    encoded(docs, vocabulary, end_id).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, shard, start (ids of all documents before it), n_tokens, ids."""
    rows = spark.read.schema(FILE_DDL).orc(path)
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("in_shard"))
    if shards.count() > MOST_SHARDS:
        raise ValueError(f"{path} has more than {MOST_SHARDS} shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", (F.coalesce(F.sum("in_shard").over(before), F.lit(0))).alias("shard_start"))
    return rows.join(F.broadcast(shards), "shard").select("doc_id", "shard", (F.col("shard_start") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids")


DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _digest(batch: pa.RecordBatch) -> dict:
    lists = batch.column("ids")
    flat, ends = np.asarray(lists.values).astype("<u4").tobytes(), np.asarray(lists.offsets).astype("i8") * 4
    crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return {"doc_id": batch.column("doc_id"), "start": batch.column("start"), "n_tokens": np.diff(ends) // 4, "ids_crc32": crc}


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of the ids, all from the ids as read."""
    return rows.select("doc_id", "start", "ids").mapInArrow(per_batch(DIGEST, _digest), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "token-ids")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return digest(read_tokens(spark, path))
