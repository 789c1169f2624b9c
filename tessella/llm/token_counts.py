"""Token counts without a shuffle of pre-tokens.

A first pass over all texts keeps, in each task, a bounded sketch of the pieces it meets most; the
sketches are merged in a fixed number of tasks, and the lengths of the most frequent pieces become a
compact table that is broadcast (at most ``TABLE_PIECES`` pieces of at most ``TABLE_BYTES`` bytes). In
the second pass each worker looks pieces up there first, then in its own cache, and encodes the rest.
The table changes only the speed: counts are those of the library whatever it holds.

Defined cases: null text is the empty text; repeated rows and null ids are counted row by row; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._common import per_batch, short_batches, table, texts_of, to_batch
from tessella.llm.pretokens import Touching, encoder

LIMIT = 2048
TABLE_PIECES, TABLE_BYTES, SKETCH_PIECES, MERGING_TASKS = 32_768, 48, 8_192, 8
SKETCH = pa.schema([("slot", pa.int32()), ("pieces", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
SKETCH_DDL = "slot int, pieces array<string>, counts array<long>"


def pruned(counts: Counter, keep: int) -> Counter:
    """The ``keep`` most frequent entries, ties to the smaller piece."""
    return Counter(dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:keep])) if len(counts) > keep else counts


def _sketch(vocabulary: str):
    def run(batches):
        from pyspark import TaskContext

        cut, counts = encoder(vocabulary).cut, Counter()
        for batch in batches:
            for text in texts_of(batch.column("text")):
                counts.update(cut(text)[1])
            if len(counts) > 32 * SKETCH_PIECES:
                counts = pruned(counts, 4 * SKETCH_PIECES)
        kept = pruned(Counter({k: v for k, v in counts.items() if len(k.encode()) <= TABLE_BYTES}), SKETCH_PIECES)
        yield to_batch({"slot": [TaskContext.get().partitionId() % MERGING_TASKS], "pieces": [list(kept)], "counts": [list(kept.values())]}, SKETCH)

    return run


def _merge(batches):
    counts: Counter = Counter()
    for batch in batches:
        for pieces, n in zip(batch.column("pieces").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            counts.update(dict(zip(pieces, n, strict=True)))
            counts = pruned(counts, 4 * TABLE_PIECES)
    kept = pruned(counts, TABLE_PIECES)
    yield to_batch({"slot": [0], "pieces": [list(kept)], "counts": [list(kept.values())]}, SKETCH)


def frequent_pieces(texts: DataFrame, vocabulary: str) -> list[str]:
    """The most frequent pieces of all texts, as far as the bounded sketches tell."""
    sketches = texts.mapInArrow(_sketch(vocabulary), SKETCH_DDL).repartition(MERGING_TASKS, "slot")
    total: Counter = Counter()
    for row in sketches.mapInArrow(_merge, SKETCH_DDL).toLocalIterator():  # MERGING_TASKS rows of TABLE_PIECES entries at most
        total.update(dict(zip(row["pieces"], row["counts"], strict=True)))
    return list(pruned(total, TABLE_PIECES))


class TwoTiers(dict):
    """Lengths of the broadcast table; what it lacks comes from the worker's cache."""

    def __init__(self, pieces: list[str], lengths: bytes, miss):
        super().__init__(zip(pieces, lengths, strict=True))
        self.miss = miss

    def __missing__(self, piece: str) -> int:
        return self.miss(piece)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens above ``limit``), a row a document."""
    spark = docs.sparkSession
    short_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces_of = encoder(vocabulary)
    known = []
    for piece in frequent_pieces(rows.select("text"), vocabulary):
        try:
            n = pieces_of.piece_length(piece)
        except Touching:
            continue
        if n < 256:
            known.append((piece, n))
    shared = spark.sparkContext.broadcast(("\0".join(p for p, _ in known if "\0" not in p), bytes(n for p, n in known if "\0" not in p)))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
    held: list[TwoTiers] = []

    def kernel(batch: pa.RecordBatch) -> dict:
        own = encoder(vocabulary)
        if not held:
            words, lengths = shared.value
            held.append(TwoTiers(words.split("\0") if lengths else [], lengths, own.piece_length))
        length = held[0].__getitem__
        n_bytes, n_tokens = [], []
        for text in texts_of(batch.column("text")):
            n_bytes.append(len(text) if text.isascii() else len(text.encode()))
            try:
                first, rest = own.cut(text)
                n_tokens.append(len(own.beginning(first)) // 4 + sum(map(length, rest)) if text else 0)
            except Touching:
                n_tokens.append(len(own.encode(text)) // 4)
        return {"doc_id": batch.column("doc_id"), "n_bytes": n_bytes, "n_tokens": n_tokens, "over_limit": [n > limit for n in n_tokens]}

    return rows.mapInArrow(per_batch(schema, kernel), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
