"""N-grams in frequent use, found without moving all n-grams.

First each task reports the hashes of its documents' shortest n-grams, four bytes each, dealt by their upper bits; only those
counted in enough documents can begin an n-gram that counts. Then n-grams made of such ones alone are spelled out, and counted by
their words. Words' hashes come from Spark; a collision lets an n-gram be counted in vain and changes no result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import words

#: Hashes that a task holds before it reports them.
HELD = 1 << 22
#: A fixed odd multiplier, and the size of the table that most n-grams are turned away by.
MIX, TABLE = np.uint64(0x9E3779B97F4A7C15), 1 << 22
REPORT = pa.schema([("slot", pa.int32()), ("held", pa.binary())])


def worded(docs: DataFrame, *more: str | Column) -> DataFrame:
    """``more``, ws (words) and hs (their hashes) of documents."""
    return docs.select(*more, words(F.col("text")).alias("ws")).select("*", F.transform("ws", lambda w: F.xxhash64(w)).alias("hs"))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values, and where each row's begin (one more than rows)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    starts = column.offsets.to_numpy()
    return column.values.slice(starts[0], starts[-1] - starts[0]), (starts - starts[0]).astype("i8")


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each place, of the ``n`` words from there; the last n - 1 places have none."""
    out = np.zeros(max(len(h) - n + 1, 0), "u8")
    for i in range(n):
        out = (out ^ h[i : i + len(out)]) * MIX
        out ^= out >> np.uint64(29)
    return out


def keys_of(h: np.ndarray, bits: int) -> np.ndarray:
    """The upper ``bits`` and the lower 32 of a hash."""
    return ((h >> np.uint64(64 - bits)) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _report(n: int, enough: int, bits: int):
    def given(parts):
        keys = np.sort(np.concatenate(parts))
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        at = np.nonzero(first)[0]
        nth = np.arange(len(keys)) - np.repeat(at, np.diff(np.append(at, len(keys))))
        keys = keys[nth < enough]  # more of one key tell nothing
        slots = (keys >> np.uint64(32)).astype("i8")
        cuts = np.searchsorted(slots, np.arange((1 << bits) + 1))
        low = keys.astype("u4")
        there = np.nonzero(np.diff(cuts))[0]
        return pa.RecordBatch.from_pydict({"slot": there.astype("i4"), "held": [low[cuts[s] : cuts[s + 1]].tobytes() for s in there]}, schema=REPORT)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            values, starts = flat(batch.column("hs"))
            keys = keys_of(rolled(values.to_numpy().view("u8"), n), bits)
            for a, b in zip(starts, starts[1:], strict=False):
                if b - a >= n:
                    parts.append(np.unique(keys[a : b - n + 1]))
                    held += len(parts[-1])
            if held >= HELD:
                yield given(parts)
                parts, held = [], 0
        if parts:
            yield given(parts)

    return run


def _frequent(enough: int):
    def run(batches):
        of = {}
        for batch in batches:
            for slot, held in zip(batch.column("slot").to_pylist(), batch.column("held"), strict=True):
                of.setdefault(slot, []).append(np.frombuffer(held.as_py(), "u4"))
        for slot in sorted(of):
            low = np.sort(np.concatenate(of.pop(slot)))
            at = np.nonzero(np.concatenate([[True], low[1:] != low[:-1]]))[0]
            often = low[at[np.diff(np.append(at, len(low))) >= enough]]
            yield pa.RecordBatch.from_pydict({"key": ((np.int64(slot) << 32) | often.astype("i8"))}, schema=pa.schema([("key", pa.int64())]))

    return run


class Known:
    """Sorted keys, most others turned away by a table of their lower bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.table = np.zeros(TABLE, bool)
        self.table[(keys & np.uint64(TABLE - 1)).astype("i8")] = True

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = self.table[(keys & np.uint64(TABLE - 1)).astype("i8")]
        some = np.nonzero(out)[0]
        if len(some) and len(self.keys):
            at = np.searchsorted(self.keys, keys[some])
            out[some] = self.keys[np.minimum(at, len(self.keys) - 1)] == keys[some]
        return out


def _found(batches, keys, least: int, most: int, bits: int):
    """A batch, a row's number in it, and the counts of that row's n-grams that are made of frequent ones."""
    known = Known(keys.value)
    for batch in batches:
        values, starts = flat(batch.column("hs"))
        often = known.has(keys_of(rolled(values.to_numpy().view("u8"), least), bits))
        strings, _ = flat(batch.column("ws"))
        for row, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
            m = often[a : max(b - least + 1, a)]
            if not m.any():
                continue
            ws, found = strings.slice(a, b - a).to_pylist(), []
            for n in range(least, most + 1):
                if n > least:
                    m = m[:-1] & often[a + n - least : a + n - least + len(m) - 1]  # all shorter ones count
                found.extend(" ".join(ws[i : i + n]) for i in np.nonzero(m)[0].tolist())
            yield batch, row, Counter(found)


COUNTED = pa.schema([("ngram", pa.string()), ("n_docs", pa.int64()), ("n_total", pa.int64())])
#: N-grams that a task counts before it reports them.
ENTRIES = 400_000


def _counted(keys, least: int, most: int, bits: int):
    """Counts of a task's documents together: each is a document of its own."""

    def run(batches):
        docs, total = Counter(), Counter()

        def given():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([docs[g] for g in total], pa.int64()), pa.array(list(total.values()), pa.int64())], schema=COUNTED)

        for _, _, found in _found(batches, keys, least, most, bits):
            docs.update(found.keys())
            total.update(found)
            if len(total) >= ENTRIES:
                yield given()
                docs, total = Counter(), Counter()
        if total:
            yield given()

    return run


def _by_document(keys, least: int, most: int, bits: int, schema):
    """Counts of each row: documents may have rows of the same doc_id."""

    def run(batches):
        for batch, row, found in _found(batches, keys, least, most, bits):
            ids = batch.column("doc_id").take(pa.array([row] * len(found))).cast(schema.field("doc_id").type)
            yield pa.RecordBatch.from_arrays([ids, pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], schema=schema)

    return run


def frequent_ngrams(docs: DataFrame, least: int, most: int, more_than_docs: int) -> DataFrame:
    """ngram, n, n_docs, n_total of the n-grams in more than so many documents.

    The hashes of the shortest ones that are frequent are broadcast, 8 bytes each.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, enough = docs.sparkSession, more_than_docs + 1
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(parts - 1, 1).bit_length()
    rows = worded(docs, "doc_id")
    reports = rows.select("hs").mapInArrow(_report(least, enough, bits), "slot int, held binary").repartition(parts, "slot")
    keys = reports.mapInArrow(_frequent(enough), "key long").toArrow().column("key").to_numpy().view("u8")
    told = spark.sparkContext.broadcast(np.sort(keys))
    if docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").limit(1).count():
        shape = docs.select("doc_id", F.lit("").alias("ngram"), F.lit(0).cast("long").alias("c")).schema
        per_doc = rows.mapInArrow(_by_document(told, least, most, bits, to_arrow_schema(shape)), shape).groupBy("ngram", "doc_id").agg(F.sum("c").alias("c"))
        counted = per_doc.select("ngram", F.lit(1).cast("long").alias("n_docs"), F.col("c").alias("n_total"))
    else:
        counted = rows.mapInArrow(_counted(told, least, most, bits), "ngram string, n_docs long, n_total long")
    out = counted.groupBy("ngram").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_total").alias("n_total")).where(F.col("n_docs") > more_than_docs)
    return out.select(F.size(F.split("ngram", " ")).alias("n"), "ngram", "n_docs", "n_total")


def _marked(keys, schema):
    def run(batches):
        known = {n: Known(k) for n, k in keys.value.items()}
        for batch in batches:
            values, starts = flat(batch.column("hs"))
            h = values.to_numpy().view("u8")
            end = np.repeat(starts[1:], np.diff(starts))
            cover = np.zeros(len(h) + 1, "i8")
            for n, k in known.items():
                at = np.nonzero(k.has(rolled(h, n)))[0]
                at = at[at + n <= end[at]]
                np.add.at(cover, at, 1)
                np.add.at(cover, at + n, -1)
            inside = np.cumsum(cover[:-1]) > 0
            mask = pa.ListArray.from_arrays(pa.array(starts.astype("i4")), pa.array(inside))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(schema.field("doc_id").type), batch.column("ws").cast(schema.field("ws").type), mask], schema=schema)

    return run


def marked(docs: DataFrame, formulas: DataFrame) -> DataFrame:
    """doc_id, ws, inside (for each word, whether an occurrence of a formula (n, ngram) covers it), a row a document's row.

    Formulas are broadcast as hashes of 64 bits; with a million of them and a thousand million places, one place is marked
    wrongly with a chance of 1 in 20,000.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    told = formulas.select(F.transform(F.split("ngram", " "), lambda w: F.xxhash64(w)).alias("hs")).toArrow().column("hs")
    h, starts = flat(told)
    h, sizes, of = h.to_numpy().view("u8"), np.diff(starts), {}
    for n in np.unique(sizes).tolist():
        first = starts[:-1][sizes == n]
        of[n] = np.sort(rolled(h, n)[first])
    shape = docs.select("doc_id", words(F.col("text")).alias("ws"), F.array(F.lit(True)).alias("inside")).schema
    return worded(docs, "doc_id").mapInArrow(_marked(docs.sparkSession.sparkContext.broadcast(of), to_arrow_schema(shape)), shape)
