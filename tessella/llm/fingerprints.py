"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

The runs of five words of a text are hashed once; the upper bits of a hash name one of ``BINS`` bins, each of
which keeps its least hash. An empty bin copies the bin that a hash of its own number and an attempt picks, with
as many attempts as it takes to meet a bin that was not empty, so every filled bin is as likely as any other. Of
each bin ``BITS`` bits of a hash of its value and number are stored. Two unlike values agree in them with probability 2**-BITS, by which
the share of agreeing bins is corrected.

Defined cases: null and empty texts, and texts of white space, have the empty fingerprint, which is like itself
(1) and unlike others (0); texts of one to four words have one run; rows with equal or null ids follow each other
in order of their texts, null ids first; the only row of a table is its own next; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._common import short_batches, shuffle_partitions, table, texts_of, to_batch, written
from tessella.llm.words import mixed, shingle_hashes

BINS, BITS = 512, 4
LOW = np.uint8((1 << BITS) - 1)
EDGES = np.arange(BINS, dtype="u8") << np.uint64(64 - (BINS - 1).bit_length())


#: Attempts that are laid down beforehand; by then each bin has asked every other one, but for a chance of 1e-4.
ATTEMPTS = 16_384


@lru_cache(maxsize=1)
def first_asked() -> np.ndarray:
    """At which attempt a bin (line) first asks another one (column), as a hash of the bin's number and the attempt picks them."""
    bins = np.arange(BINS, dtype="u8")
    out = np.full((BINS, BINS), ATTEMPTS, "i2")
    for n in range(ATTEMPTS - 1, -1, -1):
        out[bins.astype("i8"), (mixed(bins * np.uint64(1_000_003) + np.uint64(n + 1)) >> np.uint64(64 - (BINS - 1).bit_length())).astype("i8")] = n
    return out


def fingerprint(text: str) -> bytes:
    """``BINS`` values of ``BITS`` bits, two a byte; empty for a text without words."""
    hashes = shingle_hashes(text)
    if not len(hashes):
        return b""
    hashes.sort()
    at = np.searchsorted(hashes, EDGES)
    full = np.append(at[1:], len(hashes)) > at
    values = hashes[np.minimum(at, len(hashes) - 1)]
    empty, filled = np.flatnonzero(~full), np.flatnonzero(full)
    if len(empty):
        values[empty] = values[filled[first_asked()[np.ix_(empty, filled)].argmin(axis=1)]]
    # copies of one hash show other bits in each bin, so that unlike hashes agree by chance bin by bin
    bits = mixed(values ^ EDGES).astype("u1") & LOW
    return (bits[0::2] << BITS | bits[1::2]).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The estimated Jaccard similarity of two fingerprints, corrected for chance agreement."""
    if not a or not b:
        return float(a == b)
    differ, chance = np.frombuffer(a, "u1") ^ np.frombuffer(b, "u1"), 2.0**-BITS
    agree = (np.count_nonzero(differ >> BITS == 0) + np.count_nonzero(differ & LOW == 0)) / BINS
    return min(1.0, max(0.0, (agree - chance) / (1 - chance)))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("edge", pa.int32()), ("text", pa.string())])
DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int, edge int, text string"
#: Values of ``edge``: a finished row, the first text of a partition, the last one of a partition, which still lacks its next.
DONE, FIRST, LAST = 0, 1, 2


class _Rows:
    def __init__(self, part: int):
        self.part, self.columns = part, {f.name: [] for f in SCHEMA}

    def _add(self, *values) -> None:
        for column, value in zip(self.columns.values(), values, strict=True):
            column.append(value)

    def edge(self, doc, text: str, edge: int) -> None:
        self._add(doc, None, None, None, None, None, None, self.part, edge, text)

    def done(self, doc, text: str, own: bytes, next_text: str, next_own: bytes) -> None:
        n = len(text)
        cut = n // 4
        edited = text[: n - cut] + next_text[:cut]
        print_edited = fingerprint(edited)
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        self._add(doc, n, sha, own.hex(), print_edited.hex(), likeness(own, print_edited), likeness(own, next_own), self.part, DONE, None)

    def batch(self) -> pa.RecordBatch:
        out = to_batch(self.columns, SCHEMA)
        self.columns = {f.name: [] for f in SCHEMA}
        return out


def _within(batches):
    """Rows of a range of ids in order; its first and last text are passed on."""
    from pyspark import TaskContext

    rows, held = _Rows(TaskContext.get().partitionId()), None
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
            own = fingerprint(text)
            if held is None:
                rows.edge(doc, text, FIRST)
            else:
                rows.done(*held, text, own)
            held = (doc, text, own)
        yield rows.batch()
    if held is not None:
        rows.edge(held[0], held[1], LAST)
        yield rows.batch()


def _between(batches):
    """First and last texts of the ranges, in order: the next of a last text is the first of the following range."""
    rows, very_first, waiting = _Rows(-1), None, None
    for batch in batches:
        for doc, text, edge in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), batch.column("edge").to_pylist(), strict=True):
            if edge == LAST:
                waiting = (doc, text)
                continue
            very_first = text if very_first is None else very_first
            if waiting is not None:
                rows.done(*waiting, fingerprint(waiting[1]), text, fingerprint(text))
        yield rows.batch()
    if waiting is not None:
        rows.done(*waiting, fingerprint(waiting[1]), very_first, fingerprint(very_first))
        yield rows.batch()


def fingerprints(docs: DataFrame) -> DataFrame:
    """For every document its fingerprint, that of its edited text, and how near those and its next neighbour are."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    made = written(ordered.mapInArrow(_within, DDL), "fingerprints")
    # two rows a partition
    edges = made.where(F.col("edge") != DONE).select("doc_id", "text", "edge", "part").repartition(1).sortWithinPartitions("part", "edge")
    last = edges.select("doc_id", "text", "edge").mapInArrow(_between, DDL)
    return made.where(F.col("edge") == DONE).unionByName(last).drop("part", "edge", "text")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
