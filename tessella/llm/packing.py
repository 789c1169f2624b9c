"""Packing of documents into sequences of a fixed length.

Bounded-space online packing. A partition keeps at most ``open_windows`` unfinished sequences. A
document gives whole sequences of its own first; what is left goes into the open window that it
fills best. Where none has room, a new window is opened, or, when all are taken, the fullest one is
emitted: its gap is filled with the beginning of the document, unless the gap is under ``least_piece``
ids and is padded. Windows still open at the end of a partition are merged group by group until one
group is left, whose rest is cut into sequences of powers of two, which need no padding.

Defined cases: null text is the empty text (its only id is the end id); repeated rows and null ids are
documents of their own; an empty table gives no rows; further columns are ignored. Results depend only on
the rows of each input partition and their order, so a lost task gives the same pieces again.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._common import short_batches, table, texts_of, to_batch, written
from tessella.llm.pretokens import encoder

LENGTH, END_ID, OPEN_WINDOWS, LEAST_PIECE = 4096, 2, 64, 16
#: Groups of partitions whose open windows one task merges.
MERGED_AT_ONCE = 16
PIECE = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
SCHEMA = pa.schema([*PIECE, ("ids", pa.binary()), ("origin", pa.int64()), ("open", pa.bool_())])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, origin long, open boolean"


class Rows:
    """Pieces on their way out."""

    def __init__(self, keep_ids: bool):
        self.columns: dict[str, list] = {f.name: [] for f in SCHEMA}
        self.keep_ids = keep_ids

    def add(self, sequence: int, pieces: list[tuple], origin: int, is_open: bool) -> None:
        offset, c = 0, self.columns
        for doc, start, ids, doc_tokens in pieces:
            length = len(ids) // 4
            for name, value in zip(c, (doc, start, length, zlib.crc32(ids), doc_tokens, sequence, offset, ids if is_open or self.keep_ids else None, origin, is_open), strict=True):
                c[name].append(value)
            offset += length

    def batch(self) -> pa.RecordBatch:
        out = to_batch(self.columns, SCHEMA)
        self.columns = {f.name: [] for f in SCHEMA}
        return out


def _cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
    doc, start, ids, total = piece
    return (doc, start, ids[: 4 * n], total), (doc, start + n, ids[4 * n :], total)


class Windows:
    """The open windows of a partition, by room left."""

    def __init__(self, length: int, most: int, least_piece: int):
        self.length, self.most, self.least = length, most, least_piece
        self.by_room: list[tuple[int, int]] = []
        self.pieces: dict[int, list[tuple]] = {}
        self.made = 0

    def place(self, piece: tuple):
        """Puts a piece shorter than a window; yields windows that are finished."""
        while True:
            n = len(piece[2]) // 4
            at = bisect_left(self.by_room, (n, -1))
            if at < len(self.by_room):
                room, window = self.by_room.pop(at)
                self.pieces[window].append(piece)
                if room == n:
                    yield self.pieces.pop(window)
                else:
                    insort(self.by_room, (room - n, window))
                return
            if len(self.by_room) < self.most:
                self.pieces[self.made] = [piece]
                insort(self.by_room, (self.length - n, self.made))
                self.made += 1
                return
            room, window = self.by_room.pop(0)
            if room >= self.least and n - room >= self.least:
                head, piece = _cut(piece, room)
                self.pieces[window].append(head)
            yield self.pieces.pop(window)


def _pack_partition(vocabulary: str, end_id: int, length: int, open_windows: int, least_piece: int, keep_ids: bool):
    def run(batches):
        from pyspark import TaskContext

        origin = TaskContext.get().partitionId()
        pieces, end, rows, windows = encoder(vocabulary), np.asarray([end_id], "<u4").tobytes(), Rows(keep_ids), Windows(length, open_windows, least_piece)
        sequence = origin << 32
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                ids = pieces.encode(text) + end
                piece = (doc, 0, ids, len(ids) // 4)
                while len(piece[2]) >= 4 * length:
                    head, piece = _cut(piece, length)
                    rows.add(sequence, [head], origin, False)
                    sequence += 1
                if piece[2]:
                    for done in windows.place(piece):
                        rows.add(sequence, done, origin, False)
                        sequence += 1
            yield rows.batch()
        for left in windows.pieces.values():
            rows.add(sequence, left, origin, True)
            sequence += 1
        yield rows.batch()

    return run


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _merge_groups(length: int, level: int, last: bool, keep_ids: bool):
    """Open pieces, sorted by group and place: fills sequences to the brim one after the other."""

    def run(batches):
        rows, group, held, room, sequence = Rows(keep_ids), None, [], length, 0

        def leave():
            if held and not last:
                rows.add(sequence, held, group, True)
            elif held:
                at = sequence
                left = list(held)
                for size in powers_of_two(sum(len(p[2]) // 4 for p in held)):
                    taken = []
                    while size:
                        head, rest = _cut(left.pop(0), size)
                        taken.append(head)
                        size -= len(head[2]) // 4
                        if rest[2]:
                            left.insert(0, rest)
                    rows.add(at, taken, group, False)
                    at += 1

        for batch in batches:
            names = ("group", "doc_id", "start", "ids", "doc_tokens")
            for its, doc, start, ids, total in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if its != group:
                    leave()
                    group, held, room, sequence = its, [], length, level << 56 | its << 24
                piece = (doc, start, ids, total)
                while len(piece[2]) // 4 >= room:
                    head, piece = _cut(piece, room)
                    rows.add(sequence, [*held, head], group, False)
                    sequence, held, room = sequence + 1, [], length
                if piece[2]:
                    held.append(piece)
                    room -= len(piece[2]) // 4
            yield rows.batch()
        leave()
        yield rows.batch()

    return run


def pack(docs: DataFrame, vocabulary: str, *, end_id: int = END_ID, length: int = LENGTH, open_windows: int = OPEN_WINDOWS, least_piece: int = LEAST_PIECE, keep_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (null unless ``keep_ids``)."""
    short_batches(docs.sparkSession)
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = written(rows.mapInArrow(_pack_partition(vocabulary, end_id, length, open_windows, least_piece, keep_ids), DDL), "packing")
    finished, open_rows, level = [placed.where(~F.col("open"))], placed.where("open"), 1
    while True:
        most = open_rows.agg(F.max("origin")).first()[0]
        last = most is None or most < MERGED_AT_ONCE
        grouped = open_rows.withColumn("group", F.floor(F.col("origin") / MERGED_AT_ONCE)).repartition(1 if last else int(most // MERGED_AT_ONCE) + 1, "group")
        merged = grouped.sortWithinPartitions("group", "sequence_id", "offset").mapInArrow(_merge_groups(length, level, last, keep_ids), DDL)
        merged = written(merged, "packing-merged")
        finished.append(merged.where(~F.col("open")))
        if last:
            break
        open_rows, level = merged.where("open"), level + 1
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out.drop("open", "origin")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")
