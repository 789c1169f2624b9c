"""Removal of repeated 100-byte strings by suffix arrays.

1. Of equal texts one is kept for the search, in a table that is bucketed by a hash of the text; the others are
   covered whole if they have 100 bytes.
2. Its segments (see ``anchors``) go, packed, to tasks by their anchors' hashes. A segment whose anchor is nowhere else
   has no repeated string. Of segments with equal content all but the first are covered. Where an
   anchor has segments with unlike content, one of each is asked for.
3. The bytes of those are fetched from the table, again to tasks by anchor, and each task sorts the suffixes in two
   stages (see ``suffixes``), finds the common prefixes of neighbours, and covers every string that
   is not the first of its equals.
4. Covered stretches meet at their text again, where their bytes are taken out.

Equal strings have equal anchors, so all of them meet in one task; texts move once, whatever is found.

Defined cases: null text is the empty text; texts come in order of ``doc_id``, null first, then of their hash; equal
rows are texts of their own, of which one is the first; texts under 100 bytes stay; an empty table gives no rows;
other columns are ignored by ``covered`` and kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm._common import bucketed, short_batches, shuffle_partitions, table, to_batch, written
from tessella.llm.anchors import SPAN, segments
from tessella.llm.suffixes import PADDING, common_prefixes, suffix_array

#: Bytes of text that are laid end to end at once.
LAID = 2 << 20
NULL_FIRST = -(2**63)

PACKED = pa.schema([(n, pa.binary() if n != "slot" else pa.int32()) for n in ("slot", "keys", "ords", "doc", "first", "count", "anchor", "content", "bytes")])
PACKED_DDL = "slot int, keys binary, ords binary, doc binary, first binary, count binary, anchor binary, content binary, bytes binary"
FOUND = pa.schema([("key", pa.binary()), ("asked", pa.bool_()), ("stretches", pa.binary()), ("anchors", pa.binary())])
FOUND_DDL = "key binary, asked boolean, stretches binary, anchors binary"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key (SHA-256 of the text), text as bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("key", F.unhex(F.sha2("text", 256)))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """key, ord (the least doc_id), text: one row a text, bucketed by key so that joins by it don't move texts."""
    first = rows.where(F.length("text") >= SPAN).groupBy("key").agg(F.min(F.coalesce("doc_id", F.lit(NULL_FIRST))).alias("ord"), F.first("text").alias("text"))
    return bucketed(first, "texts", "key")


def _laid(batches):
    """Rows in groups of at most LAID bytes of text, or one longer text."""
    group, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and size + len(row[2]) > LAID:
                yield group
                group, size = [], 0
            group.append(row)
            size += len(row[2])
    if group:
        yield group


def _by_slot(slots: int, keys: list[bytes], ords: list[int], doc, first, count, anchor, content=None, texts=None):
    """Packed rows, one for each slot, of segments dealt by their anchors."""
    slot = (anchor % np.uint64(slots)).astype("i4")
    order = np.argsort(slot, kind="stable")
    cuts = np.searchsorted(slot[order], np.arange(slots + 1))
    ords_of = np.array(ords, "i8")
    out = {f.name: [] for f in PACKED}
    for s in range(slots):
        mine = order[cuts[s] : cuts[s + 1]]
        if len(mine):
            docs, its = np.unique(doc[mine], return_inverse=True)
            values = (s, b"".join(keys[d] for d in docs.tolist()), ords_of[docs].tobytes(), its.astype("u4").tobytes(), first[mine].astype("u4").tobytes(), count[mine].astype("u1").tobytes(), anchor[mine].tobytes(), content[mine].tobytes() if content is not None else None, b"".join(texts[i] for i in mine.tolist()) if texts is not None else None)
            for column, v in zip(out.values(), values, strict=True):
                column.append(v)
    return to_batch(out, PACKED)


def _segments_of(slots: int):
    def run(batches):
        for group in _laid(batches):
            texts = [row[2] for row in group]
            starts = np.cumsum([0, *map(len, texts)])
            first, count, anchor, content = segments(np.frombuffer(b"".join(texts), "u1"), starts)
            doc = np.searchsorted(starts, first, "right") - 1
            yield _by_slot(slots, [r[0] for r in group], [r[1] for r in group], doc, first - starts[doc], count, anchor, content)

    return run


def _gathered(batches) -> dict[str, np.ndarray] | None:
    """The packed rows of a task together: keys, order of the docs, and columns of their segments."""
    kinds = {"ords": "i8", "doc": "u4", "first": "u4", "count": "u1", "anchor": "u8", "content": "u8"}
    parts: dict[str, list] = {k: [] for k in (*kinds, "keys", "bytes")}
    docs = 0
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in (*kinds, "keys", "bytes")}
            for n, kind in kinds.items():
                if row[n] is not None:
                    values = np.frombuffer(row[n], kind)
                    parts[n].append(values.astype("i8") + docs if n == "doc" else values)
            parts["keys"].append(row["keys"])
            parts["bytes"].append(row["bytes"])
            docs += len(row["ords"]) // 8
    if not docs:
        return None
    out = {n: np.concatenate(v) for n, v in parts.items() if n in kinds and v}
    keys = np.frombuffer(b"".join(parts["keys"]), ">u8").reshape(-1, 4)
    # doc's rank by (ord, key); a text is in many packed rows and has one rank
    order = np.lexsort((keys[:, 3], keys[:, 2], keys[:, 1], keys[:, 0], out["ords"]))
    new = np.ones(docs, bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]).any(axis=1)
    rank = np.empty(docs, "i8")
    rank[order] = np.cumsum(new) - 1
    out["keys"] = keys[order][new]
    out["doc"] = rank[out["doc"]]
    out["place"] = out["doc"] << 32 | out["first"].astype("i8")
    if parts["bytes"][0] is not None:
        out["bytes"] = b"".join(parts["bytes"])
    return out


def _rows(keys: np.ndarray, asked: bool, doc: np.ndarray, values: np.ndarray, anchor: np.ndarray | None):
    """A row a text of pairs of numbers."""
    order = np.argsort(doc, kind="stable")
    doc, values = doc[order], np.ascontiguousarray(values[order].astype("u4"))
    anchor = anchor[order] if anchor is not None else None
    cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True]) if len(doc) else np.zeros(1, "i8")
    for at in range(0, len(cuts) - 1, 4096):
        edges = cuts[at : at + 4097].tolist()
        pairs = list(zip(edges[:-1], edges[1:], strict=True))
        yield to_batch({"key": [keys[doc[a]].tobytes() for a, _ in pairs], "asked": [asked] * len(pairs), "stretches": [values[a:b].tobytes() for a, b in pairs], "anchors": [anchor[a:b].tobytes() if anchor is not None else None for a, b in pairs]}, FOUND)


def _compare(batches):
    """Covers all but the first of segments with equal content; asks for one of each where an anchor has several."""
    its = _gathered(batches)
    if its is None:
        return
    order = np.lexsort((its["place"], its["content"], its["anchor"]))
    anchor, content = its["anchor"][order], its["content"][order]
    new_anchor = np.r_[True, anchor[1:] != anchor[:-1]]
    new = new_anchor | np.r_[True, content[1:] != content[:-1]]
    of_anchor = np.cumsum(new_anchor) - 1
    kinds = np.bincount(of_anchor[new])
    doc, first, count = its["doc"][order], its["first"][order].astype("i8"), its["count"][order].astype("i8")
    yield from _rows(its["keys"], False, doc[~new], np.stack([first, first + count + SPAN - 1], 1)[~new], None)
    ask = new & (kinds[of_anchor] > 1)
    yield from _rows(its["keys"], True, doc[ask], np.stack([first, count], 1)[ask], anchor[ask])


def _fetch(slots: int):
    """The bytes of the segments that were asked for."""

    def run(batches):
        for group in _laid(batches):
            doc, first, count, anchor, texts = [], [], [], [], []
            for d, (_, _, text, asked, anchors) in enumerate(group):
                pairs = np.frombuffer(b"".join(asked), "u4").reshape(-1, 2).astype("i8")
                doc.append(np.full(len(pairs), d))
                first.append(pairs[:, 0])
                count.append(pairs[:, 1])
                anchor.append(np.frombuffer(b"".join(anchors), "u8"))
                texts.extend(text[a : a + n + SPAN - 1] for a, n in pairs.tolist())
            doc, first, count, anchor = map(np.concatenate, (doc, first, count, anchor))
            yield _by_slot(slots, [r[0] for r in group], [r[1] for r in group], doc, first, count, anchor, None, texts)

    return run


def _sort(batches):
    """Covers strings that are not the first of their equals, by a suffix array of the task's segments."""
    its = _gathered(batches)
    if its is None:
        return
    count = its["count"].astype("i8")
    sizes = count + SPAN - 1
    at = np.cumsum(sizes) - sizes
    starts = at + np.arange(len(at))  # a zero byte after each segment
    data = np.zeros(int(sizes.sum()) + len(at) + PADDING, "u1")
    data[np.repeat(np.arange(len(at)), sizes) + np.arange(int(sizes.sum()))] = np.frombuffer(its["bytes"], "u1")
    array = suffix_array(data, starts, count)
    new = np.r_[True, common_prefixes(data, array) < SPAN]
    segment = np.searchsorted(starts, array, "right") - 1
    place = its["place"][segment] + (array - starts[segment])
    first = np.minimum.reduceat(place, np.flatnonzero(new))
    place = np.sort(place[place > first[np.cumsum(new) - 1]])
    # runs that follow each other make one stretch
    edge = np.flatnonzero(np.r_[True, np.diff(place) > 1]) if len(place) else np.zeros(0, "i8")
    last = np.r_[edge[1:], len(place)] - 1 if len(edge) else edge
    begin = place[edge] & 0xFFFFFFFF
    yield from _rows(its["keys"], False, place[edge] >> 32, np.stack([begin, (place[last] & 0xFFFFFFFF) + SPAN], 1), None)


def merged(pairs: np.ndarray) -> np.ndarray:
    """Stretches in order, those that touch joined."""
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    ends = np.maximum.accumulate(pairs[:, 1])
    new = np.r_[True, pairs[1:, 0] > ends[:-1]]
    at = np.flatnonzero(new)
    return np.stack([pairs[at, 0], ends[np.r_[at[1:], len(pairs)] - 1]], 1)


def covered(texts: DataFrame) -> DataFrame:
    """key and the covered stretches (pairs of unsigned 32-bit numbers, unsorted) of each distinct text that has any."""
    spark = texts.sparkSession
    short_batches(spark)
    slots = shuffle_partitions(spark)
    packed = texts.select("key", "ord", "text").mapInArrow(_segments_of(slots), PACKED_DDL)
    compared = written(packed.repartition(slots, "slot").mapInArrow(_compare, FOUND_DDL), "segments-compared")
    asked = compared.where("asked").groupBy("key").agg(F.collect_list("stretches").alias("stretches"), F.collect_list("anchors").alias("anchors"))
    fetched = texts.join(asked, "key").select("key", "ord", "text", "stretches", "anchors").mapInArrow(_fetch(slots), PACKED_DDL)
    sorted_ = fetched.repartition(slots, "slot").mapInArrow(_sort, FOUND_DDL)
    every = compared.where("not asked").select("key", "stretches").unionByName(sorted_.select("key", "stretches"))
    return every.groupBy("key").agg(F.collect_list("stretches").alias("stretches"))


CUT = pa.schema([("key", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("spans", pa.list_(pa.int64()))])
CUT_DDL = "key binary, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<long>"


def _cut(keep_text: bool):
    def run(batches):
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in CUT}
            for key, text, blobs in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("stretches").to_pylist(), strict=True):
                spans = merged(np.frombuffer(b"".join(blobs), "u4").reshape(-1, 2).astype("i8")).tolist()
                edges = [0, *(x for s in spans for x in s), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True))
                for column, v in zip(out.values(), (key, len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore").encode() if keep_text else None, [x for s in spans for x in s]), strict=True):
                    column.append(v)
            yield to_batch(out, CUT)

    return run


def _firsts(docs: DataFrame, keep_text: bool) -> DataFrame:
    """key, ord of the first document of each text of ``SPAN`` bytes or more, with what is cut from it (``CUT_DDL``, null if nothing)."""
    texts = distinct_texts(keyed(docs))
    cut = texts.join(covered(texts), "key").select("key", "text", "stretches").mapInArrow(_cut(keep_text), CUT_DDL)
    return texts.select("key", "ord").join(cut, "key", "left").withColumn("held_", F.lit(True))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (begin and end of each removed run) of every document.

    A text's first document is met by key and id together, so copies, which need nothing but their length, never meet in one task.
    """
    firsts = _firsts(docs, False).withColumnsRenamed({"key": "f_key", "ord": "f_ord"})
    by_row = keyed(docs).groupBy("key", "doc_id", F.length("text").cast("long").alias("n_bytes")).agg(F.count("*").cast("int").alias("n"))
    each = by_row.join(firsts, (by_row["key"] == firsts["f_key"]) & (F.coalesce("doc_id", F.lit(NULL_FIRST)) == firsts["f_ord"]), "left")
    each = each.withColumn("i", F.explode(F.sequence(F.lit(1), "n")))
    whole = ~(F.col("held_").isNotNull() & (F.col("i") == 1)) & (F.col("n_bytes") >= SPAN)
    none = F.array().cast("array<bigint>")
    n_removed = F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0)))
    n_spans = F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0)))
    sha = F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("key"))))
    spans = F.when(whole, F.array(F.lit(0).cast("long"), F.col("n_bytes"))).otherwise(F.coalesce("spans", none))
    return each.select("doc_id", "n_bytes", n_removed.cast("long").alias("n_removed"), n_spans.cast("long").alias("n_spans"), sha.alias("kept_sha256"), spans.alias("spans"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with what is left of their texts, and ``n_chars``, if there, to match.

    A row goes when nothing is left of a text that had something. Of a character that a cut goes through, nothing is kept.
    """
    # further columns may have any names
    as_bytes = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    packed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_FIRST)).alias("r_ord"), F.col("text").alias("r_text"), (F.length(as_bytes) < SPAN).alias("r_short"), F.unhex(F.sha2(as_bytes, 256)).alias("r_key"), F.struct("*").alias("row"))
    firsts = _firsts(docs, True).select("key", "ord", "held_", F.col("kept").alias("left_"))
    joined = packed.join(firsts, (packed["r_key"] == firsts["key"]) & (packed["r_ord"] == firsts["ord"]), "left").where("r_short or held_")
    # rows with the first one's id and text are its copies
    nth = F.row_number().over(Window.partitionBy("r_key", "r_ord").orderBy(F.lit(0)))
    joined = joined.withColumn("nth_", nth).where("r_short or nth_ = 1")
    joined = joined.where(F.col("left_").isNull() | (F.length("left_") > 0))
    text = F.when(F.col("left_").isNull(), F.col("r_text")).otherwise(F.col("left_").cast("string"))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("left_").isNull(), F.col("row.n_chars")).otherwise(F.length(text).cast("long")))
    return joined.select(row.alias("row")).select("row.*")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents")).drop("spans")
