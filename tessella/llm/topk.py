"""Exact top-k search by inner product, in three phases with a uniform threshold.

Every dimension of a vector lies in one of ``LISTS`` slices; a slice of all vectors is a list of partial scores, and a
score is the sum of one entry of each list. Queries and candidates of one length are packed into blocks. A task has a part of
the candidates' blocks, which it reads one after the other for each block of queries, and sends one report a block of queries.

1. From each list a task gathers the entries above the k-th best partial score that it has met there so far, adds up
   the full scores of those alone, and reports the best ``k``. The k-th best of all reports is a score that k candidates
   reach: the query's cutoff.
2. The cutoff goes back to all tasks of the query's block. A candidate whose score is no lower has, in one of its lists,
   at least the cutoff divided by the number of lists: that uniform threshold collects all that may count. Queries for which
   the lengths of the slices' vectors leave no candidate of a block above the threshold skip the block.
3. The other lists' entries of what was collected are added up exactly; what reaches the cutoff is reported, at most ``k`` a
   task, and merged.

Lists are not kept between phases, as they have an entry for every pair; a list is computed again where it is read again.
Components are floor(64 * x), and scores are computed in whole numbers: as doubles where no sum can pass 2**53, else as
Python's integers.

Defined cases: vectors that are null or hold a null or a component that is not finite take no part, nor do rows
without an id; an inner product is that of vectors of one length, so each length is searched by itself (empty vectors among
themselves, with the score 0); equal rows are candidates of each other; fewer candidates than ``k``
give fewer rows; scores beyond 64 bits raise an error; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._common import shuffle_partitions, table, to_batch, written

K, LISTS, CANDIDATE_BLOCK, QUERY_BLOCK = 20, 4, 4096, 1024
EXACT = 2**53

BLOCK = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("queries", pa.bool_()), ("ids", pa.binary()), ("rows", pa.binary()), ("values", pa.binary())])
BLOCK_DDL = "block long, n int, queries boolean, ids binary, rows binary, values binary"
BEST = pa.schema([("q_block", pa.int64()), ("ids", pa.binary()), ("scores", pa.binary()), ("rows", pa.binary())])
BEST_DDL = "q_block long, ids binary, scores binary, rows binary"
NONE = 1 - 2**63


def _blocks(every: int):
    """Packed blocks of candidates of one length ``n``, and of the queries among them. A row's number is unique and kept with it."""

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        held: dict[tuple[int, bool], list[tuple]] = {}
        made, row = 0, 0

        def full(n: int, queries: bool, least: int):
            nonlocal made
            size = QUERY_BLOCK if queries else CANDIDATE_BLOCK
            while sum(len(x[0]) for x in held[n, queries]) >= least:
                parts = [np.concatenate(x) for x in zip(*held[n, queries], strict=True)]
                ids, rows, values = (x[:size].tobytes() for x in parts)
                yield to_batch({"block": [base | made], "n": [n], "queries": [queries], "ids": [ids], "rows": [rows], "values": [values]}, BLOCK)
                made += 1
                held[n, queries] = [tuple(x[size:] for x in parts)]

        for batch in batches:
            ids = np.asarray(batch.column("vec_id").to_numpy(zero_copy_only=False), "i8")
            lists = batch.column("v")
            lengths = np.diff(np.asarray(lists.offsets).astype("i8"))
            values = np.floor(64 * np.asarray(lists.flatten().to_numpy(zero_copy_only=False), "f8"))
            rows = base + row + np.arange(len(ids))
            row += len(ids)
            of = np.repeat(lengths, lengths)
            for n in np.unique(lengths).tolist():
                its, vectors = lengths == n, values[of == n].reshape(-1, n) if n else np.zeros((int((lengths == 0).sum()), 0))
                for queries in (False, True):
                    mine = ids[its] % every == 0 if queries else slice(None)
                    held.setdefault((n, queries), []).append((ids[its][mine], rows[its][mine], vectors[mine]))
                    yield from full(n, queries, QUERY_BLOCK if queries else CANDIDATE_BLOCK)
        for n, queries in list(held):
            yield from full(n, queries, 1)

    return run


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact."""
    if not a.size or not b.size or float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] * 16 < EXACT:  # sums over all slices are exact as well
        return a @ b.T
    as_int = lambda x: np.array([[int(v) for v in r] for r in x], object)
    return as_int(a) @ as_int(b).T


def _as_long(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object and len(scores.ravel()) and max(map(abs, scores.ravel().tolist())) >= 2**63 - 1:
        raise OverflowError("a score does not fit into 64 bits")
    return scores.astype("i8")


def _slices(n: int, lists: int) -> list[slice]:
    edges = np.linspace(0, n, lists + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def best(ids: np.ndarray, scores: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each line by score, then id, then row; lines may have fewer, marked by the score NONE."""
    if scores.shape[1] > 4 * k:  # what cannot be among them goes first
        keep = scores >= -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        width = int(keep.sum(axis=1).max())
        order = np.argsort(~keep, axis=1, kind="stable")[:, :width]
        kept = np.take_along_axis(keep, order, 1)
        ids, rows = (np.take_along_axis(x, order, 1) for x in (ids, rows))
        scores = np.where(kept, np.take_along_axis(scores, order, 1), NONE)
    order = np.lexsort((rows, ids, -scores), axis=1)[:, :k]
    return tuple(np.take_along_axis(x, order, 1) for x in (ids, scores, rows))


def _in_lines(line: np.ndarray, n: int, columns: list[np.ndarray], fill: list) -> list[np.ndarray]:
    """Entries, in order of their lines, as matrices of ``n`` lines; what lines lack is filled."""
    per_line = np.bincount(line, minlength=n)
    at = np.arange(len(line)) - np.repeat(np.cumsum(per_line) - per_line, per_line)
    out = []
    for column, value in zip(columns, fill, strict=True):
        matrix = np.full((n, int(per_line.max(initial=0))), value, column.dtype)
        matrix[line, at] = column
        out.append(matrix)
    return out


def _highest(values: np.ndarray, k: int) -> np.ndarray:
    """The k highest of each line, as doubles, in any order."""
    values = values.astype("f8")
    return values if values.shape[1] <= k else np.partition(values, values.shape[1] - k, axis=1)[:, -k:]


class _Queries:
    """A block of queries on its way past a task's blocks of candidates."""

    def __init__(self, block: int, rows: np.ndarray, values: np.ndarray, k: int, lists: int, cutoffs: np.ndarray | None):
        self.block, self.rows, self.values, self.k, self.cutoffs = block, rows, values, k, cutoffs
        self.slices = _slices(values.shape[1], lists) or [slice(0, 0)]
        self.lengths = [np.sqrt((values[:, s] ** 2).sum(axis=1)) for s in self.slices]
        # a query may be among the candidates, so one more is kept
        self.highest = [np.full((len(rows), 0), 0.0) for _ in self.slices]
        self.found = tuple(np.full((len(rows), 0), 0, "i8") for _ in range(3))

    def _gathered(self, parts: list[np.ndarray]) -> np.ndarray:
        wanted = np.zeros(parts[0].shape, bool)
        for i, p in enumerate(parts):
            if self.highest[i].shape[1] <= self.k:
                best = _highest(p, self.k + 1)
                passed = p >= best.min(axis=1, initial=np.inf)[:, None]
            else:
                passed = p > self.highest[i].min(axis=1)[:, None]
                line, place = np.nonzero(passed)
                best = _in_lines(line, len(p), [p[line, place].astype("f8")], [-np.inf])[0]
            wanted |= passed.astype(bool)
            self.highest[i] = _highest(np.concatenate([self.highest[i], best], axis=1), self.k + 1)
        return wanted

    def meet(self, ids: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
        queries = np.arange(len(self.rows))
        if self.cutoffs is not None:
            # what the lengths of the vectors allow, with room for rounding
            most = [q * np.sqrt((values[:, s] ** 2).sum(axis=1).max(initial=0.0)) * (1 + 1e-9) + 1 for q, s in zip(self.lengths, self.slices, strict=True)]
            may = (sum(most) >= self.cutoffs) & (np.max(most, axis=0) * len(most) >= self.cutoffs)
            queries = np.flatnonzero(may)
            if not len(queries):
                return
        parts = [_products(self.values[queries, s], values[:, s]) for s in self.slices]
        if self.cutoffs is None:
            wanted = self._gathered(parts)
        else:
            wanted = np.zeros(parts[0].shape, bool)
            for p in parts:
                wanted |= (p * len(parts) >= self.cutoffs[queries][:, None]).astype(bool)
        line, place = np.nonzero(wanted & (self.rows[queries][:, None] != rows))
        scores = _as_long(sum(p[line, place] for p in parts))
        if self.cutoffs is not None:
            enough = scores >= self.cutoffs[queries][line]
            line, place, scores = line[enough], place[enough], scores[enough]
        more = _in_lines(queries[line], len(self.rows), [ids[place], scores, rows[place]], [0, NONE, 0])
        self.found = best(*(np.concatenate(x, axis=1) for x in zip(self.found, more, strict=True)), self.k)

    def report(self) -> pa.RecordBatch:
        ids, scores, rows = (np.ascontiguousarray(x).tobytes() for x in self.found)
        return to_batch({"q_block": [self.block], "ids": [ids], "scores": [scores], "rows": [rows]}, BEST)


def _search(k: int, lists: int, phase: int):
    """Rows are pairs of blocks, those of one block of queries together. One report for each of these."""

    def run(batches):
        held = None
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, kind: np.frombuffer(batch.column(c)[i].as_py(), kind)  # noqa: B023, E731
                block, n = batch.column("q_block")[i].as_py(), batch.column("n")[i].as_py()
                if held is None or held.block != block:
                    if held is not None:
                        yield held.report()
                    rows = get("q_rows", "i8")
                    held = _Queries(block, rows, get("q_values", "f8").reshape(len(rows), n), k, lists, get("cutoffs", "i8") if phase > 1 else None)
                ids = get("c_ids", "i8")
                held.meet(ids, get("c_rows", "i8"), get("c_values", "f8").reshape(len(ids), n))
        if held is not None:
            yield held.report()

    return run


def _merge(k: int, sizes: str):
    """Reports of a block of queries, one after the other (rows come sorted by block), to the best k of each."""

    def run(batches):
        block, held = None, None

        def row():
            return to_batch({"q_block": [block], "ids": [held[0].tobytes()], "scores": [held[1].tobytes()], "rows": [held[2].tobytes()]}, BEST)

        for batch in batches:
            for i in range(batch.num_rows):
                its, n = batch.column("q_block")[i].as_py(), batch.column(sizes)[i].as_py()
                found = [np.frombuffer(batch.column(c)[i].as_py(), "i8").reshape(n, -1) for c in ("ids", "scores", "rows")]
                if its == block:
                    found = best(*(np.concatenate(x, axis=1) for x in zip(held, found, strict=True)), k)
                elif block is not None:
                    yield row()
                block, held = its, tuple(map(np.ascontiguousarray, found))
        if block is not None:
            yield row()

    return run


RESULT = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            query = np.frombuffer(batch.column("q_ids")[i].as_py(), "i8")
            ids, scores = (np.frombuffer(batch.column(c)[i].as_py(), "i8").reshape(len(query), -1) for c in ("ids", "scores"))
            there = scores > NONE
            rank = np.cumsum(there, axis=1)
            yield to_batch({"query_id": np.broadcast_to(query[:, None], ids.shape)[there], "rank": rank[there].astype("i4"), "vec_id": ids[there], "score": scores[there]}, RESULT)


def top_k(vectors: DataFrame, *, every: int = 20, k: int = K, lists: int = LISTS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every``, its k best other rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    packed = written(rows.where(F.forall("v", finite)).mapInArrow(_blocks(every), BLOCK_DDL), "vector-blocks")
    spread = shuffle_partitions(spark)
    # every block of queries is sent to each part of the candidates
    parts = max(1, min(spread, packed.where("not queries").count()))
    queries = packed.where("queries").select(F.col("block").alias("q_block"), "n", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("values").alias("q_values"))
    candidates = packed.where("not queries").select("n", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("long").alias("part"), F.col("ids").alias("c_ids"), F.col("rows").alias("c_rows"), F.col("values").alias("c_values"))

    def pairs(q: DataFrame) -> DataFrame:
        sent = q.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        return sent.join(candidates.hint("merge"), ["part", "n"]).drop("part")

    def merged(found: DataFrame) -> DataFrame:
        sized = found.join(queries.select("q_block", (F.length("q_rows") / 8).cast("int").alias("size")), "q_block")
        return sized.repartition(spread, "q_block").sortWithinPartitions("q_block").mapInArrow(_merge(k, "size"), BEST_DDL)

    first = merged(pairs(queries).mapInArrow(_search(k, lists, 1), BEST_DDL))
    cutoffs = first.select("q_block", "ids", "scores").join(queries.select("q_block", "q_ids"), "q_block").mapInArrow(_cutoffs(k), "q_block long, cutoffs binary")
    cutoffs = written(cutoffs, "cutoffs")
    found = merged(pairs(queries.join(cutoffs, "q_block")).mapInArrow(_search(k, lists, 2), BEST_DDL))
    return found.join(queries.select("q_block", "q_ids"), "q_block").mapInArrow(_rows, "query_id long, rank int, vec_id long, score long")


CUTOFF = pa.schema([("q_block", pa.int64()), ("cutoffs", pa.binary())])


def _cutoffs(k: int):
    """The k-th best score of each query; where there are fewer, any score passes."""

    def run(batches):
        for batch in batches:
            out = {"q_block": batch.column("q_block"), "cutoffs": []}
            for ids, blob in zip(batch.column("q_ids").to_pylist(), batch.column("scores").to_pylist(), strict=True):
                scores = np.frombuffer(blob, "i8").reshape(len(ids) // 8, -1)
                out["cutoffs"].append((scores[:, k - 1] if scores.shape[1] >= k else np.full(len(scores), NONE)).tobytes())
            yield to_batch(out, CUTOFF)

    return run


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))
