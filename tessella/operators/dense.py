"""Dense retrieval: exact best-k lists of vectors by blocks, hubness, aggregation from small units to large ones.

Vectors are packed into blocks and put aside; every block of sources is read beside every block of targets, so that scores are
products of matrices, no vector is shuffled for them, and only a source's best k of all the blocks that its task has met leave
it, as one row. A constant per target (for CSLS) can be taken off each score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.tables import kept

BLOCK = 2048
#: Bytes of targets that a task reads beside its sources; each such part gives its own best k.
HELD = 64 << 20
#: Scores have six digits; one that is less by this than another is not rounded to as much.
NEAR = 2e-6
COLUMNS = ("block", "ids", "values", "minus", "units")
PACKED = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("values", pa.binary()), ("minus", pa.binary()), ("units", pa.list_(pa.string()))])
ENTRY = pa.struct([("less", pa.float64()), ("tgt", pa.int64())])
LIST = pa.schema([("src", pa.int64()), ("best", pa.list_(ENTRY))])
UNITS = pa.schema([("src", pa.int64()), ("unit", pa.string()), ("other", pa.string()), ("m", pa.float64())])


def _pack(batches):
    from pyspark import TaskContext

    made = TaskContext.get().partitionId() << 32
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            values = np.asarray(part.column("v").flatten().to_numpy(zero_copy_only=False), "f8")
            narrow = values.astype("f4")
            if (narrow == values).all():  # as stored; a block's width follows from its length
                values = narrow
            ids, minus = (np.asarray(part.column(c).to_numpy(zero_copy_only=False)) for c in ("id", "minus"))
            yield pa.RecordBatch.from_pydict({"block": [made], "ids": [ids.astype("i8").tobytes()], "values": [values.tobytes()], "minus": [minus.astype("f8").tobytes()], "units": [part.column("unit").to_pylist()]}, schema=PACKED)
            made += 1


def packed(rows: DataFrame) -> DataFrame:
    """Blocks of rows (id, v, minus, unit if there is one), put aside."""
    unit = F.col("unit").cast("string") if "unit" in rows.columns else F.lit(None).cast("string")
    blocks = rows.select("id", "v", "minus", unit.alias("unit")).mapInArrow(_pack, "block long, ids binary, values binary, minus binary, units array<string>")
    return kept(blocks, "vectors")


class _Side:
    """A block's rows as arrays, vectors of length 1 if cosines are asked for."""

    def __init__(self, batch, i: int, side: str, width: int, cosine: bool):
        get = lambda n, kind: np.frombuffer(batch.column(f"{side}_{n}")[i].as_py(), kind)
        self.ids, self.minus = get("ids", "i8"), get("minus", "f8")
        values = batch.column(f"{side}_values")[i].as_py()
        n = max(len(self.ids), 1)
        self.x = np.frombuffer(values, "f4" if len(values) == 4 * n * width else "f8").reshape(len(self.ids), -1).astype("f8")
        if cosine:
            self.x = self.x / np.maximum(np.sqrt((self.x * self.x).sum(1, keepdims=True)), 1e-300)
        self.units = lambda: np.array([u if u is not None else "" for u in batch.column(f"{side}_units")[i].as_py()], dtype=object)


def _met(batches, width: int, cosine: bool, start, meet, end):
    """A source block's targets come one after the other: its state is begun, meets each of them, and is given out."""
    block, a, state = None, None, None
    for batch in batches:
        numbers = batch.column("a_block").to_pylist()
        for i, number in enumerate(numbers):
            if number != block:
                if state is not None:
                    yield end(a, state)
                block, a = number, _Side(batch, i, "a", width, cosine)
                state = start(a)
            meet(a, state, _Side(batch, i, "b", width, cosine))
    if state is not None:
        yield end(a, state)


def _scores(a: _Side, b: _Side, scale: float):
    score = a.x @ b.x.T
    if scale != 1.0:
        score *= scale
    if a.minus.any():
        score -= a.minus[:, None]
    if b.minus.any():
        score -= b.minus
    if not np.isfinite(score.sum()):
        score[np.isnan(score)] = -np.inf
    own = np.nonzero(np.isin(b.ids, a.ids))[0]
    if len(own):
        score[:, own] = np.where(a.ids[:, None] == b.ids[own], -np.inf, score[:, own])
    return score


def _best(k: int, scale: float, cosine: bool, width: int):
    def start(a):
        return {"score": np.full((len(a.ids), k), -np.inf), "tgt": np.zeros((len(a.ids), k), "i8")}

    def meet(a, state, b):
        score = _scores(a, b, scale)
        cut = state["score"][:, k - 1]
        if len(b.ids) > k and not np.isfinite(cut).all():
            cut = np.maximum(cut, np.partition(score, len(b.ids) - k, axis=1)[:, len(b.ids) - k])
        row, col = np.nonzero(score >= np.maximum(cut - NEAR, np.finfo("f8").min)[:, None])
        if not len(row):
            return
        old, place = np.nonzero(state["score"] > -np.inf)
        rows = np.concatenate([old, row])
        s = np.concatenate([state["score"][old, place], np.round(score[row, col], 6) + 0.0])
        t = np.concatenate([state["tgt"][old, place], b.ids[col]])
        order = np.lexsort((t, -s, rows))
        rows, s, t = rows[order], s[order], t[order]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        first = nth < k
        state["score"][rows[first], nth[first]] = s[first]
        state["tgt"][rows[first], nth[first]] = t[first]

    def end(a, state):
        there = state["score"] > -np.inf
        best = pa.StructArray.from_arrays([pa.array(0.0 - state["score"][there]), pa.array(state["tgt"][there])], fields=list(ENTRY))
        starts = np.concatenate([[0], np.cumsum(there.sum(1))]).astype("i4")
        return pa.RecordBatch.from_arrays([pa.array(a.ids), pa.ListArray.from_arrays(pa.array(starts), best)], schema=LIST)

    return lambda batches: _met(batches, width, cosine, start, meet, end)


def _best_in_units(cosine: bool, width: int):
    def start(a):
        return {}

    def meet(a, state, b):
        names, code = np.unique(b.units(), return_inverse=True)
        order = np.argsort(code, kind="stable")
        b.x, b.ids, b.minus = b.x[order], b.ids[order], b.minus[order]
        most = np.maximum.reduceat(_scores(a, b, 1.0), np.searchsorted(code[order], np.arange(len(names))), axis=1)
        for i, name in enumerate(names):
            state[name] = np.maximum(state[name], most[:, i]) if name in state else most[:, i].copy()

    def end(a, state):
        own = a.units()
        parts = []
        for name, m in state.items():
            there = (own != name) & (m > -np.inf)
            parts.append((a.ids[there], own[there], np.full(there.sum(), name, dtype=object), m[there]))
        src, unit, other, m = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(unit, pa.string()), pa.array(other, pa.string()), pa.array(m, pa.float64())], schema=UNITS)

    return lambda batches: _met(batches, width, cosine, start, meet, end)


def _beside(sources: DataFrame, targets: DataFrame) -> tuple[DataFrame, int]:
    """Every block of sources beside every block of targets, and the vectors' length; only the blocks of sources move, once, to as many tasks as there are partitions."""
    a = packed(sources)
    b = a if sources is targets else packed(targets)
    some = sources.select(F.size("v").alias("n")).limit(1).collect()  # one row
    parts = max(1, min(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), a.count()))
    size = b.agg(F.sum(F.length("values"))).first()[0] or 0
    left = a.toDF(*(f"a_{c}" for c in COLUMNS)).repartition(parts, "a_block")
    right = b.toDF(*(f"b_{c}" for c in COLUMNS)).drop("b_block").coalesce(1 + size // HELD)
    return left.crossJoin(right.hint("shuffle_replicate_nl")), some[0]["n"] if some else 1


def best_k(sources: DataFrame, targets: DataFrame, k: int, *, scale: float = 1.0, cosine: bool = True) -> DataFrame:
    """src, tgt, score, rank. Both sides have id, v (array of doubles) and minus; a target with the source's id is left out."""
    pairs, width = _beside(sources, targets)
    found = pairs.mapInArrow(_best(k, scale, cosine, width), "src long, best array<struct<less: double, tgt: long>>")
    whole = found.groupBy("src").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    rows = whole.select("src", F.posexplode("best").alias("at", "x"))
    return rows.select("src", F.col("x.tgt").alias("tgt"), (0.0 - F.col("x.less")).alias("score"), (F.col("at") + 1).cast("long").alias("rank"))


def best_in_units(rows: DataFrame) -> DataFrame:
    """src, unit, other, m: the greatest cosine of each vector (id, v, minus, unit) to those of every other unit; vectors without a unit take no part."""
    rows, kind = rows.where("unit is not null"), rows.schema["unit"].dataType
    pairs, width = _beside(rows, rows)
    found = pairs.mapInArrow(_best_in_units(True, width), "src long, unit string, other string, m double")
    return found.groupBy("unit", "other", "src").agg(F.max("m").alias("m")).select("src", F.col("unit").cast(kind).alias("unit"), F.col("other").cast(kind).alias("other"), "m")


def vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.lit(0.0).alias("minus"))


def unit_vectors(rows: DataFrame, key: str, vector: str, unit: str) -> DataFrame:
    """``vectors`` with the unit of each."""
    there = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    return there.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.lit(0.0).alias("minus"), F.col(unit).alias("unit"))


def hubness(v: DataFrame, neighbours: int = 10) -> DataFrame:
    """id, r: the mean cosine of each vector's nearest others."""
    return best_k(v, v, neighbours).groupBy(F.col("src").alias("id")).agg(F.avg("score").alias("r"))


def csls_topk(v: DataFrame, k: int, neighbours: int = 10, near: DataFrame | None = None) -> DataFrame:
    """Best k by 2 cos(x, y) - r(x) - r(y); r comes from ``near`` if that list of cosines is there already."""
    r = hubness(v, neighbours) if near is None else near.where(F.col("rank") <= neighbours).groupBy(F.col("src").alias("id")).agg(F.avg("score").alias("r"))
    with_r = v.drop("minus").join(r.withColumnRenamed("r", "minus"), "id")
    return best_k(with_r, with_r, k, scale=2.0)


def mean_vectors(members: DataFrame, unit: str) -> DataFrame:
    """unit, v: the mean of the members' vectors, of length 1."""
    each = members.select(unit, F.posexplode("v").alias("dim", "x")).groupBy(unit, "dim").agg(F.avg("x").alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(unit)))
    each = each.withColumn("x", F.col("x") / norm)
    return each.groupBy(unit).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("v"))


def best_match_average(pairs: DataFrame) -> DataFrame:
    """From a_unit, a, b_unit, b, score: half of the mean over a of its best b, and the other way round."""
    ab = pairs.groupBy("a_unit", "b_unit", "a").agg(F.max("score").alias("m")).groupBy("a_unit", "b_unit").agg(F.avg("m").alias("x"))
    ba = pairs.groupBy("a_unit", "b_unit", "b").agg(F.max("score").alias("m")).groupBy("a_unit", "b_unit").agg(F.avg("m").alias("y"))
    return ab.join(ba, ["a_unit", "b_unit"]).select("a_unit", "b_unit", ((F.col("x") + F.col("y")) / 2).alias("score"))
