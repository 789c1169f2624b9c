"""Mixing of sources to target weights.

Sources in order of their code points, null last, weigh 5, 2, 1, 5, 2, 1 and so on and share the words of the
whole corpus; a source's target stops at ``most_repeats`` times its words and the excess goes to the others by
weight, which comes to ``min(most_repeats * words, level * weight)`` with one level for all.

The documents of a source fall by a hash into blocks, of which each has as many parts. A target is met by whole rounds over all
blocks of its source and by a rest, for which further blocks are taken whole, in permuted order, those that fit, and
the last ones so that they come nearest. What is still lacking comes from one more block: by the same rule from
its parts, and from one more part's documents, where the last choice may also go beyond. So a source of few documents comes
as near to its target as their sizes let it, and one of many misses it by less than a document out of a part that has a
millionth of them; only documents that are as large as all others of their block together may make it miss by more.

The blocks that a source has to give, all rounds together, are an exact quota. A splitting
tree parts the quotas of all sources between the output shards: at every node, one half of the shards gets a
multivariate hypergeometric draw, so each shard's mixture is that of a draw without replacement from the whole.
The tree first goes over groups of ``SOURCES_AT_ONCE`` sources, on the driver (a number a group and shard), then within
each group, in a task a group. Each shard takes its quota from the source's blocks in permuted order, so no block of
a round is in two shards, and orders its own documents by a hash. There is a shard for every ``SHARD_WORDS`` words of the
mixture, and as many as the session has shuffle partitions at least; a task writes a shard.

Words are counted once, into a table without texts that everything else reads.

Defined cases: null and empty texts have size 0 and are never taken; a source without words has target 0;
null is a source of its own; rows that are equal in id, source and text are taken together; further columns are kept by
``mix``, whatever their names; an empty table gives no rows.
Everything follows from hashes and a fixed seed, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm._common import shuffle_partitions, table, to_batch, written

#: Weights of the sources in their order, repeating; what is a word.
WEIGHTS = (5.0, 2.0, 1.0)
WORD = r"[^\x20\x09-\x0D]+"
MOST_REPEATS, BLOCKS, SEED = 3, 1024, 20_011
SHARD_WORDS, SOURCES_AT_ONCE = 1 << 24, 1024
#: The last choice among blocks is exact for so many of them and to one part in 2**FINE of what is lacking.
LAST, FINE = 96, 20
#: numpy draws from fewer elements than this.
DRAWABLE = 10**9


def source_targets(by_source: DataFrame, weights=WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """From source, words: the order, weight and target of each source. One row a source goes through one task."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.row_number().over(in_order) - 1
    ranked = by_source.withColumn("at", at).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights)) + 1))
    ranked = ranked.withColumn("cap", F.col("words") * F.lit(float(most_repeats)))
    # by rising level cap / weight: with the sources before it at their caps, which level is left for the others
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "at")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("words").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    # the first source that its level leaves below its cap has the level of all that are not at their caps
    ratio = F.col("cap") / F.col("weight")
    first = F.min(F.when(F.col("level") <= ratio, F.struct(ratio, "at", "level"))).over(everything)
    ranked = ranked.withColumn("level", level).withColumn("level", first["level"])
    return ranked.select("source", "at", "words", F.least("cap", F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


# --- which blocks, parts and documents a rest takes ---


def nearest_sum(sizes: np.ndarray, room: int, beyond: bool) -> np.ndarray:
    """Which of a few sizes add up to most without passing ``room``, or, with ``beyond``, to what is nearest to it."""
    unit = max(1, room >> FINE)
    small = [-(-int(x) // unit) for x in sizes]  # rounded up, so that what fits here fits
    limit = room // unit + (max(small, default=0) if beyond else 0)
    reach, steps = 1, []
    for x in small:
        steps.append(reach)
        reach |= reach << x & (1 << limit + 1) - 1
    goal = room // unit
    under = (reach & (1 << goal + 1) - 1).bit_length() - 1
    over = reach >> goal
    sums = under if not beyond or not over or goal - under <= (over & -over).bit_length() - 1 else goal + (over & -over).bit_length() - 1
    taken = np.zeros(len(small), bool)
    for i in range(len(small) - 1, -1, -1):
        if not steps[i] >> sums & 1:  # not without this one
            taken[i] = True
            sums -= small[i]
    return taken


def fill(sizes: np.ndarray, room: int, order: np.ndarray, beyond: bool = False) -> np.ndarray:
    """Which sizes are taken for ``room``: in ``order`` whatever fits, of which the last and the largest are chosen again, with the smallest that are left, for the nearest sum."""
    taken = np.zeros(len(sizes), bool)
    if room <= 0:
        return taken
    fitted = []
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        if size <= room:
            fitted.append(i)
            room -= size
    few = LAST // 3
    largest = np.array(fitted[:-few], "i8")
    again = fitted[-few:] + largest[np.argsort(-sizes[largest], kind="stable")[:few]].tolist()
    taken[fitted] = True
    left = np.flatnonzero(~taken)
    few = np.array([*again, *left[np.argsort(sizes[left], kind="stable")[:few]].tolist()], "i8")
    if len(few):
        taken[again] = False
        taken[few[nearest_sum(sizes[few], room + int(sizes[again].sum()), beyond)]] = True
    return taken


CHOICE = pa.schema([("at", pa.int64()), ("names", pa.list_(pa.int64())), ("border", pa.int64()), ("lacking", pa.int64())])
CHOICE_DDL = "at long, names array<long>, border long, lacking long"


def _choose(beyond: bool):
    """From at, room, parts (name, words, documents, words of the largest one): the parts that are taken whole, the one to look into (null if there is no need), what is lacking then."""

    def run(batches):
        for batch in batches:
            out = {f.name: [] for f in CHOICE}
            for at, room, parts in zip(*(batch.column(c).to_pylist() for c in ("at", "room", "parts")), strict=True):
                parts = sorted((p["name"], p["words"], p["docs"], p["largest"]) for p in parts)
                names, sizes, docs, largest = (np.array(x, "i8") for x in zip(*parts, strict=True))
                order = np.random.Generator(np.random.PCG64([SEED, at])).permutation(len(parts))
                taken = fill(sizes, room, order, beyond or docs.max() == 1 and len(parts) <= LAST)  # of so few documents the choice is exact
                lacking = room - int(sizes[taken].sum())
                rest = np.flatnonzero(~taken)
                # each of these has more than what is lacking; small documents come nearest to it
                border = int(names[rest[np.argmin(largest[rest])]]) if lacking > 0 and len(rest) and not beyond else None
                for column, v in zip(out.values(), (at, names[taken].tolist(), border, lacking), strict=True):
                    column.append(v)
            yield to_batch(out, CHOICE)

    return run


def _chosen_parts(rows: DataFrame, name: str, beyond: bool = False) -> DataFrame:
    """``_choose`` of rows (at, room, words, docs, largest, and the part's name): a source's parts are few, by how they were made."""
    parts = rows.groupBy("at", "room", F.col(name).cast("long").alias("name")).agg(F.sum("words").alias("words"), F.sum("docs").alias("docs"), F.max("largest").alias("largest"))
    return parts.groupBy("at", "room").agg(F.collect_list(F.struct("name", "words", "docs", "largest")).alias("parts")).mapInArrow(_choose(beyond), CHOICE_DDL)


# --- which shard gets which block ---


def _drawn(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """How many of each colour are among ``n`` drawn without replacement: colour by colour, each against all later ones."""
    out, later = np.zeros_like(left), int(left.sum())
    for i in np.flatnonzero(left):
        if not n:
            break
        here = int(left[i])
        later -= here
        if here + later < DRAWABLE:
            k = int(rng.hypergeometric(here, later, n))
        else:  # too many for numpy: the normal form, kept within what there is
            share = here / (here + later)
            spread = np.sqrt(n * share * (1 - share) * (1 - n / (here + later)))
            k = min(max(round(n * share + spread * rng.standard_normal()), n - later, 0), here, n)
        out[i] = k
        n -= k
    return out


def splitting_tree(quotas: np.ndarray, totals: np.ndarray, seed: list[int]) -> np.ndarray:
    """Exact quotas of colours parted between shards whose ``totals`` are given: a line a colour, a column a shard."""
    out = np.zeros((len(quotas), len(totals)), "i8")
    nodes = [(np.asarray(quotas, "i8"), 0, len(totals))]
    while nodes:
        left, first, n = nodes.pop()
        if n == 1 or not left.any():
            out[:, first] = left
            continue
        half = n // 2
        rng = np.random.Generator(np.random.PCG64(np.random.SeedSequence([*seed, first, n])))
        drawn = _drawn(rng, left, int(totals[first : first + half].sum()))
        nodes += [(drawn, first, half), (left - drawn, first + half, n - half)]
    return out


def even(total: int, shards: int) -> np.ndarray:
    edges = np.arange(shards + 1, dtype=object) * total // shards
    return np.diff(edges).astype("i8")


SPLIT = pa.schema([("at", pa.int64()), ("per_shard", pa.list_(pa.int64()))])
DRAWN = pa.schema([("at", pa.int64()), ("block", pa.int64()), ("drawn", pa.list_(pa.struct([("round", pa.int32()), ("shard", pa.int32())])))])
DRAWN_DDL = "at long, block long, drawn array<struct<round:int,shard:int>>"


def _split(batches):
    """The quotas of a group's sources parted between shards whose shares of the group are known."""
    for batch in batches:
        out = {"at": [], "per_shard": []}
        for group, sources, totals in zip(*(batch.column(c).to_pylist() for c in ("group", "sources", "totals")), strict=True):
            sources = sorted((s["at"], s["n"]) for s in sources)
            parted = splitting_tree(np.array([n for _, n in sources], "i8"), np.array(totals, "i8"), [SEED + 1, group])
            out["at"] += [at for at, _ in sources]
            out["per_shard"] += parted.tolist()
        yield to_batch(out, SPLIT)


def _deal(batches):
    """A source's blocks, each as often as it is drawn, in permuted order to the shards as their quotas say."""
    for batch in batches:
        out = {f.name: [] for f in DRAWN}
        for at, rounds, every, extra, per_shard in zip(*(batch.column(c).to_pylist() for c in ("at", "rounds", "every", "extra", "per_shard")), strict=True):
            drawn: dict[int, list] = {b: [] for b in sorted(every)}
            units = [(b, r) for r in range(1, rounds + 1) for b in drawn] + [(b, rounds + 1) for b in sorted(extra)]
            shard = np.repeat(np.arange(len(per_shard)), per_shard)
            order = np.random.Generator(np.random.PCG64([SEED + 2, at])).permutation(len(units))
            for i, s in zip(order.tolist(), shard.tolist(), strict=True):
                drawn[units[i][0]].append({"round": units[i][1], "shard": s})
            for block, its in drawn.items():
                if its:
                    for column, v in zip(out.values(), (at, block, sorted(its, key=lambda d: d["round"])), strict=True):
                        column.append(v)
        yield to_batch(out, DRAWN)


# --- the plan ---


def _key(seed: int):
    return F.xxhash64(F.col("doc_id"), F.col("source"), F.col("text"), F.lit(seed))


def _block(key, blocks: int):
    return F.pmod(key, F.lit(blocks))


def _part(key, blocks: int):
    return F.pmod(F.shiftright(key, 20), F.lit(blocks))


def sized(docs: DataFrame, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, key (the permuted order), block and part of every document, as a table without texts."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), _key(seed).alias("key"))
    return written(rows, "sizes").withColumn("block", _block(F.col("key"), blocks)).withColumn("part", _part(F.col("key"), blocks))


def decisions(rows: DataFrame, *, shards: int | None = None, blocks: int = BLOCKS) -> tuple[DataFrame, int]:
    """What is taken of ``sized`` rows, by source and block, and the number of shards.

    source, block, source_size, target, drawn: (round, shard) of each time that the block is drawn. At a source's border
    block also ``last``, the round of which only the parts in ``parts`` and the documents with a key in ``keys`` are taken.
    """
    spark = rows.sparkSession
    by_block = written(rows.groupBy("source", "block").agg(F.sum("size").alias("words"), F.count_if(F.col("size") > 0).alias("docs"), F.max("size").alias("largest")), "blocks")
    sources = source_targets(by_block.groupBy("source").agg(F.sum("words").alias("words")))
    rounds = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0).cast("int")
    sources = sources.withColumn("rounds", rounds).withColumn("room", F.round(F.col("target") - F.col("rounds") * F.col("words")).cast("long"))
    sources = written(sources.withColumnRenamed("words", "source_size").withColumn("at", F.col("at").cast("long")), "sources")
    both = by_block.join(sources, by_block["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    full = both.where("words > 0")

    # the rest: whole blocks, whole parts of one more, documents of one more part
    choice = written(_chosen_parts(full, "block"), "chosen-blocks")
    looked_into = lambda c: c.where("border is not null").select("at", F.col("border").alias("b_border"), F.col("lacking").alias("room"))
    of_source = sources.select("at", F.col("source").alias("s_source"))
    inside = looked_into(choice).join(of_source, "at")
    sizes = rows.where("size > 0").select("source", "block", "part", "key", F.col("size").alias("words"))
    at_border = sizes.join(inside, sizes["source"].eqNullSafe(inside["s_source"]) & (sizes["block"] == inside["b_border"])).select("at", "room", "part", "key", "words")
    at_border = written(at_border.groupBy("at", "room", "part", "key").agg(F.sum("words").alias("words")).withColumn("docs", F.lit(1).cast("long")).withColumn("largest", F.col("words")), "border-blocks")
    parts = written(_chosen_parts(at_border, "part"), "chosen-parts")
    inside = looked_into(parts)
    documents = at_border.drop("room").join(inside.withColumnRenamed("b_border", "part"), ["at", "part"])
    keys = written(_chosen_parts(documents, "key", beyond=True), "chosen-documents")
    border = choice.where("border is not null").select("at", F.col("border").alias("block")).join(parts.select("at", F.col("names").alias("parts")), "at", "left").join(keys.select("at", F.col("names").alias("keys")), "at", "left")

    # quotas: every block once a round, and once more if it is taken for the rest, in part or whole
    every = full.groupBy("at", "rounds", "room").agg(F.collect_list("block").alias("every"))  # as many as there are blocks
    extra = F.concat("names", F.when(F.col("border").isNotNull(), F.array("border")).otherwise(F.array().cast("array<bigint>")))
    units = every.join(choice.select("at", extra.alias("extra")), "at").withColumn("n", (F.col("rounds") * F.size("every") + F.size("extra")).cast("long"))
    units = written(units, "quotas")
    groups = units.groupBy(F.floor(F.col("at") / SOURCES_AT_ONCE).cast("long").alias("group")).agg(F.collect_list(F.struct("at", "n")).alias("sources"), F.sum("n").alias("n"))
    if shards is None:
        words = sources.agg(F.sum("target")).first()[0] or 0
        shards = max(shuffle_partitions(spark), -(-int(words) // SHARD_WORDS))
    per_group = [(r["group"], r["n"]) for r in groups.select("group", "n").orderBy("group").collect()]  # one for SOURCES_AT_ONCE sources
    quotas = np.array([n for _, n in per_group], "i8")
    parted = splitting_tree(quotas, even(int(quotas.sum()), shards), [SEED]) if per_group else []
    # an Arrow table and not rows, which executors would read by Python workers of another kind
    totals = spark.createDataFrame(pa.table({"group": pa.array([g for g, _ in per_group], pa.int64()), "totals": pa.array([t.tolist() for t in parted], pa.list_(pa.int64()))}))
    per_source = groups.drop("n").join(totals, "group").select("group", "sources", "totals").mapInArrow(_split, "at long, per_shard array<long>")
    per_source = written(per_source, "quotas-by-shard")  # so that no task runs two Python workers, which an executor would keep
    drawn = units.join(per_source, "at").select("at", "rounds", "every", "extra", "per_shard").mapInArrow(_deal, DRAWN_DDL)
    out = both.join(drawn, ["at", "block"], "left").join(border, ["at", "block"], "left")
    last = F.when(F.col("parts").isNotNull(), F.col("rounds") + 1)
    return written(out.select("source", "block", "source_size", "target", F.coalesce("drawn", F.array().cast("array<struct<round:int,shard:int>>")).alias("drawn"), last.alias("last"), "parts", F.coalesce("keys", F.array().cast("array<bigint>")).alias("keys")), "decisions"), shards


def taken(rows: DataFrame, by_block: DataFrame) -> DataFrame:
    """Rows (source, block, part, key, and more) with source_size, target and drawn: the (round, shard) in which each document is taken."""
    names = ("source_size", "target", "drawn", "last", "parts", "keys")
    by_block = by_block.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), *names)
    joined = rows.join(by_block, rows["source"].eqNullSafe(by_block["b_source"]) & (rows["block"] == by_block["b_block"])).drop("b_source", "b_block")
    out = F.col("last").isNotNull() & ~F.array_contains("parts", F.col("part")) & ~F.array_contains("keys", F.col("key"))
    return joined.withColumn("drawn", F.when(out, F.filter("drawn", lambda d: d["round"] != F.col("last"))).otherwise(F.col("drawn"))).drop("last", "parts", "keys")


def mix(docs: DataFrame, *, shards: int | None = None, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """The mixture: the columns of ``docs``, with a row for each time that a document is taken, shuffled within its shard."""
    by_block, shards = decisions(sized(docs, blocks, seed), shards=shards, blocks=blocks)
    packed = docs.where(F.col("text").rlike(WORD)).select("source", _key(seed).alias("key"), F.struct("*").alias("row"))  # further columns may have any names
    packed = packed.withColumn("block", _block(F.col("key"), blocks)).withColumn("part", _part(F.col("key"), blocks))
    rows = taken(packed, by_block).select("key", "row", F.explode("drawn").alias("draw"))
    rows = rows.select(F.col("draw.shard").alias("shard"), F.xxhash64("key", "draw.round", F.lit(seed + 2)).alias("order"), "row")
    return rows.repartitionById(shards, "shard").sortWithinPartitions("order", "row.doc_id").select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sized(table(spark, sf_dir, "documents"))
    rows = taken(rows, decisions(rows)[0])
    times = F.when(F.col("size") > 0, F.col("size") * F.size("drawn")).otherwise(F.lit(0)).cast("long")
    return rows.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), times.alias("taken"), "source", F.col("drawn.shard").alias("shards"))
