"""N-gram Jaccard join by chosen paths.

Texts are sets of runs of five words; two are linked at a Jaccard similarity of 0.8 or more. Texts with equal sets
are one set with a weight. A set takes each of its tokens as a branch with probability 1 / (0.8 * its size), by a
hash that all sets share, so similar sets tend to take the same branches. That is done for ``runs`` runs. A
branch that one set alone took ends there; one with at most ``SMALL`` sets is a bucket; a larger one is split
again, on tokens sampled anew below it, ``DEPTH`` levels down at most, and is a bucket there whatever its size. A set of
fewer tokens than branches are asked for takes each token once, and goes down each of those below a large branch as
often (``REPEATS``) as the shared tokens that it is sure to have ask for. The number of runs is such that a pair at the very threshold, split as often as may be, is missed with a
probability of at most 1 - ``RECALL``; pairs of higher similarity or fewer splits are missed far less often.

A bucket is brute-forced in blocks of ``BLOCK`` sets: a pair counts in the least of the buckets that it shares
(found by a product of incidence matrices), so that nothing has to be made distinct later and no pair is ever
written. Packed 1-bit sketches tell which sets may have a partner there at all; only those sets are fetched, and
their exact intersections decide. The sketches' margin follows the size of the sets: of 3,200,000 made-up
pairs at the threshold of 128 to 300 tokens they lost 1, which the paths' own loss (0.000087 at most) leaves room for. Of links a task returns each set's weighted number and a spanning forest;
components of the forests give the classes.

Defined cases: texts of one to four words have one run, of all their words; null texts, empty texts and texts without
words have no links and are classes of their own; equal rows are documents of their own, linked to
each other; null ids are as any other, and least; an empty table gives no rows; further columns are ignored by
``links`` and kept by ``one_of_each``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm._common import bucketed, short_batches, shuffle_partitions, table, to_batch, written
from tessella.llm.words import mixed, shingle_hashes

SIMILARITY, RECALL, SMALL, DEPTH, BLOCK, SKETCH_BINS, SKETCH_MARGIN, SKETCH_LEAST, SKETCH_ERRORS = 0.8, 0.9999, 2048, 4, 512, 512, 0.2, 128, 5.5
NULL_FIRST = -(2**63)
ALL = 2.0**64


def survival(depth: int) -> float:
    """The probability that two sets at the threshold still share a branch ``depth`` levels down: of a branching process with one heir on average."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-alive)
    return alive


RUNS = math.ceil(math.log(1 - RECALL) / math.log(1 - survival(DEPTH)))


def _repeats() -> list[int]:
    """For each size of a set up to that from which tokens are sampled: how often it goes down each branch of a split bucket.

    A token is the branch of one run only, so a short set has fewer branches than runs: a pair whose larger set has
    ``size`` tokens may share no more than ``shared``. Never rises with the size, so that a pair shares the repeats of its larger set.
    """
    out = [1]
    for size in range(math.ceil(RUNS / SIMILARITY), 0, -1):
        shared = (4 * size + 4) // 5  # in whole numbers, as 0.8 is
        alive, taken = 1.0, min(1.0, 1 / (SIMILARITY * size))
        for _ in range(DEPTH - 1):
            alive = 1 - (1 - taken * alive) ** shared
        needed = 1 if alive == 1 else math.ceil(math.log(1 - RECALL) / (shared * math.log(1 - alive)))
        out.append(max(out[-1], needed))
    return out[::-1]


REPEATS = _repeats()


def tokens_of(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(text))


def first_branches(tokens: np.ndarray, runs: int = RUNS) -> np.ndarray:
    """Those of all runs: a token belongs to the run in whose slice of the hash range it lies, so each serves once."""
    place = mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)).astype("f8") / ALL * runs
    return tokens[place - np.floor(place) < runs / (SIMILARITY * max(1, len(tokens)))]


def deeper(tokens: np.ndarray, branch: int, depth: int) -> np.ndarray:
    """The ends of the paths below a branch, of all its repeats."""
    ends = np.array([branch], "u8")
    if len(tokens) < len(REPEATS):
        # the first goes down from the branch itself, as that of long sets
        ends = np.concatenate([ends, mixed(ends + np.arange(1, REPEATS[max(0, len(tokens) - 1)], dtype="u8") * np.uint64(0xD6E8FEB86659FD93))])
    least = 1 / (SIMILARITY * len(tokens))
    for level in range(1, depth):
        if not len(ends):
            break
        found = [mixed(tokens[mixed(tokens ^ e ^ np.uint64(level)).astype("f8") / ALL < least] * np.uint64(0x9E3779B97F4A7C15) + e) for e in ends]
        ends = np.concatenate(found)
    return ends


def sketch(tokens: np.ndarray) -> bytes:
    """A bit for each bin of one permutation; an empty bin takes over from the next one that is not."""
    spread = np.sort(mixed(tokens + np.uint64(0x632BE59BD9B4E019)))
    edges = np.arange(SKETCH_BINS, dtype="u8") << np.uint64(64 - (SKETCH_BINS - 1).bit_length())
    return np.packbits((spread[np.searchsorted(spread, edges) % len(spread)] & np.uint64(1)).astype("u1")).tobytes()


def sketch_needs(sizes: np.ndarray) -> np.ndarray:
    """The least estimate at which a set of so many tokens may have a partner; that of a pair is the lesser of its two sets'.

    Bins without a token are copies, in runs, so that the estimate is as noisy as one of bins * full / (2 - full) bins, where
    ``full`` is the share of bins with a token: the margin is ``SKETCH_ERRORS`` standard errors of that many, ``SKETCH_MARGIN`` at least.
    """
    full = 1 - (1 - 1 / SKETCH_BINS) ** sizes.astype("f8")
    error = np.sqrt(1 - SIMILARITY**2) / np.sqrt(SKETCH_BINS * full / (2 - full))
    return np.where(sizes < SKETCH_LEAST, -1.0, SIMILARITY - np.maximum(SKETCH_MARGIN, SKETCH_ERRORS * error))


# --- rows between tasks: segments of arrays, packed by slot ---

SETS = pa.schema([("key", pa.binary()), ("ord", pa.int64()), ("m", pa.int64()), ("set_key", pa.binary()), ("branches", pa.binary()), ("salts", pa.list_(pa.int32()))])
SETS_DDL = "key binary, ord long, m long, set_key binary, branches binary, salts array<int>"
DEALT = pa.schema([("slot", pa.int32()), *((n, pa.binary()) for n in ("path", "of", "ids", "weights", "sizes", "sketches", "n_paths", "paths", "tokens"))])
DEALT_DDL = "slot int, path binary, of binary, ids binary, weights binary, sizes binary, sketches binary, n_paths binary, paths binary, tokens binary"
ANSWER = pa.schema([("id", pa.int64()), ("small", pa.binary()), ("large", pa.binary())])
OWNED = pa.schema([("id", pa.int64()), ("owned", pa.binary()), ("paths", pa.binary())])
LINKED = pa.schema([("id", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def _sets(batches):
    for batch in batches:
        keys, ords, ms, texts = (batch.column(n).to_pylist() for n in ("key", "ord", "m", "text"))
        out = {f.name: [] for f in SETS if f.name != "salts"}
        for key, o, m, text in zip(keys, ords, ms, texts, strict=True):
            tokens = tokens_of(text)
            branches = first_branches(tokens) if len(tokens) else tokens
            set_key = xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None
            for column, v in zip(out.values(), (key, o, m, set_key, branches.tobytes()), strict=True):
                column.append(v)
        yield to_batch(out | {"salts": batch.column("salts")}, SETS)


def _deal(slots: int, ends: list[np.ndarray], ids: list[int], **each: list[bytes]):
    """Packed rows, one a slot: which set (``of``) took which path, and the sets' own columns."""
    path = np.concatenate(ends) if len(ends) else np.zeros(0, "u8")
    of = np.repeat(np.arange(len(ends)), [len(e) for e in ends])
    slot = (path >> np.uint64(7)) % np.uint64(slots)
    order = np.argsort(slot, kind="stable")
    cuts = np.searchsorted(slot[order], np.arange(slots + 1, dtype="u8"))
    out = {f.name: [] for f in DEALT}
    for s in range(slots):
        mine = order[cuts[s] : cuts[s + 1]]
        if len(mine):
            sets, its = np.unique(of[mine], return_inverse=True)
            row = {"slot": s, "path": path[mine].tobytes(), "of": its.astype("u4").tobytes(), "ids": np.array(ids, "i8")[sets].tobytes()}
            row |= {n: b"".join(v[i] for i in sets.tolist()) for n, v in each.items()}
            for n, column in out.items():
                column.append(row.get(n))
    return to_batch(out, DEALT)


def _first_deal(slots: int):
    def run(batches):
        for batch in batches:
            yield _deal(slots, [np.frombuffer(b, "u8") for b in batch.column("branches").to_pylist()], batch.column("id").to_pylist())

    return run


def _gather(batches) -> dict[str, np.ndarray] | None:
    """A task's packed rows as one: path and of (a set's number), and the sets' columns, each set once."""
    kinds = {"path": "u8", "of": "u4", "ids": "i8", "weights": "i8", "sizes": "u4", "n_paths": "u4", "paths": "u8", "tokens": "u8"}
    parts: dict[str, list] = {n: [] for n in (*kinds, "sketches")}
    sets = 0
    for batch in batches:
        for i in range(batch.num_rows):
            for n in parts:
                value = batch.column(n)[i].as_py()
                if value is None:
                    continue
                if n == "sketches":
                    parts[n].append(np.frombuffer(value, "u8").reshape(-1, SKETCH_BINS // 64))
                else:
                    values = np.frombuffer(value, kinds[n])
                    parts[n].append(values.astype("i8") + sets if n == "of" else values)
            sets += len(parts["ids"][-1])
    return {n: np.concatenate(v) for n, v in parts.items() if v} if sets else None


def _buckets(its: dict[str, np.ndarray]):
    """(path, its sets' numbers) with two sets or more."""
    order = np.lexsort((its["ids"][its["of"]], its["path"]))
    path, of = its["path"][order], its["of"][order]
    cuts = np.flatnonzero(np.r_[True, path[1:] != path[:-1], True])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a > 1:
            yield path[a], of[a:b]


def _count(batches):
    its = _gather(batches)
    if its is None:
        return
    order = np.argsort(its["path"], kind="stable")
    path, of = its["path"][order], its["of"][order]
    new = np.r_[True, path[1:] != path[:-1]]
    size = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
    shared = size > 1
    ids, path, large = its["ids"][of[shared]], path[shared], size[shared] > SMALL
    order = np.lexsort((path, ids))
    ids, path, large = ids[order], path[order], large[order]
    cuts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1], True]) if len(ids) else np.zeros(1, "i8")
    for at in range(0, len(cuts) - 1, 4096):
        pairs = list(zip(*(c.tolist() for c in (cuts[at : at + 4096], cuts[at + 1 : at + 4097])), strict=False))
        yield to_batch({"id": [int(ids[a]) for a, _ in pairs], "small": [path[a:b][~large[a:b]].tobytes() for a, b in pairs], "large": [path[a:b][large[a:b]].tobytes() for a, b in pairs]}, ANSWER)


def _second_deal(slots: int):
    """The final paths of each set, with its sketch."""

    def run(batches):
        for batch in batches:
            ids, weights, paths, sizes, sketches = batch.column("id").to_pylist(), batch.column("weight").to_pylist(), [], [], []
            for text, small, large in zip(*(batch.column(n).to_pylist() for n in ("text", "small", "large")), strict=True):
                tokens = tokens_of(text)
                found = [np.frombuffer(b"".join(small), "u8"), *(deeper(tokens, b, DEPTH) for b in np.frombuffer(b"".join(large), "u8"))]
                paths.append(np.unique(np.concatenate(found)))
                sizes.append(len(tokens))
                sketches.append(sketch(tokens))
            yield _deal(slots, paths, ids, weights=[np.int64(w).tobytes() for w in weights], sizes=[np.uint32(n).tobytes() for n in sizes], sketches=sketches, n_paths=[np.uint32(len(p)).tobytes() for p in paths], paths=[p.tobytes() for p in paths])

    return run


def _incidence(values: list[np.ndarray], more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Products of rows of ``values`` with rows of ``more``: how many elements they share."""
    a, b = np.concatenate(values), np.concatenate(more)
    row_a = np.repeat(np.arange(len(values)), [len(v) for v in values])
    row_b = np.repeat(np.arange(len(more)), [len(v) for v in more])
    common = np.intersect1d(a, b)
    out = np.zeros((len(values), len(more)), "f4")
    for at in range(0, len(common), 4096):
        part = common[at : at + 4096]
        matrices = []
        for v, rows, n in ((a, row_a, len(values)), (b, row_b, len(more))):
            where = np.searchsorted(part, v)
            where[where == len(part)] = 0
            hit = part[where] == v
            m = np.zeros((n, len(part)), "f4")
            m[rows[hit], where[hit]] = 1
            matrices.append(m)
        out += matrices[0] @ matrices[1].T
    return out


def _block_pairs(sets: np.ndarray):
    blocks = [sets[i : i + BLOCK] for i in range(0, len(sets), BLOCK)]
    for i, a in enumerate(blocks):
        for j in range(i, len(blocks)):
            yield i == j, a, blocks[j]


def _owned_here(paths: list[np.ndarray], a: np.ndarray, b: np.ndarray, path, same: bool) -> np.ndarray:
    """Pairs whose least common path is this one, each once."""
    lower = [[p[: np.searchsorted(p, path)] for p in (paths[i] for i in x)] for x in (a, b)]
    out = _incidence(*lower) == 0
    return np.triu(out, 1) if same else out


def _own(batches):
    """For each set the paths where it has a likely partner that no lesser path has."""
    its = _gather(batches)
    if its is None:
        return
    paths = np.split(its["paths"], np.cumsum(its["n_paths"])[:-1])
    sizes, sketches, needs = its["sizes"].astype("f4"), its["sketches"], sketch_needs(its["sizes"])
    found: dict[int, list[int]] = {}
    for path, sets in _buckets(its):
        hit = np.zeros(len(its["ids"]), bool)
        for same, a, b in _block_pairs(sets):
            likely = np.minimum(sizes[a][:, None], sizes[b]) >= SIMILARITY * np.maximum(sizes[a][:, None], sizes[b])
            unlike = np.zeros(likely.shape, "u2")
            for w in range(sketches.shape[1]):
                unlike += np.bitwise_count(sketches[a, w][:, None] ^ sketches[b, w])
            likely &= 1 - 2 * unlike / SKETCH_BINS >= np.minimum(needs[a][:, None], needs[b])
            if likely.any():
                likely &= _owned_here(paths, a, b, path, same)
                hit[a[likely.any(axis=1)]] = True
                hit[b[likely.any(axis=0)]] = True
        for i in np.flatnonzero(hit).tolist():
            found.setdefault(i, []).append(int(path))
    yield to_batch({"id": [int(its["ids"][i]) for i in found], "owned": [np.array(v, "u8").tobytes() for v in found.values()], "paths": [paths[i].tobytes() for i in found]}, OWNED)


def _third_deal(slots: int):
    """The sets themselves, to the paths where they have partners."""

    def run(batches):
        for batch in batches:
            texts, owned, paths = (batch.column(n).to_pylist() for n in ("text", "owned", "paths"))
            tokens = [tokens_of(t) for t in texts]
            yield _deal(slots, [np.frombuffer(b"".join(o), "u8") for o in owned], batch.column("id").to_pylist(), weights=[np.int64(w).tobytes() for w in batch.column("weight").to_pylist()], sizes=[np.uint32(len(t)).tobytes() for t in tokens], n_paths=[np.uint32(len(p) // 8).tobytes() for p in paths], paths=paths, tokens=[t.tobytes() for t in tokens])

    return run


def _link(batches):
    its = _gather(batches)
    if its is None:
        return
    paths = np.split(its["paths"], np.cumsum(its["n_paths"])[:-1])
    tokens = np.split(its["tokens"], np.cumsum(its["sizes"].astype("i8"))[:-1])
    ids, weights, sizes = its["ids"], its["weights"].astype("f8"), its["sizes"].astype("f8")
    out: dict[str, list] = {f.name: [] for f in LINKED}
    for path, sets in _buckets(its):
        root = {int(i): int(i) for i in sets}

        def top(i: int, root=root) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        links = np.zeros(len(ids))
        for same, a, b in _block_pairs(sets):
            shared = _incidence([tokens[i] for i in a], [tokens[i] for i in b])
            # 5 * shared >= 4 * union, in whole numbers
            linked = (9 * shared >= 4 * (sizes[a][:, None] + sizes[b])) & _owned_here(paths, a, b, path, same)
            np.add.at(links, a, linked @ weights[b])
            np.add.at(links, b, weights[a] @ linked)
            left = linked.copy()
            for i in np.flatnonzero(left.any(axis=1)).tolist():
                for j in np.flatnonzero(left[i]).tolist():
                    x, y = top(int(a[i])), top(int(b[j]))
                    if x != y:
                        root[max(x, y)] = min(x, y)
        for i in sets[links[sets] > 0].tolist():
            for column, v in zip(out.values(), (int(ids[i]), int(ids[top(i)]), int(links[i])), strict=True):
                column.append(v)
    yield to_batch(out, LINKED)


def components(edges: DataFrame) -> DataFrame:
    """id and the least id of its component, of (id, root) edges: stars are made larger and smaller in turn until nothing changes."""
    now = written(edges.where("id != root").select(F.greatest("id", "root").alias("a"), F.least("id", "root").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now = written(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
        seen = state


def salt(column: str, slots: int):
    """Which of ``slots`` parts of its group a row belongs to."""
    return F.pmod(F.xxhash64(column), F.lit(slots)).cast("int")


def links(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), class_id, copy_id (least ids of the linked, and of equal sets), n_links, leader (whether the row is the one of its class to keep)."""
    spark = docs.sparkSession
    short_batches(spark)
    slots = shuffle_partitions(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("key", F.unhex(F.sha2("text", 256)))
    first = rows.groupBy("key").agg(F.min(F.coalesce("doc_id", F.lit(NULL_FIRST))).alias("ord"), F.count("*").alias("m"), F.first("text").alias("text"), F.collect_set(salt("doc_id", slots)).alias("salts"))
    texts = bucketed(first, "texts", "key")

    sets = written(texts.select("key", "ord", "m", "text", "salts").mapInArrow(_sets, SETS_DDL), "sets")
    of_set = sets.where("set_key is not null").groupBy("set_key").agg(F.min(F.struct("ord", "key", "branches")).alias("r"), F.sum("m").alias("weight"), F.collect_set(salt("key", slots)).alias("salts"))
    reps = written(of_set.select(F.monotonically_increasing_id().alias("id"), "set_key", "weight", "salts", F.col("r.key").alias("key"), F.col("r.ord").alias("ord"), F.col("r.branches").alias("branches")), "set-classes")

    dealt = reps.select("id", "branches").mapInArrow(_first_deal(slots), DEALT_DDL).repartition(slots, "slot")
    answers = dealt.mapInArrow(_count, "id long, small binary, large binary").groupBy("id").agg(F.collect_list("small").alias("small"), F.collect_list("large").alias("large"))
    named = reps.select("id", "key", "weight")
    asked = texts.select("key", "text").join(named.join(answers, "id"), "key").select("id", "weight", "text", "small", "large")
    owned = asked.mapInArrow(_second_deal(slots), DEALT_DDL).repartition(slots, "slot").mapInArrow(_own, "id long, owned binary, paths binary")
    owned = owned.groupBy("id").agg(F.collect_list("owned").alias("owned"), F.first("paths").alias("paths"))
    asked = texts.select("key", "text").join(named.join(owned, "id"), "key").select("id", "weight", "text", "owned", "paths")
    linked = written(asked.mapInArrow(_third_deal(slots), DEALT_DDL).repartition(slots, "slot").mapInArrow(_link, "id long, root long, links long"), "links")

    roots = components(linked.select("id", "root"))
    counts = linked.groupBy("id").agg(F.sum("links").alias("links"))
    per_set = reps.select("id", "set_key", "weight", "ord", "key", "salts").join(counts, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    # whatever many rows join to is repeated for each salt that they have, so that no task gets all of them
    heads = per_set.groupBy("root").agg(F.min(F.struct("ord", "key")).alias("head"), F.collect_set(salt("id", slots)).alias("s")).withColumn("salt", F.explode("s")).drop("s")
    per_set = per_set.withColumn("salt", salt("id", slots)).join(heads, ["root", "salt"]).select("set_key", F.col("ord").alias("copy_ord"), F.col("head.ord").alias("class_ord"), F.col("head.key").alias("head_key"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.explode("salts").alias("salt"))
    per_text = sets.select("key", "set_key", "salts", salt("key", slots).alias("salt")).join(per_set, ["set_key", "salt"], "left").drop("set_key", "salt").withColumn("salt", F.explode("salts")).drop("salts")

    by_row = rows.groupBy("key", "doc_id").agg(F.count("*").cast("int").alias("n")).withColumn("salt", salt("doc_id", slots))
    each = by_row.join(per_text, ["key", "salt"]).withColumn("i", F.explode(F.sequence(F.lit(1), "n")))
    own = F.coalesce("doc_id", F.lit(NULL_FIRST))
    alone = F.col("class_ord").isNull()  # no words: not linked to anything
    back = lambda c: F.when(alone, F.col("doc_id")).otherwise(F.when(F.col(c) != NULL_FIRST, F.col(c)))
    leader = alone | ((own == F.col("class_ord")) & (F.col("key") == F.col("head_key")) & (F.col("i") == 1))
    return each.select("doc_id", "key", back("class_ord").alias("class_id"), back("copy_ord").alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), leader.alias("leader"), "i")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_id", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that lead their class. Of rows with one id and one text with words, one stays."""
    leaders = links(docs).where("leader").select(F.col("doc_id").alias("l_doc"), F.col("key").alias("l_key")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # further columns may have any names
    rows = docs.select(F.col("doc_id").cast("long").alias("r_doc"), F.unhex(F.sha2(text, 256)).alias("r_key"), text.rlike(r"\S").alias("r_words"), F.struct("*").alias("row"))
    kept = rows.join(leaders, rows["r_doc"].eqNullSafe(leaders["l_doc"]) & (rows["r_key"] == leaders["l_key"]))
    each = F.row_number().over(Window.partitionBy("l_doc", "l_key").orderBy(F.lit(0)))
    return kept.withColumn("n", each).where("n = 1 or not r_words").select("row.*")
