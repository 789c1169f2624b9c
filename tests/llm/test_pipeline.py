"""The stages one after the other: on given tables, and on a small one each against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, size long, shard int, left_ string, held_ boolean, r_key string"
MARKS = ["vilex", "grubnot", "zorkel"]


def test_pipeline(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")  # a stage's own files may go with the next one
        out = spark.read.parquet(f"{tmp_path}/{name}")
        n = out.count()
        assert n > 0
        if name == "packing":
            assert out.agg({"length": "max"}).first()[0] <= 4096
        else:
            assert out.columns == columns
        if name in ("toxicity", "ngram_jaccard_join", "suffix_array_dedup"):
            assert n <= before
            assert out.select("doc_id").distinct().count() == n
        docs, before = out, n


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, None if t is None else len(t), "k", "r", 1, 2, "l", False, "x") for d, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    words = ["".join(rng.choice("bcdfglmn") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(700)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    base, passage, rows = make(150), " ".join(make(40)), []
    for i in range(120):
        t = make(rng.randint(1, 90))
        if i % 6 == 0:
            t += rng.choices(MARKS, k=4)
        elif i % 7 == 0:
            t = base[: 75 + i] + [f"end{i}"] if i % 2 else base
        elif i % 5 == 0:
            t.insert(rng.randint(0, len(t)), passage)
        rows.append((i, " ".join(t), rng.choice(["a", "a", "b", None])))
    return rows + [(200, None, "a"), (201, "", None), (202, " \n ", "b"), (3, rows[3][1], rows[3][2]), (None, "no id " + passage, "a"), (203, " ".join(f"{i}q" for i in range(9000)), "b")]


def shingles(t):
    w = (t or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def one_of_each(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(order):
        for j in order[:x]:
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b, key=order.index)] = min(a, b, key=order.index)
    return [rows[i] for i in order if top(i) == i]


def without_repeats(rows):
    seen, out = set(), []
    for d, t, s in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(b[i : i + 100])
        kept = np.frombuffer(b, "u1")[~gone].tobytes().decode("utf-8", "ignore")
        if kept or not b:
            out.append((d, kept if b else t, s))
    return out


def bag(rows):
    return Counter((r[0], r[1], r[2]) for r in rows)


def test_each_stage_by_brute_force(spark, corpus, tmp_path):
    spark.createDataFrame([(d, int(any(m in t for m in MARKS)), 1) for d, t, _ in corpus[:100]], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, corpus)
    columns = docs.columns

    def apply(place, docs):
        name, stage = corpus_pipeline.STAGES[place]
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        rows = [(r["doc_id"], r["text"], r["source"]) for r in out.collect()] if place < 4 else out.collect()
        if place < 4:
            assert out.columns == columns
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) and r["key"] == "k" and r["left_"] == "l" for r in out.collect())
        return out, rows

    docs, clean = apply(0, docs)
    assert bag(clean) == bag(r for r in corpus if not any(m in (r[1] or "") for m in MARKS))
    docs, distinct = apply(1, docs)
    assert bag(distinct) == bag(one_of_each(clean))
    docs, cut = apply(2, docs)
    assert bag(cut) == bag(without_repeats(distinct))

    docs, mixed = apply(3, docs)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    times = bag(mixed)
    assert set(times) <= {r for r in bag(cut) if size(r[1])} and max(times.values()) <= 3
    words, drawn = Counter(), Counter()
    for _, t, s in cut:
        words[s] += size(t)
    for (_, t, s), n in times.items():
        drawn[s] += n * size(t)
    weights, total = {"a": 5, "b": 2, None: 1}, sum(words.values())
    level = {s: min(3 * words[s], 1e18) for s in words}
    share = total
    full = set()
    while True:
        free = [s for s in words if s not in full]
        target = {s: (share - sum(level[x] for x in full)) * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if target[s] > level[s]}
        if not over:
            break
        full |= over
    target |= {s: level[s] for s in full}
    for s in words:  # no nearer sum of whole rounds and documents once more, but for a few words
        reach, rest = 1, target[s] - int(target[s] // words[s]) * words[s]
        for r in cut:
            reach |= reach << size(r[1]) if r[2] == s else 0
        nearest = min(abs(i - rest) for i, bit in enumerate(bin(reach)[:1:-1]) if bit == "1")
        assert abs(drawn[s] - target[s]) <= nearest + 0.01 * target[s] + 1

    _, pieces = apply(4, docs)
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    ids = {r: np.asarray([*encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4") for r in times}
    per_doc, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        per_doc[p["doc_id"], p["doc_tokens"]].append((p["start"], p["length"], p["ids_crc32"]))
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    want = defaultdict(list)
    for r, n in times.items():
        want[r[0], len(ids[r])].append((ids[r], n))
    assert set(per_doc) == set(want)
    for doc, its in per_doc.items():
        (whole, n), *others = want[doc]
        if others:
            continue
        covered = Counter()
        for start, length, crc in its:
            assert zlib.crc32(whole[start : start + length].tobytes()) == crc
            covered.update(range(start, start + length))
        assert covered == Counter({i: n for i in range(len(whole))})
    for its in sequences.values():
        at = 0
        for offset, length in sorted(its):
            assert offset == at
            at += length
        assert at <= 4096


def test_stages_on_an_empty_table(spark, corpus, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, corpus).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def kernels_at_once(plan, above=0):
    """The most Python kernels that one task of a plan runs, each in a worker of its own."""
    name = plan.nodeName()
    here = 0 if "Exchange" in name else above + bool(re.search("InArrow|InPandas|Python|ArrowEval", name))
    children = plan.children()
    return max([here, *(kernels_at_once(children.apply(i), here) for i in range(children.size()))])


def test_tasks_have_one_python_worker(spark, tmp_path, monkeypatch):
    """Executors keep as many workers as ran at once; two a task, and others for rows made on the driver, took an executor beyond its memory."""
    from pyspark.sql.readwriter import DataFrameWriter

    found = []

    def noted(self, *args, f=None, **named):
        plan = self._df._jdf.queryExecution().executedPlan()
        found.append((kernels_at_once(plan), "ExistingRDD" in plan.toString()))
        return f(self, *args, **named)

    for name in ("parquet", "saveAsTable"):
        monkeypatch.setattr(DataFrameWriter, name, lambda self, *args, f=getattr(DataFrameWriter, name), **named: noted(self, *args, f=f, **named))
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # plans show their exchanges before they run
    try:
        for name, stage in corpus_pipeline.STAGES:
            found.clear()
            stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            assert any(n for n, _ in found), name
            assert all(n <= 1 and not from_driver for n, from_driver in found), (name, found)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
