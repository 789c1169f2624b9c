"""Toxicity: cumulative-link ordinal regression on sparse word features.

Grades 0 to 3 share one weight vector w; P(grade <= k) = logistic(threshold_k - w.x) with rising thresholds,
and a document's severity is its expected grade, the sum of P(grade > k). x has 1 + log(count) for each
selected word or beginning of a word. The model is fitted on at most ``SAMPLE`` labelled documents, those whose ids hash lowest; everything
else reads all rows.

Labels only say toxic or not, so grades are made on the sample: documents labelled clean have grade 0; toxic
ones have grade 1, 2 from ``GRADE_2`` and 3 from ``GRADE_3`` occurrences of marked words, which have a feature that the
sample's toxic documents have far more often than its clean ones.

Features are ranked by the chi-squared statistic of their documents and the labels. There is no threshold: of those in
``LEAST_DOCS`` labelled documents or more, as many are taken as half of the labelled documents, ``MOST_FEATURES`` at most; where no
feature is in so many, those in one. Values are scaled by the root of the statistic, so that features which chance may
have picked are penalised most. Few labels so mean few features; what these cannot show is missed (with 50 labels, 6
of them toxic, about half of the toxic documents that have a marked word; with 100 and more, at most a few in a hundred).

Defined cases: null and empty texts have no words and get the score of the thresholds alone; labels that are
null, or whose id is null or has no document, don't count; with no labelled document, or one class only,
every document gets the share of toxic labels (0 without labels); repeated rows are scored each; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._common import per_batch, short_batches, table, texts_of, to_batch, written

SAMPLE, MOST_FEATURES, LEAST_DOCS, DOCS_PER_FEATURE, MARKED_LOG_ODDS = 10_000, 4096, 2, 2, 2.0
GRADES, GRADE_2, GRADE_3 = 4, 3, 6
#: The penalty is ``RIDGE`` over the number of documents, as the loss is a mean.
RIDGE, STEPS, RATE = 0.03, 600, 0.1
WORDS = regex.compile(r"\w+")
#: Besides whole words, their first letters are features, as inflected words share them.
PREFIXES, WORDS_HELD = (4, 5, 6), 60_000


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def features(word: str) -> list[int]:
    """Hashes, signed as Spark's longs are, of a word and its first letters."""
    keys = [word, *(f"{word[:n]}*" for n in PREFIXES if n < len(word))]
    return [int.from_bytes(xxhash.xxh3_64_digest(k), "little", signed=True) for k in keys]


class Selected(dict):
    """The selected features of a word, by their places."""

    def __init__(self, known: list[int]):
        self.places = {k: i for i, k in enumerate(known)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= WORDS_HELD:
            self.clear()
        out = self[word] = tuple(self.places[f] for f in features(word) if f in self.places)
        return out

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places of the selected features of a text, and how often each occurs."""
        return np.unique(np.fromiter((i for found in map(self.__getitem__, words_of(text)) if found for i in found), "i8"), return_counts=True)


def strength(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def logistic(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    known: list[int]  # features by place
    weights: np.ndarray
    thresholds: np.ndarray  # rising

    def scorer(self) -> Callable[[str], np.ndarray]:
        """From a text to P(grade > k) for each k."""
        selected, basis = Selected(self.known), logistic(-self.thresholds)

        def run(text: str) -> np.ndarray:
            at, counts = selected.counts(text)
            return logistic(self.weights[at] @ strength(counts) - self.thresholds) if len(at) else basis

        return run


def descend(doc_of: np.ndarray, at: np.ndarray, x: np.ndarray, grades: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least penalised loss, by a fixed number of Adam steps."""
    n, k = len(grades), int(grades.max())
    above = np.array([(grades > j).mean() for j in range(k)])
    start = -np.log(above / (1 - above))
    p = np.concatenate([np.zeros(n_words), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        w, theta = p[:n_words], np.cumsum(np.concatenate([p[n_words : n_words + 1], np.exp(p[n_words + 1 :])]))
        score = np.bincount(doc_of, weights=w[at] * x, minlength=n)
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        upper, lower = logistic(edges[grades + 1] - score), logistic(edges[grades] - score)
        gap = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / gap, lower * (1 - lower) / gap
        to_score = (d_upper - d_lower) / n
        to_theta = np.array([(d_lower[grades == j + 1].sum() - d_upper[grades == j].sum()) / n for j in range(k)])
        onward = np.cumsum(to_theta[::-1])[::-1]
        grad = np.concatenate([np.bincount(at, weights=to_score[doc_of] * x, minlength=n_words) + RIDGE / n * w, onward[:1], onward[1:] * np.exp(p[n_words + 1 :])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        p -= RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:n_words], np.cumsum(np.concatenate([p[n_words : n_words + 1], np.exp(p[n_words + 1 :])]))


def constant(share: float) -> Model:
    """Without two classes: every document gets the one there is."""
    return Model([], np.zeros(0), np.arange(GRADES - 1) * 40.0 + (-40.0 if share >= 0.5 else 40.0))


def fit_sample(sample: list[tuple[np.ndarray, np.ndarray, int, int]], known: list[int], scale: np.ndarray | None = None) -> Model:
    """From (places, counts, toxic, marked words) of labelled documents. A feature's weight is penalised as that of its values times ``scale``."""
    scale = np.ones(len(known)) if scale is None else scale
    toxic, hits = (np.array([s[i] for s in sample], "i8") for i in (2, 3))
    doc_of = np.repeat(np.arange(len(sample)), [len(s[0]) for s in sample])
    at, counts = (np.concatenate([s[i] for s in sample]).astype("i8") for i in (0, 1))
    grades = np.where(toxic == 1, 1 + (hits >= GRADE_2) + (hits >= GRADE_3), 0)
    grades = np.unique(grades, return_inverse=True)[1]  # without grades that nobody has
    weights, thresholds = descend(doc_of, at, strength(counts) * scale[at], grades, len(known))
    return Model(known, weights * scale, thresholds)


SPARSE = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("hits", pa.int64()), ("places", pa.binary()), ("counts", pa.binary())])
LONG = pa.schema([("toxic", pa.int32()), ("feature", pa.int64())])


def _each_feature(batches):
    for batch in batches:
        toxic, found = [], []
        for t, text in zip(batch.column("toxic").to_pylist(), texts_of(batch.column("text")), strict=True):
            its = {f for w in set(words_of(text)) for f in features(w)}
            found.extend(its)
            toxic.extend([t] * len(its))
        yield to_batch({"toxic": toxic, "feature": found}, LONG)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    usable = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # 12 bytes a row, ``sample`` rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    rows = written(rows, "toxicity-sample")
    n, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n_toxic < n:
        return constant(n_toxic / n if n else 0.0)
    found = rows.mapInArrow(_each_feature, "toxic int, feature long").groupBy("feature").agg(F.count("*").alias("docs"), F.sum("toxic").alias("of_toxic"))
    expected = F.col("docs") * n_toxic / n
    chi2 = F.pow(F.col("of_toxic") - expected, 2) * n * n / (expected * (n - n_toxic) * F.greatest(n - F.col("docs"), F.lit(1)))
    log_odds = F.log((F.col("of_toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("docs") - F.col("of_toxic") + 0.5) / (n - n_toxic + 1))
    found = found.withColumn("chi2", F.round(chi2, 6)).withColumn("marked", log_odds >= MARKED_LOG_ODDS)
    best = found.orderBy((F.col("docs") < LEAST_DOCS).cast("int"), F.desc("chi2"), "feature").limit(min(MOST_FEATURES, max(1, n // DOCS_PER_FEATURE))).collect()
    if any(r["docs"] >= LEAST_DOCS for r in best):
        best = [r for r in best if r["docs"] >= LEAST_DOCS]
    if not best:
        return constant(n_toxic / n)
    known, marked = [r["feature"] for r in best], np.array([r["marked"] for r in best])
    scale = np.sqrt(np.array([r["chi2"] for r in best]) / max(best[0]["chi2"], 1e-9))

    def sparse(batch: pa.RecordBatch) -> dict:
        selected = Selected(known)
        texts = texts_of(batch.column("text"))
        its = [selected.counts(t) for t in texts]
        hits = [sum(any(marked[i] for i in selected[w]) for w in words_of(t)) for t in texts]
        return {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "hits": hits, "places": [w.astype("u2").tobytes() for w, _ in its], "counts": [c.astype("u4").tobytes() for _, c in its]}

    their = rows.mapInArrow(per_batch(SPARSE, sparse), "doc_id long, toxic int, hits long, places binary, counts binary").orderBy("doc_id").limit(sample)
    return fit_sample([(np.frombuffer(r["places"], "u2"), np.frombuffer(r["counts"], "u4"), r["toxic"], r["hits"]) for r in their.toLocalIterator()], known, scale)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, p_toxic (of grade 1 or more), severity (the expected grade): a row a document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MOST_FEATURES features at most
    schema = pa.schema([("doc_id", pa.int64()), ("p_toxic", pa.float64()), ("severity", pa.float64())])

    def run(batches):
        exceeds = shared.value.scorer()
        for batch in batches:
            above = [exceeds(t) for t in texts_of(batch.column("text"))]
            yield to_batch({"doc_id": batch.column("doc_id"), "p_toxic": [round(float(a[0]), 9) for a in above], "severity": [round(float(a.sum()), 9) for a in above]}, schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, p_toxic double, severity double")


REJECT_AT = 0.5


def without_toxic(docs: DataFrame, model: Model, reject_at: float = REJECT_AT) -> DataFrame:
    """The rows of ``docs``, all columns, whose probability of grade 1 or more is under ``reject_at``."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        exceeds = shared.value.scorer()
        for batch in batches:
            yield batch.filter(pa.array([bool(exceeds(t)[0] < reject_at) for t in texts_of(batch.column("text"))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return rows.withColumn("toxic", F.col("p_toxic") >= REJECT_AT)
