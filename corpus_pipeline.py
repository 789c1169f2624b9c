"""A corpus from documents: toxic ones out, one of each group of near copies, repeated passages cut, sources mixed, packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. So when a stage is called, the result of the one before it has been stored, and what that one had put aside
in the shared folder is deleted; nothing else is. All but the last return the columns of ``documents``; ``n_chars`` follows the text where it changes.

Defined cases: null and empty texts are clean, are nobody's copies and have no repeats; the mixture takes no document
without words, so these go there. Rows equal in id and text are documents of their own until the near-duplicate stage, which keeps
one of a class. An empty table gives an empty table at every stage. Further columns of any name are kept up to the mixture.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessella.llm import chosen_path, mixing, packing, substring_dedup, toxicity
from tessella.llm._common import Scope, table, written

#: What each stage's calls put aside, by the stage's place, the latest call last.
HELD: dict[int, list[Scope]] = {}


def stage(place: int):
    """A stage that owns what it puts aside until the next one is called."""

    def wrap(work):
        @wraps(work)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if HELD.get(place - 1):
                HELD[place - 1].pop().release()
            with Scope(spark) as scope:
                out = work(spark, docs, sf_dir)
            HELD.setdefault(place, []).append(scope)
            return out

        return run

    return wrap


@stage(0)
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of grade 1 or more is under one half, by a model fitted on labelled ones of ``docs``."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


@stage(1)
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of documents linked at a Jaccard similarity of 0.8 or more."""
    return chosen_path.one_of_each(docs)


@stage(2)
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that start earlier; documents of which nothing is left go."""
    return substring_dedup.without_repeats(docs)


@stage(3)
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mixture takes a document."""
    return mixing.mix(docs)


@stage(4)
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of at most 4096 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("suffix_array_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No stage can be stated in SQL as a whole; the tests hold the operators against brute force, and of the stages only row counts and columns.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What it reads (its docs, and what it put aside) stays for them, all else is deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, work in STAGES[:-1]:
        with Scope(spark) as own:
            docs = written(work(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            before.release()
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
