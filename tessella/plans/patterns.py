"""A language of word patterns, met in each document's row, or compiled to joins on rows of words.

A pattern is a row of terms, ``[...]``, with gaps between them: nothing for the next word, ``..3`` for one of the next four,
``..`` for any later word of the document. A term is ``[]`` for any word or conditions that all hold, ``key=value`` or
``key!=value``, with values apart by ``|``. Keys are ``word``, ``starts``, ``ends``, ``lang`` and ``source``. A value ``@x`` of
``word`` is a variable: it takes the word where it stands first, and stands for it later.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators.grams import flat
from tessella.plans.registry import SQL_TOKENS, query
from tessella.sources.tables import load

PART = re.compile(r"\s*(?:\[([^\[\]]*)\]|(\.\.)(\d*))")
CONDITION = re.compile(r"(\w+)(!?=)(\S+)$")
KEYS = ("word", "starts", "ends", "lang", "source")
MOST_TERMS, MOST_GAP = 12, 50
#: Ways that a task lengthens at once.
HELD = 1 << 18


class PatternError(ValueError):
    """What is wrong with a pattern: ``code`` names it."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class Condition:
    key: str
    equal: bool
    values: tuple[str, ...]

    @property
    def variable(self) -> str | None:
        return self.values[0][1:] if self.values[0].startswith("@") else None


@dataclass(frozen=True)
class Term:
    conditions: tuple[Condition, ...]
    #: How many words may lie between this term and the one before; None for any number.
    gap: int | None = 0


def parse(pattern: str) -> list[Term]:
    terms: list[Term] = []
    gap, at, bound = 0, 0, set()
    loose = False
    while at < len(pattern.rstrip()):
        m = PART.match(pattern, at)
        if not m:
            raise PatternError("syntax", pattern[at : at + 20])
        at = m.end()
        if m[2]:
            if not terms:
                raise PatternError("gap_at_start")
            if loose:
                raise PatternError("two_gaps")
            gap, loose = (int(m[3]) if m[3] else None), True
            if gap is not None and gap > MOST_GAP:
                raise PatternError("gap_too_long", m[3])
            continue
        conditions = []
        for part in m[1].split():
            c = CONDITION.match(part)
            if not c:
                raise PatternError("condition", part)
            if c[1] not in KEYS:
                raise PatternError("key", c[1])
            found = Condition(c[1], c[2] == "=", tuple(v for v in c[3].split("|") if v))
            if not found.values:
                raise PatternError("value", part)
            if found.variable is not None:
                if found.key != "word" or len(found.values) > 1:
                    raise PatternError("variable", part)
                if found.variable not in bound and not found.equal:
                    raise PatternError("unbound", part)
                bound.add(found.variable)
            conditions.append(found)
        terms.append(Term(tuple(conditions), gap if terms else 0))
        gap, loose = 0, False
    if loose:
        raise PatternError("gap_at_end")
    if not terms:
        raise PatternError("empty")
    if len(terms) > MOST_TERMS:
        raise PatternError("too_many_terms", str(len(terms)))
    if all(not [c for c in t.conditions if c.equal and c.variable is None] for t in terms) and not bound:
        raise PatternError("too_broad", pattern)
    return terms


def holds(c: Condition) -> Column:
    """A condition without a variable on a word's row."""
    if c.key in ("starts", "ends"):
        test = F.startswith if c.key == "starts" else F.endswith
        found = reduce(lambda a, b: a | b, (test(F.col("token"), F.lit(v)) for v in c.values))
    else:
        found = F.col("token" if c.key == "word" else c.key).isin(*c.values)
    found = F.coalesce(found, F.lit(False))
    return found if c.equal else ~found


def match(words: DataFrame, pattern: str) -> DataFrame:
    """doc_id, first (place of the first word), places, matched: every way that a pattern fits rows (doc_id, idx, token, lang, source).

    Each term's rows are filtered before they are joined; terms at a bounded distance meet by document and place, only
    ``..`` meets by document alone.
    """
    out, at = None, {}
    for i, term in enumerate(parse(pattern)):
        plain = [holds(c) for c in term.conditions if c.variable is None]
        rows = words.where(reduce(lambda a, b: a & b, plain)) if plain else words
        rows = rows.select("doc_id", F.col("idx").alias(f"i{i}"), F.col("token").alias(f"t{i}"))
        if out is None:
            out = rows
        elif term.gap is None:
            out = out.join(rows, "doc_id").where(F.col(f"i{i}") > F.col(f"i{i - 1}"))
        else:
            steps = F.explode(F.sequence(F.col(f"i{i - 1}") + 1, F.col(f"i{i - 1}") + 1 + term.gap)) if term.gap else F.col(f"i{i - 1}") + 1
            out = out.withColumn(f"i{i}", steps).join(rows, ["doc_id", f"i{i}"])
        for c in term.conditions:
            if c.variable is None:
                continue
            if c.variable in at:
                same = F.col(f"t{i}") == F.col(f"t{at[c.variable]}")
                out = out.where(same if c.equal else ~same)
            else:
                at[c.variable] = i
    n = i + 1
    return out.select("doc_id", F.col("i0").cast("long").alias("first"), F.array(*(F.col(f"i{k}").cast("long") for k in range(n))).alias("places"), F.array(*(f"t{k}" for k in range(n))).alias("matched"))


def checks_of(terms: list[Term]) -> list[list[tuple[bool, int]]]:
    """For each term, the terms whose word its own must be (True) or must not be."""
    at, out = {}, []
    for i, term in enumerate(terms):
        named = [c for c in term.conditions if c.variable is not None]
        out.append([(c.equal, at.setdefault(c.variable, i)) for c in named])
    return out


def _fits(c: Condition, batch, words, codes, sizes) -> np.ndarray:
    """``holds`` for every word of a batch; ``words`` has each of them once, ``codes`` says which."""
    if c.key in ("lang", "source"):
        found = np.repeat(pc.is_in(batch.column(c.key), value_set=pa.array(c.values)).to_numpy(zero_copy_only=False), sizes)
    elif c.key == "word":
        found = pc.is_in(words, value_set=pa.array(c.values)).to_numpy(zero_copy_only=False)[codes]
    else:
        test = pc.starts_with if c.key == "starts" else pc.ends_with
        found = reduce(lambda a, b: a | b, (test(words, v).to_numpy(zero_copy_only=False) for v in c.values))[codes]
    return found if c.equal else ~found


def _longer(terms, checks, fits, codes, end, at):
    """Every way to complete ``at``, the places of the first terms."""
    i = len(at)
    if i == len(terms):
        yield at
        return
    last, gap = at[-1], terms[i].gap
    first = np.searchsorted(fits[i], last + 1)
    n = np.searchsorted(fits[i], end[last] if gap is None else np.minimum(end[last], last + gap + 2)) - first
    cuts = np.nonzero(np.diff(np.cumsum(n) // HELD))[0] + 1
    for a, b in zip([0, *cuts], [*cuts, len(n)], strict=True):
        k = np.repeat(np.arange(a, b), n[a:b])
        before = np.cumsum(n[a:b]) - n[a:b]
        place = fits[i][np.arange(len(k)) + np.repeat(first[a:b] - before, n[a:b])]
        now = [*(x[k] for x in at), place]
        ok = _agree(checks[i], codes, now)
        yield from _longer(terms, checks, fits, codes, end, [x[ok] for x in now])


def _agree(checks, codes, at) -> np.ndarray:
    ok = np.ones(len(at[-1]), bool)
    for equal, j in checks:
        ok &= (codes[at[-1]] == codes[at[j]]) == equal
    return ok


def _met(terms: list[Term], schema):
    def run(batches):
        checks = checks_of(terms)
        for batch in batches:
            strings, starts = flat(batch.column("ws"))
            if not len(strings):
                continue
            coded, sizes = strings.dictionary_encode(), np.diff(starts)
            codes, row = coded.indices.to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
            end, fits = starts[1:][row], []
            for term in terms:
                plain = [_fits(c, batch, coded.dictionary, codes, sizes) for c in term.conditions if c.variable is None]
                fits.append(np.nonzero(reduce(lambda a, b: a & b, plain, np.ones(len(codes), bool)))[0])
            for a in range(0, len(fits[0]), HELD):
                at = [fits[0][a : a + HELD]]
                for found in _longer(terms, checks, fits, codes, end, [at[0][_agree(checks[0], codes, at)]]):
                    if not len(found[0]):
                        continue
                    places, of = np.stack(found, 1), row[found[0]]
                    listed = lambda x, n=len(of): pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="i4") * len(terms)), x)
                    local = places - starts[of][:, None]
                    columns = [batch.column("doc_id").take(pa.array(of)), pa.array(local[:, 0]), listed(pa.array(local.ravel())), listed(strings.take(pa.array(places.ravel())))]
                    yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def match_documents(docs: DataFrame, pattern: str) -> DataFrame:
    """``match`` on documents (doc_id, lang, source, text): the words of a row meet where it is read, and none of them moves.

    Rows that share a doc_id are one document; only their words meet by joins.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    terms, shared = parse(pattern), None
    if len(terms) > 1:
        docs = docs.where(F.col("doc_id").isNotNull())  # as in a join
        ids = docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
        if ids.limit(1).count():
            shared, docs = docs.join(ids, "doc_id", "left_semi"), docs.join(ids, "doc_id", "left_anti")
    shape = docs.select("doc_id", F.lit(0).cast("long").alias("first"), F.array(F.lit(0).cast("long")).alias("places"), F.array(F.lit("")).alias("matched")).schema
    found = docs.select("doc_id", "lang", "source", text.words(F.col("text")).alias("ws")).mapInArrow(_met(terms, to_arrow_schema(shape)), shape)
    return found if shared is None else found.unionByName(match(worded(shared), pattern))


def worded(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "lang", "source", F.posexplode(text.words(F.col("text"))).alias("idx", "token"))


def corpus_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worded(load(spark, sf_dir, "documents"))


def registered(name: str, pattern: str, sql: str) -> None:
    @query(name, f"WITH {SQL_TOKENS} {sql}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = match_documents(load(spark, sf_dir, "documents"), pattern)
        return found.select("doc_id", "first", F.array_join("places", " ").alias("places"), F.array_join("matched", " ").alias("matched"))

    run.__doc__ = f"Every place where {pattern} fits."


def _sql(n: int, on: list[str], where: str) -> str:
    """Joins of ``n`` words' rows: ``on`` has the conditions of each but the first."""
    joins = " ".join(f"JOIN toks t{i} ON t{i}.doc_id = t0.doc_id AND {c}" for i, c in enumerate(on, 1))
    show = lambda c: " || ' ' || ".join(f"t{i}.{c}::VARCHAR" for i in range(n))
    return f"SELECT t0.doc_id AS doc_id, t0.idx AS first, {show('idx')} AS places, {show('token')} AS matched FROM toks t0 {joins} WHERE {where}"


registered("pattern_adjacent", "[word=the] [] [word=of]", _sql(3, ["t1.idx = t0.idx + 1", "t2.idx = t1.idx + 1"], "t0.token = 'the' AND t2.token = 'of'"))
registered("pattern_gap", "[word=the|der|les] ..2 [starts=s ends=e|n word!=sein]", _sql(2, ["t1.idx BETWEEN t0.idx + 1 AND t0.idx + 3"], "t0.token IN ('the', 'der', 'les') AND t1.token LIKE 's%' AND (t1.token LIKE '%e' OR t1.token LIKE '%n') AND t1.token <> 'sein'"))
registered("pattern_repeated_word", "[lang=en word=@x] [word=@x] [word!=@x]", _sql(3, ["t1.idx = t0.idx + 1", "t2.idx = t1.idx + 1"], "t0.lang = 'en' AND t0.token = t1.token AND t2.token <> t0.token"))
registered("pattern_framed_word", "[word=@x] [word!=@x] ..1 [word=@x lang!=en]", _sql(3, ["t1.idx = t0.idx + 1", "t2.idx BETWEEN t1.idx + 1 AND t1.idx + 2"], "t1.token <> t0.token AND t2.token = t0.token AND (t2.lang <> 'en' OR t2.lang IS NULL)"))
registered("pattern_rest_of_document", "[word=idiot|moron] .. [word=trash|scum]", _sql(2, ["t1.idx > t0.idx"], "t0.token IN ('idiot', 'moron') AND t1.token IN ('trash', 'scum')"))
registered("pattern_single_term", "[starts=un ends=er source!=src1]", _sql(1, [], "t0.token LIKE 'un%' AND t0.token LIKE '%er' AND (t0.source <> 'src1' OR t0.source IS NULL)"))
