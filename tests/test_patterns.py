"""The pattern language by brute force, what it refuses, and sets of documents."""

import random
from itertools import product

import pytest

from tessella.operators import kernels
from tessella.plans import patterns, sets

WORDS = ["a", "b", "c", "ab", "ba"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    return {d: [rng.choice(WORDS) for _ in range(rng.randint(0, 14))] for d in range(25)}


def fits(term, word, lang, bound):
    bound = dict(bound)
    for c in term.conditions:
        if c.variable is not None:
            if c.variable in bound:
                ok = word == bound[c.variable]
            else:
                bound[c.variable], ok = word, True
        elif c.key == "word":
            ok = word in c.values
        elif c.key == "starts":
            ok = any(word.startswith(v) for v in c.values)
        elif c.key == "ends":
            ok = any(word.endswith(v) for v in c.values)
        else:
            ok = lang in c.values
        if ok != c.equal:
            return None
    return bound


def by_hand(corpus, pattern):
    out = []
    for (d, ws), _ in product(corpus.items(), [0]):
        lang = "en" if d % 2 else None
        ways = [((), {})]
        for term in patterns.parse(pattern):
            longer = []
            for places, bound in ways:
                first = places[-1] + 1 if places else 0
                last = len(ws) if not places or term.gap is None else min(len(ws), first + term.gap + 1)
                for i in range(first, last):
                    now = fits(term, ws[i], lang, bound)
                    if now is not None:
                        longer.append(((*places, i), now))
            ways = longer
        out += [(d, list(p)) for p, _ in ways]
    return sorted(out)


@pytest.mark.parametrize("pattern", ["[word=a] [word=b]", "[word=a] [] [word=c|b]", "[word=a] ..2 [ends=b]", "[starts=a] .. [word=c] [word!=c]", "[word=@x] [word=@x]", "[word=@x] ..3 [word!=@x lang=en] [word=@x]", "[word=@x starts=a] [word=@y] .. [word=@y]", "[lang!=en word=ba]"])
def test_patterns_by_brute_force(spark, corpus, pattern):
    rows = [(d, "en" if d % 2 else None, "s", i, w) for d, ws in corpus.items() for i, w in enumerate(ws)]
    words = spark.createDataFrame(rows, "doc_id long, lang string, source string, idx int, token string")
    got = patterns.match(words, pattern).collect()
    assert sorted((r["doc_id"], r["places"]) for r in got) == by_hand(corpus, pattern)
    assert all(r["matched"] == [corpus[r["doc_id"]][i] for i in r["places"]] for r in got)


@pytest.mark.parametrize("pattern", ["[word=a] [word=b]", "[word=a] [] [word=c|b]", "[word=a] ..2 [ends=b]", "[starts=a] .. [word=c] [word!=c]", "[word=@x] [word!=@x] ..1 [word=@x lang!=en]", "[word=@x starts=a] [word=@y] .. [word=@y]", "[lang!=en word=ba source!=t]", "[word=@x word!=@x] [word=a]"])
def test_patterns_within_rows(spark, corpus, monkeypatch, pattern):
    """the words of a document meet in its row, in pieces too; rows that share a doc_id are one document, those without one meet nothing."""
    monkeypatch.setattr(patterns, "HELD", 16)
    rows = [(d, "en" if d % 2 else None, "s" if d % 3 else None, " ".join(ws)) for d, ws in corpus.items()] + [(None, "en", "s", "a b a b"), (99, None, None, None)]
    again = [(1, "de", "t", "a c b A b a"), (1, "en", "t", "b a b")]
    shape = "doc_id long, lang string, source string, text string"
    for data in (spark.createDataFrame(rows, shape), spark.createDataFrame(rows + again, shape)):
        found = patterns.match_documents(data, pattern)
        want = sorted(map(repr, patterns.match(patterns.worded(data), pattern).collect()))
        assert sorted(map(repr, found.collect())) == want
        assert ("word!=@x] [word" in pattern) == (not want)
    plan = patterns.match_documents(spark.createDataFrame(rows, shape), pattern)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize(
    ("pattern", "code"),
    [("", "empty"), ("word=a", "syntax"), ("[word]", "condition"), ("[lemma=a]", "key"), ("[word=|]", "value"), ("[lang=@x]", "variable"), ("[word!=@x]", "unbound"), ("..2 [word=a]", "gap_at_start"), ("[word=a] ..", "gap_at_end"), ("[word=a] .. ..2 [word=b]", "two_gaps"), ("[word=a] ..99 [word=b]", "gap_too_long"), ("[] []", "too_broad"), ("[word=a] " * 13, "too_many_terms")],
)
def test_what_is_refused(pattern, code):
    with pytest.raises(patterns.PatternError) as e:
        patterns.parse(pattern)
    assert e.value.code == code


def test_sets_refuse_unknown_items(spark):
    for expression, code in (("", "empty"), ("book:x", "kind"), ("source", "item"), ("docs:x", "range")):
        with pytest.raises(patterns.PatternError) as e:
            sets.document_set(spark, "/root/testdata/sf0.001", expression)
        assert e.value.code == code


def test_unit_alignment_is_that_of_the_plain_programme():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        assert kernels.local_alignment(a, b) == kernels.local_alignment(a, b, {"no": 1.0})
