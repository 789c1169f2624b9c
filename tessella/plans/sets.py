"""Sets of documents by expressions, and analyses of sets, units and orders with their tests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import dense, permutation
from tessella.plans.patterns import PatternError, corpus_words, match
from tessella.plans.registry import SQL_TOKENS, query
from tessella.plans.vectors import SQL_COS
from tessella.sources.tables import load

RANGE = re.compile(r"(\d+)(?:-(\d+))?$")


def document_set(spark: SparkSession, sf_dir: str, expression: str) -> DataFrame:
    """doc_id, each once, of items apart by ``;``: ``source:``, ``lang:``, ``docs:7`` or ``docs:3-9``, ``pattern:`` (see patterns), and ``only:`` before one of these, which keeps what is in it as well."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    found, only = [], []
    for item in filter(None, map(str.strip, expression.split(";"))):
        keep = item.startswith("only:")
        kind, _, value = item.removeprefix("only:").partition(":")
        if not value:
            raise PatternError("item", item)
        if kind in ("source", "lang"):
            rows = docs.where(F.col(kind).isin(*value.split("|")))
        elif kind == "docs":
            m = RANGE.match(value)
            if not m:
                raise PatternError("range", value)
            rows = docs.where(F.col("doc_id").between(int(m[1]), int(m[2] or m[1])))
        elif kind == "pattern":
            rows = match(corpus_words(spark, sf_dir), value)
        else:
            raise PatternError("kind", kind)
        (only if keep else found).append(rows.select("doc_id"))
    if not found and not only:
        raise PatternError("empty")
    out = found[0] if found else docs.select("doc_id")
    for more in found[1:]:
        out = out.unionByName(more)
    for rows in only:
        out = out.join(rows, "doc_id", "left_semi")
    return out.distinct()


@query("set_members", f"WITH {SQL_TOKENS}, p AS (SELECT DISTINCT t0.doc_id FROM toks t0 JOIN toks t1 ON t1.doc_id = t0.doc_id AND t1.idx = t0.idx + 1 WHERE t0.token = 'of' AND t1.token = 'the') SELECT doc_id FROM documents WHERE (source IN ('src1', 'src2') OR doc_id BETWEEN 10 AND 60 OR doc_id IN (SELECT doc_id FROM p)) AND lang IN ('en', 'de')")
def set_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_set(spark, sf_dir, "source:src1|src2; docs:10-60; pattern:[word=of] [word=the]; only:lang:en|de")


SQL_DRAW = "(n * 7919 + draw * 104729 + n * draw) % 1000003"


@query("set_check", f"""WITH {SQL_TOKENS}, h AS (SELECT doc_id, count(*) FILTER (token = 'the') AS hits, count(*) AS size FROM toks GROUP BY doc_id), d AS (SELECT doc_id AS n, lang AS g, source IN ('src1', 'src2') AS inside, coalesce(hits, 0) AS hits, coalesce(size, 0) AS size FROM documents LEFT JOIN h USING (doc_id) WHERE doc_id IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL),
e AS (SELECT *, row_number() OVER (PARTITION BY g, draw ORDER BY n) AS i, row_number() OVER (PARTITION BY g, draw ORDER BY CASE WHEN draw = 0 THEN n ELSE {SQL_DRAW} END, n) AS j FROM d, (SELECT unnest(range(200)) AS draw)),
s AS (SELECT a.draw, 1000 * sum(a.hits) FILTER (b.inside) / sum(a.size) FILTER (b.inside) AS rate FROM e a JOIN e b ON a.g = b.g AND a.draw = b.draw AND a.j = b.i GROUP BY a.draw), o AS (SELECT rate AS observed FROM s WHERE draw = 0)
SELECT round(observed, 6) AS observed, round((1 + count(*) FILTER (rate >= observed - 1e-12)) / (1 + count(*)), 6) AS p_more, round((1 + count(*) FILTER (rate <= observed + 1e-12)) / (1 + count(*)), 6) AS p_less, round(quantile_cont(rate, 0.025), 6) AS low, round(quantile_cont(rate, 0.975), 6) AS high FROM s, o WHERE draw > 0 GROUP BY observed""")
def set_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a word more frequent in a set of documents than in sets redrawn within their languages? Rate a thousand words, both tails, interval of 199 draws."""
    words = corpus_words(spark, sf_dir)
    counts = words.groupBy("doc_id").agg(F.count_if(F.col("token") == "the").alias("hits"), F.count("*").alias("size"))
    docs = load(spark, sf_dir, "documents").where("doc_id is not null and lang is not null and source is not null")
    rows = docs.select(F.col("doc_id"), "lang", F.col("source").isin("src1", "src2").alias("inside")).join(counts, "doc_id", "left").fillna(0, ["hits", "size"])
    drawn = permutation.permuted(rows, "doc_id", ["lang"], "inside", 199).where("inside")
    rates = drawn.groupBy("draw").agg((1000 * F.sum("hits") / F.sum("size")).alias("rate"))
    out = permutation.p_values(rates, [], "rate")
    return out.select(*(F.round(c, 6).alias(c) for c in ("observed", "p_more", "p_less", "low", "high")))


@query("stratified_permutation", f"""WITH d AS (SELECT event_id AS n, user_id % 10 AS g, event_type = 'purchase' AS inside, value FROM events WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL),
e AS (SELECT *, row_number() OVER (PARTITION BY g, draw ORDER BY n) AS i, row_number() OVER (PARTITION BY g, draw ORDER BY CASE WHEN draw = 0 THEN n ELSE {SQL_DRAW} END, n) AS j FROM d, (SELECT unnest(range(100)) AS draw)),
s AS (SELECT a.draw, a.g, avg(a.value) FILTER (b.inside) - avg(a.value) FILTER (NOT b.inside) AS diff FROM e a JOIN e b ON a.g = b.g AND a.draw = b.draw AND a.j = b.i GROUP BY ALL), o AS (SELECT g, diff AS observed FROM s WHERE draw = 0)
SELECT g AS stratum, round(observed, 6) AS observed, round((1 + count(*) FILTER (diff >= observed - 1e-12)) / (1 + count(*)), 6) AS p_more, round((1 + count(*) FILTER (diff <= observed + 1e-12)) / (1 + count(*)), 6) AS p_less FROM s JOIN o USING (g) WHERE draw > 0 GROUP BY g, observed""")
def stratified_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean difference between purchases and other events in each stratum, against labels permuted within it."""
    events = load(spark, sf_dir, "events").where("event_id is not null and user_id is not null and event_type is not null and value is not null")
    rows = events.select(F.col("event_id").alias("n"), (F.col("user_id") % 10).alias("stratum"), (F.col("event_type") == "purchase").alias("inside"), "value")
    means = permutation.permuted_differences(rows, 99)
    out = permutation.p_values(means, ["stratum"], "diff")
    return out.select("stratum", *(F.round(c, 6).alias(c) for c in ("observed", "p_more", "p_less")))


@query("maxsim_labels", f"WITH {SQL_COS} SELECT src_label AS unit, tgt_label AS other, round(avg(m), 5) AS score FROM (SELECT src_label, tgt_label, src, max(round(c, 6)) AS m FROM cos WHERE src_label <> tgt_label GROUP BY ALL) GROUP BY ALL")
def maxsim_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every two labels the mean, over the first one's vectors, of the best cosine to the second one's; one way, not symmetrised."""
    v = dense.unit_vectors(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return dense.best_in_units(v).groupBy("unit", "other").agg(F.round(F.avg(F.round("m", 6)), 5).alias("score"))


@query("heaps_fit", f"""WITH {SQL_TOKENS}, f AS (SELECT token, min(doc_id) AS doc_id FROM toks GROUP BY token), d AS (SELECT lang, doc_id, count(*) AS words FROM toks GROUP BY ALL), k AS (SELECT doc_id, count(*) AS new FROM f GROUP BY ALL),
c AS (SELECT lang, sum(words) OVER o AS n, sum(coalesce(new, 0)) OVER o AS v FROM d LEFT JOIN k USING (doc_id) WINDOW o AS (PARTITION BY lang ORDER BY doc_id)) SELECT lang, round(exp(regr_intercept(ln(v), ln(n))), 4) AS k, round(regr_slope(ln(v), ln(n)), 5) AS b FROM c WHERE v > 0 GROUP BY lang""")
def heaps_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V = k * N ** b by least squares of logarithms, over the documents of each language in reading order; kinds are new to the whole corpus."""
    rows = corpus_words(spark, sf_dir)
    new = rows.groupBy("token").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("new"))
    each = rows.groupBy("lang", "doc_id").agg(F.count("*").alias("words")).join(new, "doc_id", "left").fillna(0, ["new"])
    order = Window.partitionBy("lang").orderBy("doc_id")
    curve = each.select("lang", F.sum("words").over(order).alias("n"), F.sum("new").over(order).alias("v")).where("v > 0")
    fit = curve.groupBy("lang").agg(F.regr_intercept(F.log("v"), F.log("n")).alias("a"), F.regr_slope(F.log("v"), F.log("n")).alias("b"))
    return fit.select("lang", F.round(F.exp("a"), 4).alias("k"), F.round("b", 5).alias("b"))


@query("shrunk_rates", f"""WITH {SQL_TOKENS}, top AS (SELECT token FROM toks GROUP BY token ORDER BY count(*) DESC, token LIMIT 50), s AS (SELECT source, count(*) AS n FROM toks GROUP BY ALL), c AS (SELECT source, token, count(*) AS k FROM toks SEMI JOIN top USING (token) GROUP BY ALL), m AS (SELECT token, sum(k) / (SELECT sum(n) FROM s) AS mu FROM c GROUP BY token)
SELECT s.source AS source, m.token AS token, round((coalesce(k, 0) + 200 * mu) / (n + 200), 8) AS rate FROM s CROSS JOIN m LEFT JOIN c ON c.token = m.token AND c.source IS NOT DISTINCT FROM s.source""")
def shrunk_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k + a mu) / (n + a) of the 50 most frequent words in each source, mu pooled over all and a = 200."""
    rows = corpus_words(spark, sf_dir)
    top = rows.groupBy("token").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "token").limit(50)
    sizes = rows.groupBy("source").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    pooled = top.crossJoin(F.broadcast(total)).select("token", (F.col("c") / F.col("total")).alias("mu"))  # 50 rows and one
    counts = rows.join(F.broadcast(top.select("token")), "token").groupBy("source", "token").agg(F.count("*").alias("k")).withColumnsRenamed({"source": "c_source", "token": "c_token"})
    grid = sizes.crossJoin(F.broadcast(pooled))  # 50 rows a source
    out = grid.join(counts, (F.col("token") == F.col("c_token")) & F.col("source").eqNullSafe(F.col("c_source")), "left")
    return out.select("source", "token", F.round((F.coalesce("k", F.lit(0)) + 200 * F.col("mu")) / (F.col("n") + 200), 8).alias("rate"))


@query("speech_shares", r"""WITH t AS (SELECT conv_id, role, len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS n FROM conversations) SELECT conv_id, sum(n)::BIGINT AS words, round(coalesce(sum(n) FILTER (role = 'user'), 0) / greatest(sum(n), 1), 6) AS user_share, max(n)::BIGINT AS longest, count(DISTINCT role) AS roles FROM t GROUP BY conv_id""")
def speech_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose words a conversation is made of."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "role", F.size(text.words(F.col("text"))).alias("n"))
    share = F.coalesce(F.sum(F.when(F.col("role") == "user", F.col("n"))), F.lit(0)) / F.greatest(F.sum("n"), F.lit(1))
    return turns.groupBy("conv_id").agg(F.sum("n").alias("words"), F.round(share, 6).alias("user_share"), F.max("n").cast("long").alias("longest"), F.count_distinct("role").alias("roles"))


@query("column_ranks", "SELECT o_orderkey, name, row_number() OVER (PARTITION BY o_orderkey ORDER BY x DESC, pos) AS rank FROM (SELECT o_orderkey, unnest(['price', 'customer', 'order']) AS name, unnest([floor(o_totalprice)::BIGINT % 7, o_custkey % 7, o_orderkey % 7]) AS x, unnest([0, 1, 2]) AS pos FROM orders)")
def column_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of every column within its row, ties to the column that comes first; sorted within the row, nothing moves."""
    values = ((F.floor("o_totalprice").cast("long") % 7, "price"), (F.col("o_custkey") % 7, "customer"), (F.col("o_orderkey") % 7, "order"))
    cells = F.array(*(F.struct((-x).cast("long").alias("less"), F.lit(i).alias("at"), F.lit(n).alias("name")) for i, (x, n) in enumerate(values)))
    rows = load(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(F.array_sort(cells)).alias("i", "cell"))
    return rows.select("o_orderkey", F.col("cell.name").alias("name"), (F.col("i") + 1).cast("long").alias("rank"))


@query("nearest_snap", "WITH p AS (SELECT DISTINCT o_orderkey * 3 AS place FROM orders) SELECT event_id, place, abs(event_id - place) AS distance FROM events JOIN p ON place BETWEEN event_id - 4 AND event_id + 4 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(event_id - place), place) = 1")
def nearest_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's nearest place at most four away, ties to the smaller: the window is spelled out, so the join is on equal keys."""
    places = load(spark, sf_dir, "orders").select((F.col("o_orderkey") * 3).alias("place")).distinct()
    e = F.col("event_id")
    found = load(spark, sf_dir, "events").select("event_id", F.explode(F.sequence(e - 4, e + 4)).alias("place")).join(places, "place")
    nearest = F.min(F.struct(F.abs(e - F.col("place")).alias("distance"), "place")).alias("x")
    return found.groupBy("event_id").agg(nearest).select("event_id", "x.place", "x.distance")


@query("lagged_likeness", """WITH v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)
SELECT a.id AS id, round(max(list_cosine_similarity(a.e, b.e)), 6) AS best, arg_min(b.id, (-round(list_cosine_similarity(a.e, b.e), 6), b.id)) AS at FROM v a JOIN v b ON a.label = b.label AND b.id BETWEEN a.id - 60 AND a.id - 1 GROUP BY a.id""")
def lagged_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best cosine of a vector to those of its label up to 60 places before it; places are dealt to stretches of 60, so a vector meets two of these."""
    v = load(spark, sf_dir, "embeddings").where("vec_id is not null and embedding is not null").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("e"), F.floor(F.col("vec_id") / 60).alias("stretch"))
    before = v.select(F.col("id").alias("b"), "label", F.col("e").alias("f"), F.explode(F.array(F.col("stretch"), F.col("stretch") + 1)).alias("stretch"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda a, p: a + p)
    pairs = v.join(before, ["label", "stretch"]).where("b between id - 60 and id - 1")
    pairs = pairs.select("id", "b", F.round(dot(F.col("e"), F.col("f")) / F.sqrt(dot(F.col("e"), F.col("e")) * dot(F.col("f"), F.col("f"))), 6).alias("c"))
    return pairs.groupBy("id").agg(F.min(F.struct((-F.col("c")).alias("less"), "b")).alias("x")).select("id", (-F.col("x.less")).alias("best"), F.col("x.b").alias("at"))


@query("acrostic_runs", r"""WITH l AS (SELECT doc_id, lower(trim(unnest(ls))) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS ls FROM documents)), c AS (SELECT doc_id, pos, ascii(line) - pos AS island FROM l WHERE line[1] BETWEEN 'a' AND 'z'),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, island ORDER BY pos) AS run FROM c) SELECT doc_id, min(pos) AS first, count(*) AS n, chr((min(pos) + island)::INT) AS letter FROM g GROUP BY doc_id, island, run HAVING count(*) >= 2""")
def acrostic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that follow each other and begin with letters that follow each other in the alphabet."""
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("at", "line")).select("doc_id", F.col("at").cast("long").alias("at"), F.lower(F.trim("line")).alias("line"))
    rows = lines.where(F.substring("line", 1, 1).between("a", "z")).withColumn("island", F.ascii("line") - F.col("at"))
    runs = rows.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy("doc_id", "island").orderBy("at")))
    return runs.groupBy("doc_id", "island", "run").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n >= 2").select("doc_id", "first", "n", F.char(F.col("first") + F.col("island")).alias("letter"))


@query("alliteration_lines", r"""WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS t FROM (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS ls FROM documents)), w AS (SELECT doc_id, line, unnest(list_distinct(list_filter(string_split_regex(lower(t), '\s+'), lambda x: x <> ''))) AS word FROM l),
s AS (SELECT doc_id, line, word[1] AS sound, count(*) AS n FROM w GROUP BY ALL), f AS (SELECT word[1] AS sound, count(*) / (SELECT count(*) FROM w) AS share FROM w GROUP BY ALL), k AS (SELECT doc_id, line, sum(n) AS words FROM s GROUP BY ALL)
SELECT doc_id, line, sound, n, words::BIGINT AS words, round(words * share, 6) AS expected FROM s JOIN f USING (sound) JOIN k USING (doc_id, line) WHERE n >= 4 AND n >= 3 * words * share""")
def alliteration_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in which four or more unlike words begin alike, three times as many as their number lets expect."""
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("line", "t"))
    words = lines.select("doc_id", F.col("line").cast("long").alias("line"), F.explode(F.array_distinct(text.words(F.col("t")))).alias("word"))
    sounds = words.groupBy("doc_id", "line", F.substring("word", 1, 1).alias("sound")).agg(F.count("*").alias("n"))
    shares = sounds.groupBy("sound").agg(F.sum("n").alias("of_sound"))
    total = shares.agg(F.sum("of_sound").alias("total"))
    rows = sounds.withColumn("words", F.sum("n").over(Window.partitionBy("doc_id", "line"))).join(shares, "sound").crossJoin(F.broadcast(total))  # one row
    expected = F.col("words") * (F.col("of_sound") / F.col("total"))
    return rows.where((F.col("n") >= 4) & (F.col("n") >= 3 * expected)).select("doc_id", "line", "sound", "n", "words", F.round(expected, 6).alias("expected"))


@query("verbal_mirrors", r"""WITH w AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS ws FROM benchmark), t AS (SELECT item_id, unnest(ws) AS token, unnest(range(len(ws))) AS idx FROM w), p AS (SELECT item_id, token, min(idx) AS a, max(idx) AS b FROM t GROUP BY ALL HAVING count(*) = 2),
o AS (SELECT x.item_id, CASE WHEN y.b < x.b THEN 'chiastic' WHEN y.a = x.a + 1 AND y.b = x.b + 1 THEN 'bigram' ELSE 'parallel' END AS kind FROM p x JOIN p y ON x.item_id = y.item_id AND y.a > x.a AND y.a < x.b) SELECT item_id, kind, count(*) AS n FROM o GROUP BY ALL""")
def verbal_mirrors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words used exactly twice in an item, two by two: one pair within the other, crossing it, or beside it throughout."""
    rows = text.tokens(load(spark, sf_dir, "benchmark"), "item_id")
    twice = rows.groupBy("item_id", "token").agg(F.min("idx").alias("a"), F.max("idx").alias("b"), F.count("*").alias("n")).where("n = 2").select("item_id", "a", "b")
    other = twice.withColumnsRenamed({"a": "c", "b": "d"})
    kind: Column = F.when(F.col("d") < F.col("b"), "chiastic").when((F.col("c") == F.col("a") + 1) & (F.col("d") == F.col("b") + 1), "bigram").otherwise("parallel")
    return twice.join(other, "item_id").where("c > a and c < b").groupBy("item_id", kind.alias("kind")).agg(F.count("*").alias("n"))  # an item is a short text


@query("mood_split", """WITH e AS (SELECT user_id, event_id, value, row_number() OVER o AS i, count(*) OVER (PARTITION BY user_id) AS n, sum(value) OVER o AS s, sum(value) OVER (PARTITION BY user_id) AS t FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
d AS (SELECT user_id, event_id, round((t - s) / (n - i) - s / i, 6) AS shift FROM e WHERE i >= 5 AND n - i >= 5) SELECT user_id, event_id AS last_before, shift FROM d QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY abs(shift) DESC, event_id) = 1""")
def mood_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a user's values change most: the greatest difference of means after and before, five events on each side at least."""
    rows = load(spark, sf_dir, "events").where("value is not null and user_id is not null")
    order, whole = Window.partitionBy("user_id").orderBy("event_id"), Window.partitionBy("user_id")
    sums = rows.select("user_id", "event_id", F.row_number().over(order).alias("i"), F.count("*").over(whole).alias("n"), F.sum("value").over(order).alias("s"), F.sum("value").over(whole).alias("t"))
    shift = F.round((F.col("t") - F.col("s")) / (F.col("n") - F.col("i")) - F.col("s") / F.col("i"), 6)
    best = sums.where("i >= 5 and n - i >= 5").withColumn("shift", shift).groupBy("user_id").agg(F.min(F.struct((-F.abs("shift")).alias("less"), "event_id", "shift")).alias("x"))
    return best.select("user_id", F.col("x.event_id").alias("last_before"), F.col("x.shift").alias("shift"))


@query("equal_letter_values", "WITH n AS (SELECT 'n' || n_nationkey AS id, lower(n_name) AS s FROM nation UNION ALL SELECT 'r' || r_regionkey, lower(r_name) FROM region), v AS (SELECT id, list_sum(list_transform(list_filter(string_split(s, ''), lambda c: c BETWEEN 'a' AND 'z'), lambda c: ascii(c) - 96))::BIGINT AS value FROM n) SELECT value, string_agg(id, ' ' ORDER BY id) AS ids, count(*) AS n FROM v GROUP BY value HAVING count(*) > 1")
def equal_letter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of equal letter value."""
    names = load(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.lower("n_name").alias("s"))
    names = names.unionByName(load(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lower("r_name").alias("s")))
    valued = names.select("id", text.ordinal_value(F.col("s")).cast("long").alias("value"))
    return valued.groupBy("value").agg(F.array_join(F.sort_array(F.collect_list("id")), " ").alias("ids"), F.count("*").alias("n")).where("n > 1")


@query("running_totals", "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS total, datediff('day', min(o_orderdate) OVER (PARTITION BY o_custkey), o_orderdate) AS days FROM orders")
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and sums by accumulation from each customer's first order on."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.min("o_orderdate").over(Window.partitionBy("o_custkey"))
    return load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(order), 2).alias("total"), F.datediff("o_orderdate", first).cast("long").alias("days"))


@query("openings", f"WITH {SQL_TOKENS} SELECT array_to_string(ws[1:3], ' ') AS opening, count(*) AS n, count(DISTINCT source) AS sources FROM w WHERE len(ws) >= 3 GROUP BY 1 HAVING count(*) >= 2")
def openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three words that documents begin with, those of two or more."""
    docs = load(spark, sf_dir, "documents").select("source", text.words(F.col("text")).alias("ws")).where(F.size("ws") >= 3)
    return docs.groupBy(F.array_join(F.slice("ws", 1, 3), " ").alias("opening")).agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources")).where("n >= 2")
