"""Queries on contrasts, runs, graphs and results."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import stats, text
from tessella.operators import contrast, graphs, kernels, lexical, lists, runs, serving
from tessella.plans.registry import SQL_TOKENS, query
from tessella.plans.vectors import SQL_COS, knn
from tessella.sources.tables import load


def source_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", F.posexplode(text.words(F.col("text"))).alias("idx", "token"))


@query("keyness_g2", f"""WITH {SQL_TOKENS}, c AS (SELECT lang, token, count(*) AS a FROM toks GROUP BY ALL), s AS (SELECT *, sum(a) OVER (PARTITION BY lang) AS sa, sum(a) OVER (PARTITION BY token) AS k, sum(a) OVER () AS n FROM c),
e AS (SELECT lang, token, a, (sa * k / n)::DOUBLE AS e1, ((n - sa) * k / n)::DOUBLE AS e2, (k - a) AS b FROM s)
SELECT lang, token, a, round(e1, 6) AS expected, round(2 * (a * ln(a / e1) + CASE WHEN b > 0 THEN b * ln(b / e2) ELSE 0 END), 6) AS g2 FROM e WHERE a >= 5 AND a > e1""")
def keyness_g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contrast.keyness(source_tokens(spark, sf_dir), "lang", "token", 5)
    return out.select("lang", "token", "a", F.round("expected", 6).alias("expected"), F.round("g2", 6).alias("g2"))


@query("set_contrast", f"""WITH {SQL_TOKENS}, c AS (SELECT token, count(*) FILTER (lang = 'de') AS a, count(*) FILTER (lang = 'fr') AS b FROM toks WHERE lang IN ('de', 'fr') GROUP BY token), t AS (SELECT *, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM c QUALIFY a + b >= 5),
x AS (SELECT token, a, b, ta::DOUBLE AS ta, tb::DOUBLE AS tb, (a + b)::DOUBLE AS r, (ta + tb)::DOUBLE AS n FROM t)
SELECT token, a, b, round(greatest(0, 2 * (CASE WHEN a > 0 THEN a * ln(a * n / (r * ta)) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b * n / (r * tb)) ELSE 0 END + CASE WHEN ta > a THEN (ta - a) * ln((ta - a) * n / ((n - r) * ta)) ELSE 0 END + CASE WHEN tb > b THEN (tb - b) * ln((tb - b) * n / ((n - r) * tb)) ELSE 0 END)), 5) AS g2,
round(log2(((a + 0.5) / (ta + 0.5)) / ((b + 0.5) / (tb + 0.5))), 6) AS log2_ratio, CASE WHEN a * tb >= b * ta THEN 'a' ELSE 'b' END AS side FROM x""")
def set_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contrast.set_contrast(source_tokens(spark, sf_dir), F.col("lang") == "de", F.col("lang") == "fr", "token", 5)
    return out.select("token", "a", "b", F.round("g2", 5).alias("g2"), F.round("log2_ratio", 6).alias("log2_ratio"), "side")


@query("bh_q", """WITH p AS (SELECT event_id, value / (SELECT max(value) + 1 FROM events) AS p FROM events), r AS (SELECT event_id, p, p * count(*) OVER () / count(*) OVER (ORDER BY p) AS raw FROM p WHERE p IS NOT NULL)
SELECT event_id, round(least(1, min(raw) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r""")
def bh_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    most = events.agg((F.max("value") + 1).alias("most"))
    rows = events.crossJoin(F.broadcast(most)).select("event_id", (F.col("value") / F.col("most")).alias("p")).where("p is not null")  # most is one row
    return stats.with_bh_q(rows, "p").select("event_id", F.round("q", 6).alias("q"))


@query("cooccurrence_links", """WITH o AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), g AS (SELECT count(DISTINCT l_orderkey)::DOUBLE AS g FROM o), c AS (SELECT l_suppkey, count(*)::DOUBLE AS k FROM o GROUP BY ALL),
p AS (SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS n FROM o x JOIN o y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY ALL)
SELECT a, b, p.n AS n, round(ca.k * cb.k / g, 6) AS expected FROM p JOIN c ca ON ca.l_suppkey = a JOIN c cb ON cb.l_suppkey = b CROSS JOIN g WHERE p.n >= 5 AND p.n > ca.k * cb.k / g""")
def cooccurrence_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contrast.cooccurrence(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", 5)
    return out.select("a", "b", "n", F.round("expected", 6).alias("expected"))


SQL_RATES = f"""WITH {SQL_TOKENS}, top AS (SELECT token FROM toks GROUP BY token ORDER BY count(*) DESC, token LIMIT 100), s AS (SELECT source, count(*) AS size FROM toks GROUP BY ALL), n AS (SELECT source, token, count(*) AS n FROM toks SEMI JOIN top USING (token) GROUP BY ALL),
rates AS (SELECT s.source, top.token, 1000 * coalesce(n, 0) / size AS rate FROM s CROSS JOIN top LEFT JOIN n ON n.source = s.source AND n.token = top.token)"""


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source_tokens(spark, sf_dir)
    top = rows.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(100).select("token")
    return contrast.feature_rates(rows, "source", "token", top)


@query("feature_rates", SQL_RATES + " SELECT source, token, round(rate, 6) AS rate FROM rates")
def feature_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(spark, sf_dir).withColumn("rate", F.round("rate", 6))


@query("burrows_delta", SQL_RATES + """, z AS (SELECT source, token, CASE WHEN stddev_pop(rate) OVER w > 0 THEN (rate - avg(rate) OVER w) / stddev_pop(rate) OVER w ELSE 0 END AS z FROM rates WINDOW w AS (PARTITION BY token))
SELECT a.source AS a, b.source AS b, round(avg(abs(a.z - b.z)), 6) AS delta FROM z a JOIN z b ON a.token = b.token AND a.source < b.source GROUP BY ALL""")
def burrows_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contrast.burrows_delta(rates(spark, sf_dir), "source", "token").withColumn("delta", F.round("delta", 6))


@query("heaps_walk", f"""WITH {SQL_TOKENS}, f AS (SELECT token, min(doc_id) AS doc_id, count(*) AS n FROM toks GROUP BY token), d AS (SELECT doc_id, count(*) AS words FROM toks GROUP BY ALL), w2 AS (SELECT doc_id, count(*) AS new, count(*) FILTER (n = 1) AS hapax FROM f GROUP BY ALL)
SELECT doc_id, words, coalesce(new, 0) AS new, coalesce(hapax, 0) AS hapax, (sum(words) OVER (ORDER BY doc_id))::BIGINT AS end_words, (sum(coalesce(new, 0)) OVER (ORDER BY doc_id))::BIGINT AS end_kinds FROM d LEFT JOIN w2 USING (doc_id)""")
def heaps_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative words and kinds in reading order; one row a document goes through one ordered window."""
    rows = source_tokens(spark, sf_dir)
    first = rows.groupBy("token").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).groupBy("doc_id").agg(F.count("*").alias("new"), F.count(F.when(F.col("n") == 1, 1)).alias("hapax"))
    each = rows.groupBy("doc_id").agg(F.count("*").alias("words")).join(first, "doc_id", "left").fillna(0, ["new", "hapax"])
    order = Window.orderBy("doc_id")
    return each.select("doc_id", "words", "new", "hapax", F.sum("words").over(order).alias("end_words"), F.sum("new").over(order).alias("end_kinds"))


@query("runs_islands", """WITH e AS (SELECT user_id, event_id, sum(CASE WHEN event_id - prev > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events))
SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM e GROUP BY user_id, run HAVING count(*) >= 2""")
def runs_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs.islands(load(spark, sf_dir, "events"), ["user_id"], "event_id", 200)
    return rows.groupBy("user_id", "run").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count("*").alias("n")).where("n >= 2").drop("run")


@query("burst_runs", """WITH e AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS x, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS y, user_id FROM events)
SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM e GROUP BY user_id, event_type, x - y HAVING count(*) >= 3""")
def burst_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.value_runs(load(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")
    return out.where("n >= 3").select("user_id", "event_type", "first", "last", "n")


@query("moving_block_delta", """SELECT event_id, round(avg(value) OVER a - avg(value) OVER b, 6) AS shift FROM events QUALIFY count(*) OVER a = 20 AND count(*) OVER b = 20
WINDOW a AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING), b AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""".replace(" QUALIFY count(*) OVER a = 20 AND count(*) OVER b = 20\nWINDOW", " WINDOW") + " QUALIFY count(*) OVER a = 20 AND count(*) OVER b = 20")
def moving_block_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.block_contrast(load(spark, sf_dir, "events"), ["event_type"], "event_id", "value", 20)
    return out.where("shift is not null").select("event_id", F.round("shift", 6).alias("shift"))


@query("percentile_rank", """SELECT o_orderkey, round((count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2 - 0.5) / count(*) OVER (PARTITION BY o_orderpriority), 6) AS percentile FROM orders""")
def percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.percentile(load(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"]).select("o_orderkey", F.round("percentile", 6).alias("percentile"))


@query("speaker_pairs", """WITH t AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT before AS a, role AS b, count(*) AS n, count(DISTINCT conv_id) AS n_conversations FROM t WHERE before IS NOT NULL AND before <> role GROUP BY ALL""")
def speaker_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").withColumn("before", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return turns.where("before <> role").groupBy(F.col("before").alias("a"), F.col("role").alias("b")).agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_conversations"))


@query("last_word", "SELECT role, count(*) AS n FROM (SELECT conv_id, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id) GROUP BY role")
def last_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"))
    return last.groupBy("role").agg(F.count("*").alias("n"))


@query("exchanges")
def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.exchanges(load(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


@query("three_part_split", """WITH b AS (SELECT event_id // 100 AS block, count(*) FILTER (event_type = 'purchase') AS hits, count(*) AS size FROM events GROUP BY ALL), r AS (SELECT row_number() OVER (ORDER BY block) AS i, sum(hits) OVER (ORDER BY block)::DOUBLE AS h, sum(size) OVER (ORDER BY block)::DOUBLE AS s FROM b), t AS (SELECT max(i) AS n, max(h) AS th, max(s) AS ts FROM r),
p AS (SELECT x.i AS i, y.i AS j, x.h AS k1, x.s AS n1, y.h - x.h AS k2, y.s - x.s AS n2, th - y.h AS k3, ts - y.s AS n3, th, ts FROM r x JOIN r y ON y.i >= x.i + 3 AND x.i >= 3 CROSS JOIN t WHERE n - y.i >= 3),
l AS (SELECT i, j, list_sum(list_transform([[k1, n1], [k2, n2], [k3, n3]], lambda a: CASE WHEN a[1] > 0 AND a[1] < a[2] THEN a[1] * ln(a[1] / a[2]) + (a[2] - a[1]) * ln(1 - a[1] / a[2]) ELSE 0 END)) - (th * ln(th / ts) + (ts - th) * ln(1 - th / ts)) AS gain FROM p)
SELECT i, j, round(greatest(gain, 0), 6) AS gain FROM l ORDER BY round(greatest(gain, 0), 6) DESC, i, j LIMIT 1""")
def three_part_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = load(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 100).alias("block")).agg(F.count(F.when(F.col("event_type") == "purchase", 1)).alias("hits"), F.count("*").alias("size"))
    return runs.best_three_parts(hours, "block", "hits", "size", 3)


@query("auc_separation", "WITH l AS (SELECT toxic, n_chars FROM labels JOIN documents USING (doc_id)) SELECT count(*) FILTER (toxic = 1) AS n_pos, count(*) FILTER (toxic = 0) AS n_neg, round((SELECT avg(CASE WHEN a.n_chars > b.n_chars THEN 1.0 WHEN a.n_chars = b.n_chars THEN 0.5 ELSE 0.0 END) FROM l a JOIN l b ON a.toxic = 1 AND b.toxic = 0), 6) AS auc FROM l")
def auc_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").where("toxic is not null")
    return lists.auc(rows, "toxic", "n_chars").withColumn("auc", F.round("auc", 6))


@query("mutual_information", """WITH c AS (SELECT event_type AS a, user_id % 10 AS b, count(*)::DOUBLE AS n FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL), m AS (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM c)
SELECT round(sum(n / t * log2(n * t / (na * nb))), 6) AS mi_bits FROM m""")
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("tens"))
    return stats.mutual_information(rows, "event_type", "tens").withColumn("mi_bits", F.round("mi_bits", 6))


@query("cohen_kappa", """WITH l AS (SELECT toxic = 1 AS a, quality = 0 AS b FROM labels WHERE toxic IS NOT NULL AND quality IS NOT NULL), s AS (SELECT avg((a = b)::INT) AS po, avg(a::INT) * avg(b::INT) + (1 - avg(a::INT)) * (1 - avg(b::INT)) AS pe FROM l)
SELECT round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM s""")
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "labels").select((F.col("toxic") == 1).alias("a"), (F.col("quality") == 0).alias("b"))
    return stats.kappa(rows, "a", "b").select(F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query("binomial_pairs", f"""WITH {SQL_TOKENS}, t AS (SELECT doc_id, token AS a, lead(token) OVER w AS c, lead(token, 2) OVER w AS b FROM toks WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
SELECT least(a, b) AS first, greatest(a, b) AS second, count(*) AS n, count(*) FILTER (a < b) AS n_forward FROM t WHERE c IN ('and', 'und', 'et', 'y') AND b IS NOT NULL AND a <> b GROUP BY ALL HAVING count(*) >= 2""")
def binomial_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words on both sides of a conjunction, whichever comes first."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    rows = source_tokens(spark, sf_dir).select(F.col("token").alias("a"), F.lead("token").over(order).alias("c"), F.lead("token", 2).over(order).alias("b"))
    rows = rows.where(F.col("c").isin("and", "und", "et", "y") & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    return rows.groupBy(F.least("a", "b").alias("first"), F.greatest("a", "b").alias("second")).agg(F.count("*").alias("n"), F.count(F.when(F.col("a") < F.col("b"), 1)).alias("n_forward")).where("n >= 2")


@query("rare_token_pairs", f"""WITH {SQL_TOKENS}, d AS (SELECT DISTINCT doc_id, token FROM toks), r AS (SELECT token, count(*) AS df FROM d GROUP BY token HAVING count(*) BETWEEN 2 AND 15), n AS (SELECT count(*) AS n FROM documents), p AS (SELECT doc_id, token, ln(n.n / df) AS idf FROM d JOIN r USING (token), n)
SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_shared, round(sum(a.idf), 6) AS score FROM p a JOIN p b ON a.token = b.token AND a.doc_id < b.doc_id GROUP BY ALL HAVING count(*) >= 3""")
def rare_token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share at least three rare tokens; a rare token is in fifteen documents at most (the feature's own bound), so it makes 105 pairs at most."""
    docs = load(spark, sf_dir, "documents")
    rows = text.tokens(docs).select("doc_id", "token").distinct()
    n = docs.agg(F.count("*").alias("n"))
    keys = lexical.rare_keys(rows, 2, 15).crossJoin(F.broadcast(n)).select("token", F.log(F.col("n") / F.col("df")).alias("idf"))  # n is one row
    groups = rows.join(keys, "token").groupBy("token", "idf").agg(F.sort_array(F.collect_list("doc_id")).alias("docs"))
    pairs = groups.select("idf", "docs", F.explode("docs").alias("a")).select("idf", "a", F.explode("docs").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n_shared"), F.round(F.sum("idf"), 6).alias("score")).where("n_shared >= 3")


@query("neighbour_window_pairs", f"""WITH {SQL_TOKENS}
SELECT least(a.token, b.token) AS x, greatest(a.token, b.token) AS y, count(*) AS n FROM toks a JOIN toks b ON a.doc_id = b.doc_id AND b.idx > a.idx AND b.idx <= a.idx + 3 AND a.token <> b.token GROUP BY ALL HAVING count(*) >= 2""")
def neighbour_window_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of unlike tokens at most three words apart, by looking ahead in each document's words; frequent ones are added up before they move."""
    docs = load(spark, sf_dir, "documents").select(text.words(F.col("text")).alias("ws"))
    pairs = None
    for ahead in (1, 2, 3):
        both = docs.select(F.explode(F.arrays_zip(F.col("ws").alias("a"), F.slice("ws", F.lit(1 + ahead), F.greatest(F.size("ws") - ahead, F.lit(0))).alias("b"))).alias("p")).select("p.a", "p.b")
        both = both.where(F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        pairs = both if pairs is None else pairs.unionByName(both)
    return pairs.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.count("*").alias("n")).where("n >= 2")


@query("edit1_neighbours", f"""WITH {SQL_TOKENS}, v AS (SELECT DISTINCT token FROM toks WHERE len(token) >= 3), m AS (SELECT token, unnest(list_transform(range(1, len(token) + 1), lambda i: i::VARCHAR || token[1:i - 1] || '*' || token[i + 1:])) AS mask FROM v),
t AS (SELECT token, unnest(list_transform(range(1, len(token)), lambda i: i::VARCHAR || token[1:i - 1] || least(token[i], token[i + 1]) || greatest(token[i], token[i + 1]) || token[i + 2:])) AS swap FROM v),
d AS (SELECT DISTINCT token, unnest(list_transform(range(1, len(token) + 1), lambda i: token[1:i - 1] || token[i + 1:])) AS less FROM v)
SELECT DISTINCT a.token AS a, b.token AS b, 'substitution' AS kind FROM m a JOIN m b ON a.mask = b.mask AND a.token < b.token
UNION ALL SELECT DISTINCT a.token, b.token, 'metathesis' FROM t a JOIN t b ON a.swap = b.swap AND a.token < b.token
UNION ALL SELECT least(d.token, v.token), greatest(d.token, v.token), 'extension' FROM d JOIN v ON v.token = d.less""")
def edit1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of three letters or more that differ in one letter, in the order of two neighbours, or by one letter more; met through keys, never all with all."""
    words = text.tokens(load(spark, sf_dir, "documents")).select("token").distinct().where(F.char_length("token") >= 3)
    n, letter = F.char_length("token"), lambda i: F.substring(F.col("token"), i, F.lit(1))
    before, after = lambda i: F.substring(F.col("token"), F.lit(1), i - 1), lambda i: F.substring(F.col("token"), i, n)
    masks = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("s"), i.cast("string"), before(i), F.lit("*"), after(i + 1)))
    swaps = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.lit("t"), i.cast("string"), before(i), F.least(letter(i), letter(i + 1)), F.greatest(letter(i), letter(i + 1)), after(i + 2)))
    keys = words.select("token", F.explode(F.concat(masks, swaps)).alias("key"))
    kind = F.when(F.col("key").startswith("s"), "substitution").otherwise("metathesis")
    same = keys.join(keys.toDF("other", "key"), "key").where("token < other").select(F.col("token").alias("a"), F.col("other").alias("b"), kind.alias("kind")).distinct()
    less = words.select(F.col("token").alias("long"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(before(i), after(i + 1))))).alias("token"))
    more = less.join(words, "token").select(F.least("long", "token").alias("a"), F.greatest("long", "token").alias("b"), F.lit("extension").alias("kind"))
    return same.unionByName(more)


@query("pattern_search", f"""WITH {SQL_TOKENS}, t AS (SELECT doc_id, idx, token AS a, lead(token) OVER w AS b, lead(token, 2) OVER w AS c FROM toks WINDOW w AS (PARTITION BY doc_id ORDER BY idx)) SELECT doc_id, idx, b AS middle FROM t WHERE a = 'the' AND c = 'of'""")
def pattern_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed pattern: "the", any word, "of"."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    rows = source_tokens(spark, sf_dir).withColumns({"b": F.lead("token").over(order), "c": F.lead("token", 2).over(order)})
    return rows.where("token = 'the' and c = 'of'").select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("b").alias("middle"))


@query("link_expand_positional", """WITH l AS (SELECT event_id AS a, event_id + user_id % 4 AS a_end, event_id + 50 AS b, event_id + 50 + (user_id // 4) % 4 AS b_end FROM events WHERE event_id % 10 = 0),
o AS (SELECT a + i AS src, b + i AS tgt, 'positional' AS rule FROM (SELECT a, b, unnest(range(a_end - a + 1)) AS i FROM l WHERE a_end - a = b_end - b) UNION ALL SELECT src, unnest(range(b, b_end + 1)), 'cartesian' FROM (SELECT unnest(range(a, a_end + 1)) AS src, b, b_end FROM l WHERE a_end - a <> b_end - b AND a_end - a < 3 AND b_end - b < 3))
SELECT src, tgt, max(rule) AS rule FROM (SELECT * FROM o UNION ALL SELECT tgt, src, rule FROM o) WHERE src <> tgt GROUP BY ALL""".replace(" WHERE event_id % 10 = 0", ""))
def link_expand_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    ranges = load(spark, sf_dir, "events").select(e.alias("a"), (e + F.col("user_id") % 4).alias("a_end"), (e + 50).alias("b"), (e + 50 + F.floor(F.col("user_id") / 4) % 4).alias("b_end"))
    return serving.expand_ranges(ranges)


@query("split_assign", """WITH s AS (SELECT DISTINCT source, CASE WHEN source IN ('src0', 'src1') THEN 'test' WHEN source IN ('src2', 'src3') THEN 'dev' ELSE 'train' END AS split FROM documents WHERE source IS NOT NULL)
SELECT a.source AS a, b.source AS b, CASE WHEN 'test' IN (a.split, b.split) THEN 'test' WHEN 'dev' IN (a.split, b.split) THEN 'dev' ELSE 'train' END AS split FROM s a JOIN s b ON a.source < b.source""")
def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of a pair of sources: the stricter one of the two."""
    s = load(spark, sf_dir, "documents").where("source is not null").select("source").distinct()
    s = s.withColumn("split", F.when(F.col("source").isin("src0", "src1"), "test").when(F.col("source").isin("src2", "src3"), "dev").otherwise("train"))
    return s.toDF("a", "x").join(s.toDF("b", "y"), F.col("a") < F.col("b")).select("a", "b", serving.pair_split(F.col("x"), F.col("y")).alias("split"))  # sources are few


@query("paginate_with_total", "SELECT l_orderkey, l_linenumber, l_extendedprice, (SELECT count(*) FROM lineitem) AS total FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50 OFFSET 100")
def paginate_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem")
    total = rows.agg(F.count("*").alias("total"))
    keys = serving.page(rows.select("l_orderkey", "l_linenumber", "l_extendedprice"), [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 50, 100)
    return keys.crossJoin(total)  # one row


@query("examples_per_group", "SELECT l_shipmode_flag, l_orderkey, l_linenumber, nth FROM (SELECT l_returnflag || l_linestatus AS l_shipmode_flag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS nth FROM lineitem) WHERE nth <= 5")
def examples_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").withColumn("l_shipmode_flag", F.concat("l_returnflag", "l_linestatus"))
    return serving.examples(rows, ["l_shipmode_flag"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 5).select("l_shipmode_flag", "l_orderkey", "l_linenumber", "nth")


@query("having_shares", "SELECT l_suppkey, count(*) AS n, round(count(*) FILTER (l_returnflag = 'R') / count(*), 6) AS share FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 10")
def having_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.avg((F.col("l_returnflag") == "R").cast("double")), 6).alias("share")).where("n >= 10")


@query("rollup_shares", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


SQL_NEW = "new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0), old AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0)"


def builds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two builds of one table that differ: the feature is their comparison."""
    rows, key = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), F.col("o_orderkey")
    new = rows.where(key % 7 != 0).withColumn("o_totalprice", F.when(key % 11 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).withColumn("o_orderstatus", F.when(key % 13 == 0, "X").otherwise(F.col("o_orderstatus")))
    return rows.where(key % 5 != 0), new


@query("build_compare", f"""WITH {SQL_NEW} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed' ELSE array_to_string(list_filter([CASE WHEN abs(o.o_totalprice - n.o_totalprice) > 0.001 THEN 'o_totalprice' END, CASE WHEN o.o_orderstatus <> n.o_orderstatus THEN 'o_orderstatus' END], lambda x: x IS NOT NULL), ',') END AS change
FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey WHERE change <> ''""")
def build_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.compare_builds(*builds(spark, sf_dir), ["o_orderkey"], ["o_totalprice", "o_orderstatus"], 0.001)


@query("multiset_diff", f"WITH {SQL_NEW} SELECT o_orderstatus, sum(s)::BIGINT AS more FROM (SELECT o_orderstatus, 1 AS s FROM new UNION ALL SELECT o_orderstatus, -1 FROM old) GROUP BY ALL HAVING sum(s) <> 0")
def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.multiset_difference(*(x.select("o_orderstatus") for x in builds(spark, sf_dir)))


@query("recursive_closure", """WITH RECURSIVE p AS (SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey // 3 > 0), a AS (SELECT child, parent AS ancestor, 1 AS depth FROM p UNION ALL SELECT a.child, p.parent, depth + 1 FROM a JOIN p ON p.child = a.ancestor) SELECT child, ancestor, depth FROM a""")
def recursive_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return graphs.ancestors(load(spark, sf_dir, "part").select(key.alias("child"), F.floor(key / 3).alias("parent")).where("parent > 0"))


SQL_EDGES = SQL_COS + ", e AS (SELECT DISTINCT least(src, tgt) AS a, greatest(src, tgt) AS b FROM knn WHERE rank <= 5)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.pair_weights(knn(spark, sf_dir), 5)


@query("neighbourhood_two_hop", f"WITH {SQL_EDGES}, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e) SELECT id, other, min(steps)::INT AS steps FROM (SELECT a AS id, b AS other, 1 AS steps FROM u UNION ALL SELECT x.a, y.b, 2 FROM u x JOIN u y ON x.b = y.a WHERE x.a <> y.b) GROUP BY ALL")
def neighbourhood_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.two_steps(edges(spark, sf_dir))


@query("pagerank")
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.page_rank(edges(spark, sf_dir)).select("id", F.round("rank", 9).alias("rank"))


@query("communities")
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.communities(edges(spark, sf_dir))


@query("pages_clean", r"""WITH a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<(script|style|title)[^>]*>.*?</(script|style|title)>', ' ', 'g') AS t FROM pages), b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS text FROM b""")
def pages_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", text.without_markup(F.col("html")).alias("text"))


@query("letter_values", """WITH n AS (SELECT n_nationkey, lower(n_name) AS s FROM nation) SELECT n_nationkey, list_sum(list_transform(list_filter(string_split(s, ''), lambda c: c BETWEEN 'a' AND 'z'), lambda c: ascii(c) - 96))::BIGINT AS ordinal, list_sum(list_transform(list_filter(string_split(s, ''), lambda c: c BETWEEN 'a' AND 'z'), lambda c: (ascii(c) - 97) % 9 + 1))::BIGINT AS reduced,
translate(s, 'abcdefghijklmnopqrstuvwxyz', 'zyxwvutsrqponmlkjihgfedcba') AS mirror, translate(s, 'abcdefghijklmnopqrstuvwxyz', 'nopqrstuvwxyzabcdefghijklm') AS half_shift FROM n""")
def letter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower("n_name")
    return load(spark, sf_dir, "nation").select("n_nationkey", text.ordinal_value(name).cast("long").alias("ordinal"), text.reduced_value(name).cast("long").alias("reduced"), text.mirror_cipher(name).alias("mirror"), text.half_shift_cipher(name).alias("half_shift"))


@query("haversine_steps", """WITH p AS (SELECT event_id, user_id, (event_id * 37 % 180) - 90.0 AS lat, (event_id * 91 % 360) - 180.0 AS lon FROM events), s AS (SELECT event_id, lat, lon, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, round(2 * 6371 * asin(sqrt(least(1, power(sin((radians(lat) - radians(lat0)) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * power(sin(radians(lon - lon0) / 2), 2)))), 3) AS km FROM s WHERE lat0 IS NOT NULL""")
def haversine_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from one place of a user to the next, of coordinates made from ids."""
    e = F.col("event_id")
    places = load(spark, sf_dir, "events").select(e, "user_id", (e * 37 % 180 - 90.0).alias("lat"), (e * 91 % 360 - 180.0).alias("lon"))
    order = Window.partitionBy("user_id").orderBy("event_id")
    rows = places.withColumns({"lat0": F.lag("lat").over(order), "lon0": F.lag("lon").over(order)}).where("lat0 is not null")
    return rows.select("event_id", F.round(serving.kilometres(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")), 3).alias("km"))


ALIGNED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64()), ("n_tokens", pa.int64()), ("words", pa.list_(pa.string()))])


def _align(batches):
    for batch in batches:
        out = {f.name: [] for f in ALIGNED}
        for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y")), strict=True):
            score, places = kernels.local_alignment(x, y)
            if len(places) >= 3:
                for name, v in zip(out, (a, b, score, len(places), [x[i] for i, _ in places]), strict=True):
                    out[name].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=ALIGNED)


@query("shared_phrases")
def shared_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best local alignment of every benchmark item with each of its ten best documents."""
    from tessella.plans.retrieval import topk_bm25

    best = topk_bm25(spark, sf_dir).where("rank <= 10").select(F.col("query_id").alias("a"), F.col("doc_id").alias("b"))
    x = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("a"), text.words(F.col("text")).alias("x"))
    y = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("b"), text.words(F.col("text")).alias("y"))
    pairs = best.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return pairs.mapInArrow(_align, "a long, b long, score double, n_tokens long, words array<string>")


CHANGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("op", pa.string()), ("n", pa.int64())])


def _differ(batches):
    for batch in batches:
        out = {f.name: [] for f in CHANGES}
        for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y")), strict=True):
            ops = [op for op, _, _ in kernels.word_operations(x, y)]
            for op in sorted(set(ops)):
                for name, v in zip(out, (a, b, op, ops.count(op)), strict=True):
                    out[name].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=CHANGES)


@query("word_diffs")
def word_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word by word operations between conversation turns of one role that follow each other."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.words(F.col("text")).alias("y"))
    order = Window.partitionBy("conv_id", "role").orderBy("turn")
    pairs = turns.withColumn("x", F.lag("y").over(order)).where("x is not null").select(F.col("conv_id").alias("a"), F.col("turn").alias("b"), "x", "y")
    return pairs.mapInArrow(_differ, "a long, b long, op string, n long")
