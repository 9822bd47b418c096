"""Ranking queries: benchmark items or conversation turns ask, documents answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.catalog import query
from lorespark.functions import text as T
from lorespark.operators import retrieval as R
from lorespark.plans.base import table, view

TOK = "list_transform(list_filter(regexp_extract_all({t}, '[a-zA-Z0-9]+'), lambda x: length(x) > 1), lambda x: lower(x))"
WORDS = "list_filter(string_split_regex({t}, '\\s+'), lambda x: x <> '')"

OVERLAP_SQL = f"""
WITH q AS (SELECT item_id, list_distinct({TOK.format(t="text")}) AS q FROM benchmark),
qe AS (SELECT item_id, len(q) AS n, unnest(q) AS term FROM q), s AS (SELECT doc_id, unnest(list_distinct({TOK.format(t="text")})) AS term FROM documents),
h AS (SELECT item_id, doc_id, count(*)::DOUBLE / any_value(n) AS score FROM qe JOIN s USING (term) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM h)
SELECT item_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""


@query("overlap_topk", OVERLAP_SQL)
def overlap_topk(spark, d):
    s = R.overlap(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id", best=5)
    return R.top_k(s, ["item_id"], [F.col("score").desc(), F.col("doc_id")], 5).select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


BM25_CTE = f"""
d AS (SELECT doc_id, unnest({TOK.format(t="text")}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS f FROM d GROUP BY ALL),
z AS (SELECT doc_id, count(*) AS len FROM d GROUP BY 1), a AS (SELECT (SELECT count(*) FROM documents) AS nd, sum(len) AS al FROM z),
qe AS (SELECT item_id, unnest({TOK.format(t="text")}) AS term FROM benchmark), q AS (SELECT item_id, term, count(*) AS times FROM qe GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT item_id, doc_id, sum(times * ln((nd - df + 0.5) / (df + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len / (al / nd)))) AS score
  FROM tf JOIN q USING (term) JOIN df USING (term) JOIN z USING (doc_id), a GROUP BY 1, 2)"""


@query("bm25_topk", f"WITH {BM25_CTE}, r AS (SELECT item_id, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 4) DESC, doc_id) AS rank FROM bm) SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def bm25_topk(spark, d):
    s = R.bm25(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id", digits=4, best=10)
    return R.top_k(s, ["item_id"], [F.col("score").desc(), F.col("doc_id")], 10).select("item_id", "doc_id", "score", "rank")


HYBRID_SQL = f"""
WITH {BM25_CTE}, c AS (SELECT item_id, doc_id, round(score, 4) AS score, n_chars FROM bm JOIN documents USING (doc_id)),
n AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n,
  (rank() OVER (PARTITION BY item_id ORDER BY score) - 1 + (count(*) OVER (PARTITION BY item_id, score) - 1) / 2.0) AS r1,
  (rank() OVER (PARTITION BY item_id ORDER BY n_chars) - 1 + (count(*) OVER (PARTITION BY item_id, n_chars) - 1) / 2.0) AS r2 FROM c),
b AS (SELECT item_id, doc_id, round(0.7 * CASE WHEN n = 1 THEN 1 ELSE r1 / (n - 1) END + 0.3 * CASE WHEN n = 1 THEN 1 ELSE r2 / (n - 1) END, 9) AS score FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM b)
SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""


@query("hybrid_rank", HYBRID_SQL)
def hybrid_rank(spark, d):
    s = R.bm25_blended(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id", "n_chars", 0.7, 10, 9)
    return s.select("item_id", "doc_id", "score", "rank")


@query("rank_normalise", """
WITH r AS (SELECT c_custkey, c_nationkey, count(*) OVER (PARTITION BY c_nationkey) AS n, rank() OVER (PARTITION BY c_nationkey ORDER BY round(c_acctbal, -2)) - 1 + (count(*) OVER (PARTITION BY c_nationkey, round(c_acctbal, -2)) - 1) / 2.0 AS r FROM customer)
SELECT c_custkey, c_nationkey, round(CASE WHEN n = 1 THEN 1 ELSE r / (n - 1) END, 9) AS norm FROM r""")
def rank_normalise(spark, d):
    c = table(spark, d, "customer").withColumn("s", F.round("c_acctbal", -2))
    return R.rank_normalised(c, ["c_nationkey"], "s", "norm").select("c_custkey", "c_nationkey", F.round("norm", 9).alias("norm"))


@query("symbol_search", f"""
WITH qd AS (SELECT p_partkey, unnest({TOK.format(t="p_name || ' ' || p_type || ' ' || p_brand")}) AS term FROM part), tf AS (SELECT p_partkey, term, count(*) AS f FROM qd GROUP BY ALL),
z AS (SELECT p_partkey, count(*) AS len FROM qd GROUP BY 1), a AS (SELECT (SELECT count(*) FROM part) AS nd, sum(len) AS al FROM z), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT t AS qid, unnest({TOK.format(t="t")}) AS term FROM (SELECT DISTINCT p_name AS t FROM part)),
s AS (SELECT qid, p_partkey, round(sum(ln((nd - df + 0.5) / (df + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len / (al / nd)))), 4) AS score FROM tf JOIN q USING (term) JOIN df USING (term) JOIN z USING (p_partkey), a GROUP BY 1, 2),
n AS (SELECT qid, p_partkey, score, p_retailprice AS pr, count(*) OVER (PARTITION BY qid) AS n, rank() OVER (PARTITION BY qid ORDER BY score) - 1 + (count(*) OVER (PARTITION BY qid, score) - 1) / 2.0 AS r1, rank() OVER (PARTITION BY qid ORDER BY p_retailprice) - 1 + (count(*) OVER (PARTITION BY qid, p_retailprice) - 1) / 2.0 AS r2 FROM s JOIN part USING (p_partkey) WHERE score > 0),
b AS (SELECT qid, p_partkey, round(0.5 * CASE WHEN n = 1 THEN 1 ELSE r1 / (n - 1) END + 0.5 * CASE WHEN n = 1 THEN 1 ELSE r2 / (n - 1) END, 6) AS score FROM n)
SELECT qid, p_partkey, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, p_partkey) AS k FROM b) WHERE k <= 5""")
def symbol_search(spark, d):
    part = table(spark, d, "part")
    docs = part.select("p_partkey", "p_retailprice", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    qs = part.select(F.col("p_name").alias("qid")).distinct().withColumn("text", F.col("qid"))
    return R.bm25_blended(qs, docs, "qid", "p_partkey", "p_retailprice", 0.5, 5, 6, positive=True).select("qid", "p_partkey", "score")


@query("symbol_list", """
SELECT p_brand, p_name, p_partkey, k FROM (SELECT p_brand, p_name, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_name, p_partkey) AS INTEGER) AS k FROM part) WHERE k <= 10""")
def symbol_list(spark, d):
    return R.top_k(table(spark, d, "part"), ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_name"), F.col("p_partkey")], 10).select("p_brand", "p_name", "p_partkey", F.col("rank").alias("k"))


@query("name_lookup", """
WITH s AS (SELECT upper(p_name) AS u, max_by(p_type, p_partkey) AS body FROM part GROUP BY 1),
r AS (SELECT l_orderkey, l_linenumber, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, name, body FROM r JOIN s ON upper(name) = u""")
def name_lookup(spark, d):
    part = table(spark, d, "part")
    sections = part.select(F.lower("p_name").alias("name"), F.col("p_type").alias("body"), F.col("p_partkey").alias("sec_ord"))
    asked = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.col("p_name").alias("name"))
    return R.lookup(asked, sections).select("l_orderkey", "l_linenumber", "name", "body")


@query("keyword_match", """
WITH k AS (SELECT DISTINCT 'item ' || item_id AS kid, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')[2:3] AS k FROM benchmark UNION SELECT 'one ' || item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')[1:1] FROM benchmark),
t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents), p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM t),
h AS (SELECT kid, doc_id, count(*) AS hits FROM (SELECT *, ws[i] AS w FROM p) JOIN k ON w = k[1] WHERE ws[i : i + len(k) - 1] = k GROUP BY 1, 2)
SELECT kid AS keyword, doc_id, hits, k FROM (SELECT *, CAST(row_number() OVER (PARTITION BY kid ORDER BY hits DESC, doc_id) AS INTEGER) AS k FROM h) WHERE k <= 3""")
def keyword_match(spark, d):
    b = table(spark, d, "benchmark").withColumn("ws", F.regexp_extract_all("text", F.lit("([\\p{L}\\p{N}]+)"), 1))
    keys = b.select(F.concat(F.lit("item "), "item_id").alias("kid"), F.array_join(F.slice("ws", 2, 2), "-").alias("keyword")).unionByName(b.select(F.concat(F.lit("one "), "item_id").alias("kid"), F.col("ws")[0].alias("keyword")))
    h = R.keyword_hits(keys, table(spark, d, "documents"), "kid", "doc_id")
    return R.top_k(h, ["kid"], [F.col("hits").desc(), F.col("doc_id")], 3).select(F.col("kid").alias("keyword"), "doc_id", "hits", F.col("rank").alias("k"))


@query("cosine_topk", """
WITH s AS (SELECT a.vec_id, b.vec_id AS other, round(coalesce(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT vec_id, other, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other) AS INTEGER) AS rank FROM s) WHERE rank <= 5""")
def cosine_topk(spark, d):
    """Queries are the vectors whose id is divisible by 50, against all vectors."""
    e = table(spark, d, "embeddings")
    return R.cosine_top_k(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding", 5)


@query("word_windows", f"""
WITH w AS (SELECT doc_id, {WORDS.format(t="text")} AS w FROM documents), n AS (SELECT *, unnest(range(0, greatest(1, CAST(ceil((len(w) - 50) / 450.0) AS INT)))) AS i FROM w WHERE len(w) > 0)
SELECT doc_id, i AS chunk, array_to_string(w[i * 450 + 1 : i * 450 + 500], ' ') AS text FROM n""")
def word_windows(spark, d):
    return R.word_windows(table(spark, d, "documents"), "doc_id", "text")


@query("chunking")
def chunking(spark, d):
    """No SQL: what a chunk repeats depends on the chunk before; tests compare it with a plain version."""
    return R.chunks(table(spark, d, "documents"), "doc_id", "text")


@query("truncate_words", f"SELECT doc_id, array_to_string(({WORDS.format(t='text')})[1:100], ' ') AS head FROM documents")
def truncate_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.slice(T.words(F.col("text")), 1, 100), " ").alias("head"))


@query("minify", "SELECT page_id, trim(regexp_replace(regexp_replace(html, '>\\s+<', '><', 'g'), '\\s+', ' ', 'g')) AS minified FROM pages")
def minify(spark, d):
    t = F.regexp_replace(F.regexp_replace("html", ">\\s+<", "><"), "\\s+", " ")
    return table(spark, d, "pages").select("page_id", F.trim(t).alias("minified"))


@query("word_budget", """
WITH s AS (SELECT c_nationkey, count(*) * 1.0 AS salience FROM customer GROUP BY 1)
SELECT c_nationkey, CAST(greatest(floor(10000 * salience / sum(salience) OVER ()), 50) AS BIGINT) AS budget FROM s""")
def word_budget(spark, d):
    s = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").cast("double").alias("salience"))
    return R.proportional_budget(s, "salience", F.lit(10000), 50).select("c_nationkey", "budget")


@query("greedy_prefix", """
SELECT source, doc_id, used FROM (SELECT source, doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM documents WHERE n_chars > 0) WHERE used <= 50000""")
def greedy_prefix(spark, d):
    return R.greedy_prefix(table(spark, d, "documents"), ["source"], [F.col("n_chars").desc(), F.col("doc_id")], "n_chars", F.lit(50000)).select("source", "doc_id", "used")


@query("tail_trim", """
SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 500""")
def tail_trim(spark, d):
    c = table(spark, d, "conversations").withColumn("cost", F.length("text"))
    return R.evict(c, ["conv_id"], [F.col("turn")], "cost", 500).select("conv_id", "turn")


@query("eviction", """
SELECT user_id, event_id FROM (SELECT user_id, event_id, sum(1 + length(props)) OVER (PARTITION BY user_id ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING) AS used FROM events) WHERE used <= 400""")
def eviction(spark, d):
    e = table(spark, d, "events").withColumn("cost", 1 + F.length("props"))
    return R.evict(e, ["user_id"], [F.col("value").desc(), F.col("event_id")], "cost", 400).select("user_id", "event_id")


@query("stratified_sample", """
WITH n AS (SELECT *, count(*) OVER (PARTITION BY c_mktsegment) AS s, count(*) OVER () AS t, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(CAST(c_custkey AS VARCHAR)), c_custkey) AS k FROM customer)
SELECT c_custkey, c_mktsegment FROM n WHERE k <= greatest(2, floor(200 * (s::DOUBLE / t)))""")
def stratified_sample(spark, d):
    """A sampling operator: 200 rows in proportion to the strata, two at least of each, by hash order."""
    from pyspark.sql import Window

    c = table(spark, d, "customer")
    share = F.count("*").over(Window.partitionBy("c_mktsegment")) / F.lit(c.count())
    k = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.sha2(F.col("c_custkey").cast("string"), 256), "c_custkey"))
    return c.withColumn("share", share).withColumn("k", k).filter(F.col("k") <= F.greatest(F.lit(2), F.floor(200 * F.col("share")))).select("c_custkey", "c_mktsegment")


@query("position_priority", """
WITH s AS (SELECT p_brand, p_partkey, 0.4 * (CASE p_type WHEN 'STANDARD' THEN 1.0 WHEN 'ECONOMY' THEN 0.5 ELSE 0.25 END) + 0.3 * (CASE WHEN p_size > 25 THEN 1 ELSE 0 END) + 0.3 / (1 + p_size) AS score FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY round(score, 6) DESC, p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM s)
SELECT p_brand, p_partkey, round(score, 6) AS score, CASE WHEN k % 2 = 1 THEN (k + 1) // 2 ELSE n + 1 - k // 2 END AS place FROM r""")
def position_priority(spark, d):
    """Best rows alternate between the start and the end, the weakest meet in the middle."""
    from pyspark.sql import Window

    layer = F.when(F.col("p_type") == "STANDARD", 1.0).when(F.col("p_type") == "ECONOMY", 0.5).otherwise(0.25)
    s = table(spark, d, "part").select("p_brand", "p_partkey", F.round(0.4 * layer + 0.3 * F.when(F.col("p_size") > 25, 1).otherwise(0) + 0.3 / (1 + F.col("p_size")), 6).alias("score"))
    k = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.col("score").desc(), "p_partkey"))
    s = s.withColumn("k", k).withColumn("n", F.count("*").over(Window.partitionBy("p_brand")))
    return s.select("p_brand", "p_partkey", "score", F.when(F.col("k") % 2 == 1, F.expr("(k + 1) div 2")).otherwise(F.expr("n + 1 - k div 2")).alias("place"))
