"""Queries over text, vectors, graphs and books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numbers import rounded
from ..operators import books, graph, search, windows
from .base import PANEL, panel, query, table

TOKENS = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
DOC_TOKENS, ITEM_TOKENS = TOKENS.format("text"), TOKENS.format("text")

#: BM25 of every fiftieth benchmark item against all documents.
BM25 = f"""d AS (SELECT doc_id, {DOC_TOKENS} AS w FROM documents WHERE text IS NOT NULL), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
q AS (SELECT DISTINCT item_id AS query_id, unnest({ITEM_TOKENS}) AS term FROM benchmark WHERE item_id % 50 = 0), e AS (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM d),
tf AS (SELECT doc_id, l, term, count(*) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / mean))) AS score FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY 1, 2)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").where("text is not null")


def item_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score FROM s")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(docs(spark, sf_dir), item_queries(spark, sf_dir)).withColumn("score", rounded("score", 6))


@query(f"""WITH {BM25}, a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s QUALIFY rank <= 50),
o AS (SELECT query_id, doc_id, count(*) AS common FROM tf JOIN q USING (term) GROUP BY 1, 2), b AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY common DESC, doc_id) AS rank FROM o QUALIFY rank <= 50)
SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS fused FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2""")
def fused_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rankings of the same queries, by BM25 and by common terms, fused by reciprocal rank."""
    d, q = docs(spark, sf_dir), item_queries(spark, sf_dir)
    lexical = search.ranked(search.bm25(d, q).withColumn("score", rounded("score", 6)), "score", 50)
    wanted = q.select("query_id", F.explode(F.array_distinct(tx.tokens("text"))).alias("term"))
    common = d.select("doc_id", F.explode(F.array_distinct(tx.tokens("text"))).alias("term")).join(wanted, "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("common"))
    fused = search.reciprocal_rank_fusion([lexical, search.ranked(common, "common", 50)])
    return fused.withColumn("fused", rounded("fused", 6))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]) AS cosine FROM embeddings, q WHERE query_id <> vec_id)
SELECT query_id, vec_id, round(cosine, 6) AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM s QUALIFY rank <= 10""")
def cosine_top_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every fiftieth one."""
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = search.cosine_top_k(e.select("vec_id", F.col("embedding").alias("v")), queries, 10)
    return found.select("query_id", "vec_id", rounded("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH w AS (SELECT lang, doc_id, unnest({DOC_TOKENS}) AS term FROM documents), g AS (SELECT lang, term, count(*) AS tf, count(DISTINCT doc_id) AS docs FROM w GROUP BY 1, 2), n AS (SELECT count(*)::DOUBLE AS n FROM documents WHERE text IS NOT NULL),
f AS (SELECT term, sum(docs) AS df FROM g GROUP BY 1)
SELECT lang, term, tf, round(tf * ln(n / df), 6) AS score, row_number() OVER (PARTITION BY lang ORDER BY tf * ln(n / df) DESC, term) AS place FROM g JOIN f USING (term), n WHERE df <= 0.25 * n QUALIFY place <= 20""")
def distinctive_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = search.distinctive_terms(docs(spark, sf_dir), "lang", 0.25, 20)
    return t.select("lang", "term", "tf", rounded("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


RULES = (("symbols", "[#$%&*]{3}"), ("shout", "!!"), ("table", r"\|"), ("figure", "[0-9]{3,}"), ("mail", "@"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'symbols' END, CASE WHEN contains(text, '!!') THEN 'shout' END, CASE WHEN contains(text, '|') THEN 'table' END,
CASE WHEN regexp_matches(text, '[0-9]{3,}') THEN 'figure' END, CASE WHEN contains(text, '@') THEN 'mail' END], lambda x: x IS NOT NULL), ',') AS tags,
CASE WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'symbols' WHEN contains(text, '!!') THEN 'shout' WHEN contains(text, '|') THEN 'table' WHEN regexp_matches(text, '[0-9]{3,}') THEN 'figure' WHEN contains(text, '@') THEN 'mail' ELSE 'other' END AS category,
len(regexp_extract_all(text, '-?[0-9][0-9,]*(?:\\.[0-9]+)?')) AS n_numbers, length(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS n_chars FROM documents WHERE text IS NOT NULL""")
def document_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return d.select("doc_id", F.array_join(tx.tags("text", RULES), ",").alias("tags"), tx.category("text", RULES).alias("category"), tx.n_numbers("text").cast("long").alias("n_numbers"), F.length(tx.normalise("text")).cast("long").alias("n_chars"))


@query("""WITH t AS (SELECT conv_id, turn, role, text, lag(role) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> role THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS grp FROM t)
SELECT conv_id, grp::BIGINT AS part, min(role) AS role, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM g GROUP BY 1, 2""")
def speaker_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring turns of one speaker as one part."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = table(spark, sf_dir, "conversations").withColumn("before", F.lag("role").over(w))
    new = F.when(F.col("before").isNull() | (F.col("before") != F.col("role")), 1).otherwise(0)
    g = t.withColumn("part", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("conv_id", "part").agg(F.min("role").alias("role"), F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


@query("""WITH f AS (SELECT s.s_nationkey AS source, c.c_nationkey AS target, sum(l_extendedprice) AS v FROM lineitem JOIN supplier s ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer c ON c_custkey = o_custkey WHERE s.s_nationkey <> c.c_nationkey GROUP BY 1, 2),
e AS (SELECT source, target, v / sum(v) OVER (PARTITION BY source) AS strength, row_number() OVER (PARTITION BY source ORDER BY v DESC, target) AS k FROM f QUALIFY k <= 3) SELECT source, target, round(strength, 6) AS strength FROM e""")
def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three strongest links of each nation by what its suppliers sell to customers elsewhere."""
    return _edges(spark, sf_dir).withColumn("strength", rounded("strength", 6))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    sold = lines.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("source")), "l_suppkey")
    to = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), F.col("c_nationkey").alias("target"))
    f = sold.join(to, "l_orderkey").where("source <> target").groupBy("source", "target").agg(F.sum("l_extendedprice").alias("v"))
    share = F.col("v") / F.sum("v").over(Window.partitionBy("source"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.col("v").desc(), "target"))
    return f.select("source", "target", share.alias("strength"), place.alias("k")).where("k <= 3").drop("k")


@query("""WITH RECURSIVE f AS (SELECT s.s_nationkey AS source, c.c_nationkey AS target, sum(l_extendedprice) AS v FROM lineitem JOIN supplier s ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer c ON c_custkey = o_custkey WHERE s.s_nationkey <> c.c_nationkey GROUP BY 1, 2),
e AS (SELECT source, target, v / sum(v) OVER (PARTITION BY source) AS strength, row_number() OVER (PARTITION BY source ORDER BY v DESC, target) AS k FROM f QUALIFY k <= 3),
p AS (SELECT n_nationkey AS start, n_nationkey AS node, 0 AS hop, 1.0::DOUBLE AS effect, [n_nationkey] AS path FROM nation WHERE n_regionkey = 0
UNION ALL SELECT start, e.target, hop + 1, effect * strength, list_append(path, e.target) FROM p JOIN e ON e.source = p.node WHERE hop < 3 AND NOT list_contains(path, e.target))
SELECT start, node, hop, array_to_string(path, '>') AS path, round(effect * 1000000, 6) AS effect, round(abs(1000 * effect) * 20 / (1 + ln(1 + hop * 2.0)), 6) AS significance FROM p WHERE hop > 0 AND abs(effect) >= 0.0001 AND abs(1000 * effect) * 20 / (1 + ln(1 + hop * 2.0)) >= 0.5""")
def causal_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of three hops at most from the nations of one region, with what reaches their ends."""
    starts = table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("node"))
    paths = graph.ripples(graph.walk(_edges(spark, sf_dir), starts, 3), 1000.0, 2.0, 0.0001, 0.5)
    return paths.select("start", "node", "hop", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), rounded(F.col("effect") * 1000000, 6).alias("effect"), rounded("significance", 6).alias("significance"))


TRADES = """t AS (SELECT l_suppkey AS entity_id, CAST(l_shipdate AS DATE) AS date, l_orderkey * 10 + l_linenumber AS key, CASE WHEN l_returnflag = 'R' THEN 'S' ELSE 'B' END AS side, l_quantity AS quantity, l_extendedprice / l_quantity AS price FROM lineitem),
b AS (SELECT *, sum(quantity) OVER (PARTITION BY entity_id ORDER BY date, key ROWS UNBOUNDED PRECEDING) AS upto FROM t WHERE side = 'B'), s AS (SELECT *, sum(quantity) OVER (PARTITION BY entity_id ORDER BY date, key ROWS UNBOUNDED PRECEDING) AS upto FROM t WHERE side = 'S'),
m AS (SELECT b.entity_id, b.key AS buy_key, s.key AS sell_key, s.date AS sell_date, least(b.upto, s.upto) - greatest(b.upto - b.quantity, s.upto - s.quantity) AS quantity, s.price - b.price AS spread, s.date - b.date AS days
FROM b JOIN s ON b.entity_id = s.entity_id AND b.upto - b.quantity < s.upto AND s.upto - s.quantity < b.upto)"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("entity_id"), F.to_date("l_shipdate").alias("date"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"),
        F.when(F.col("l_returnflag") == "R", "S").otherwise("B").alias("side"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )


@query(f"WITH {TRADES} SELECT entity_id, buy_key, sell_key, quantity, round(quantity * spread, 4) AS gain, days FROM m")
def fifo_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    lots = books.fifo(trades(spark, sf_dir))
    return lots.select("entity_id", "buy_key", "sell_key", "quantity", rounded("gain", 4).alias("gain"), F.col("days").cast("long").alias("days"))


@query(f"""WITH {TRADES}, g AS (SELECT entity_id, sell_date, buy_key, sell_key, quantity * spread AS gain, days, year(sell_date + INTERVAL 9 MONTH) AS fy, CASE WHEN days > 365 THEN greatest(quantity * spread, 0) ELSE 0 END AS lg FROM m),
r AS (SELECT *, sum(lg) OVER (PARTITION BY entity_id, fy ORDER BY sell_date, sell_key, buy_key ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT entity_id, fy, count(*) AS lots, round(sum(gain), 2) AS gain, round(sum(CASE WHEN days <= 365 THEN greatest(gain, 0) * 0.2 ELSE 0 END + (greatest(run - 125000, 0) - greatest(run - lg - 125000, 0)) * 0.125), 2) AS tax FROM r GROUP BY 1, 2""")
def gains_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax by fiscal year, with a yearly exemption for long-term gains."""
    lots = books.fifo(trades(spark, sf_dir)).withColumn("key", F.struct("sell_key", "buy_key"))
    taxed = books.gains_tax(lots, 0.2, 0.125, 125000.0)
    return taxed.groupBy("entity_id", F.col("fy").cast("long").alias("fy")).agg(F.count("*").alias("lots"), rounded(F.sum("gain"), 2).alias("gain"), rounded(F.sum("tax"), 2).alias("tax"))


@query()
def flow_xirr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal rate of return of each supplier: bought lots are paid, returned ones paid back with what is left at the end."""
    t = trades(spark, sf_dir)
    sign = F.when(F.col("side") == "S", 1.0).otherwise(-0.4)
    return books.xirr(t.select("entity_id", "date", (sign * F.col("quantity") * F.col("price")).alias("amount")))


@query(f"""WITH {PANEL}, r AS (SELECT entity_id, close / lag(close) OVER (PARTITION BY entity_id ORDER BY date) - 1 AS r FROM panel)
SELECT entity_id, count(r) AS n, round(avg(r) / nullif(stddev_pop(r), 0) * sqrt(252), 4) AS sharpe, round(avg(r) / nullif(sqrt(avg(CASE WHEN r < 0 THEN r * r ELSE 0 END) FILTER (WHERE r IS NOT NULL)), 0) * sqrt(252), 4) AS sortino FROM r GROUP BY 1 HAVING count(r) >= 5""")
def risk_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = panel(spark, sf_dir).select("entity_id", (F.col("close") / F.lag("close").over(windows.by_date()) - 1).alias("r")).where("r is not null")
    down = F.sqrt(F.avg(F.when(F.col("r") < 0, F.col("r") * F.col("r")).otherwise(0.0)))
    year = 252**0.5
    a = r.groupBy("entity_id").agg(F.count("r").alias("n"), rounded(F.try_divide(F.avg("r"), F.stddev_pop("r")) * year, 4).alias("sharpe"), rounded(F.try_divide(F.avg("r"), down) * year, 4).alias("sortino"))
    return a.where("n >= 5")


@query(f"""WITH {PANEL}, m AS (SELECT entity_id, date_trunc('month', date)::DATE AS month, arg_min(close, date) AS price, min(date) AS traded FROM panel GROUP BY 1, 2), l AS (SELECT entity_id, arg_max(close, date) AS last FROM panel GROUP BY 1)
SELECT m.entity_id, count(*) AS instalments, round(sum(5000 / price), 4) AS units, round(sum(5000 / price) * any_value(last), 2) AS worth, min(traded) AS since FROM m JOIN l USING (entity_id) GROUP BY 1""")
def monthly_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed sum each month at the month's first price, and what it is worth at the last."""
    p = panel(spark, sf_dir)
    m = p.groupBy("entity_id", F.date_trunc("month", "date").alias("month")).agg(F.min_by("close", "date").alias("price"), F.min("date").alias("traded"), F.max_by("close", "date").alias("last"))
    units = F.sum(5000 / F.col("price"))
    return m.groupBy("entity_id").agg(F.count("*").alias("instalments"), rounded(units, 4).alias("units"), rounded(units * F.max_by("last", "month"), 2).alias("worth"), F.min("traded").alias("since"))
