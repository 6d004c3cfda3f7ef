"""Trees, beams and clusters of what shares keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numbers import rounded
from ..operators import graph, similarity
from .base import query, table


@query("""WITH RECURSIVE n AS (SELECT c_custkey AS node, CASE WHEN c_custkey >= 5 THEN c_custkey // 5 END AS parent, c_acctbal AS magnitude, 0.4 + (abs(c_acctbal) % 500) / 1000 AS probability, (1 + c_custkey % 6)::DOUBLE AS lag, CASE WHEN c_custkey % 7 > 0 THEN 0.5 + (c_custkey % 7) / 7.0 END AS elasticity FROM customer),
b AS (SELECT node, node AS root, 1 AS level, probability AS chance, lag AS delay, magnitude * probability * coalesce(elasticity, 1) AS effect FROM n WHERE parent IS NULL
UNION ALL SELECT n.node, b.root, b.level + 1, b.chance * n.probability, b.delay + n.lag, n.magnitude * b.chance * n.probability * coalesce(n.elasticity, 1) FROM n JOIN b ON n.parent = b.node WHERE b.level < 6)
SELECT node, root, level::BIGINT AS level, round(chance, 6) AS chance, delay, round(effect, 4) AS effect, round(abs(effect) * 20 / (1 + ln(1 + delay)), 4) AS significance FROM b""")
def ripple_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of customers, five below each, followed six levels down by one recursive query."""
    c = F.col("c_custkey")
    nodes = table(spark, sf_dir, "customer").select(
        c.alias("node"), F.when(c >= 5, F.floor(c / 5)).cast("long").alias("parent"), F.col("c_acctbal").alias("magnitude"),
        (0.4 + F.abs("c_acctbal") % 500 / 1000).alias("probability"), (1 + c % 6).cast("double").alias("lag"), F.when(c % 7 > 0, 0.5 + c % 7 / 7).alias("elasticity"),
    )
    t = graph.tree(nodes, 6)
    return t.select("node", "root", F.col("level").cast("long").alias("level"), rounded("chance", 6).alias("chance"), "delay", rounded("effect", 4).alias("effect"), rounded("significance", 4).alias("significance"))


def _hops(n: int, width: int) -> str:
    steps = ["b0 AS (SELECT DISTINCT source AS start, source AS node, 1.0::DOUBLE AS score FROM e WHERE source[1] = 's')"]
    for h in range(1, n + 1):
        steps.append(
            f"b{h} AS (SELECT start, node, score, row_number() OVER (PARTITION BY start ORDER BY floor(score * 1e15 + 0.5) DESC, node) AS place FROM (SELECT start, target AS node, sum(score * strength) AS score FROM b{h - 1} JOIN e ON source = node GROUP BY 1, 2) QUALIFY place <= {width})"
        )
    return ", ".join(steps)


#: Characters of a key, in order: as digits of base 12 from 1 on, so many of them as a long holds beside the kind.
KEY, DIGITS, LENGTH = "-0123456789", "123456789ab", 17


def _place(kind: str, key: Column) -> Column:
    """A long that stands in order where the name of a node does: parts (p) before suppliers (s), then by the text of the key. No key is cut."""
    text = key.cast("string")
    fits = F.when(F.length(text) <= LENGTH, text).otherwise(F.when(text.isNotNull(), F.raise_error(F.lit(f"a key of more than {LENGTH} characters"))))
    return F.conv(F.rpad(F.translate(fits, KEY, DIGITS), LENGTH, "0"), 12, 10).cast("long") - F.lit(12**LENGTH if kind == "p" else 0)


def _name(place: Column) -> Column:
    """The name of the node at such a place."""
    digits = F.conv(F.when(place < 0, place + 12**LENGTH).otherwise(place).cast("string"), 10, 12)
    return F.concat(F.when(place < 0, "p").otherwise("s"), F.translate(F.rtrim(F.lower(digits), F.lit("0")), DIGITS, KEY))


@query(f"""WITH v AS (SELECT 's' || l_suppkey AS s, 'p' || l_partkey AS p, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2),
e AS (SELECT s AS source, p AS target, v / sum(v) OVER (PARTITION BY s) AS strength FROM v UNION ALL SELECT p, s, v / sum(v) OVER (PARTITION BY p) FROM v), {_hops(4, 5)}
SELECT start, hop, node, round(score * 1000000, 6) AS score, place FROM ({' UNION ALL '.join(f'SELECT start, {h}::BIGINT AS hop, node, score, place FROM b{h}' for h in range(1, 5))})""")
def beam_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every supplier to parts and on to suppliers, four hops, of which the five best nodes each go on.

    A node is a number that stands where its name does in order, as the walk groups and sorts many rows by nodes.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_extendedprice").alias("v"))
    v = graph.staged(lines.select(_place("s", F.col("l_suppkey")).alias("s"), _place("p", F.col("l_partkey")).alias("p"), "v"))

    def shares(a: str, b: str) -> DataFrame:
        whole = v.groupBy(a).agg(F.sum("v").alias("all"))
        return v.join(whole, a).select(F.col(a).alias("source"), F.col(b).alias("target"), (F.col("v") / F.col("all")).alias("strength"))

    found = graph.beam(shares("s", "p").unionAll(shares("p", "s")), v.select(F.col("s").alias("node")).distinct(), 4, 5)
    return found.select(
        _name(F.col("start")).alias("start"), F.col("hop").cast("long").alias("hop"), _name(F.col("node")).alias("node"),
        rounded(F.col("score") * 1000000, 6).alias("score"), F.col("place").cast("long").alias("place"),
    )


STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
CLAIMS = f"""p AS (SELECT page_id, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '://([^/?#]*)', 1) AS source FROM pages WHERE html IS NOT NULL),
k AS (SELECT page_id, lang, unnest(list_distinct(list_filter(string_split_regex(lower(title), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 4 AND x NOT IN ({STOP})))) AS word FROM p),
e AS (SELECT a.page_id AS a, b.page_id AS b, count(*) AS common FROM k a JOIN k b ON a.lang = b.lang AND a.word = b.word AND a.page_id < b.page_id GROUP BY 1, 2 HAVING count(*) >= 2)"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where("html is not null").select(
        F.col("page_id").alias("id"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("grp"),
        tx.keywords(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("members"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("source"),
    )


@query(f"WITH {CLAIMS} SELECT a, b, common FROM e")
def shared_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a language whose titles share two keywords or more."""
    return similarity.similar_sets(_claims(spark, sf_dir).select("id", "grp", "members"), overlap=2)


@query(f"""WITH RECURSIVE {CLAIMS}, ab AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), c AS (SELECT DISTINCT a, a AS r FROM ab UNION SELECT ab.b, c.r FROM c JOIN ab ON ab.a = c.a),
g AS (SELECT page_id, coalesce(min(r), page_id) AS claim, any_value(source) AS source FROM p LEFT JOIN c ON c.a = page_id GROUP BY page_id)
SELECT claim, count(*) AS n_pages, count(DISTINCT source) AS n_sources, CASE WHEN count(DISTINCT source) >= 2 THEN 'CONFIRMED' ELSE 'UNCONFIRMED' END AS status FROM g GROUP BY 1""")
def corroborated_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of pages that share keywords, and whether two hosts or more stand behind them."""
    claims = _claims(spark, sf_dir)
    links = similarity.similar_sets(claims.select("id", "grp", "members"), overlap=2, forest=True)
    cluster = graph.components(links).select(F.col("node").alias("id"), "component")
    whole = claims.select("id", "source").join(cluster, "id", "left").withColumn("claim", F.coalesce("component", "id"))
    counted = whole.groupBy("claim").agg(F.count("*").alias("n_pages"), F.countDistinct("source").alias("n_sources"))
    return counted.withColumn("status", F.when(F.col("n_sources") >= 2, "CONFIRMED").otherwise("UNCONFIRMED"))
