"""Peers of customers by what and how they order, and of groups of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import peers
from .base import query, table

FAMILIES = {
    "activity": ("n_orders", "span_days"),
    "amount": ("mean_total", "max_total", "sd_total"),
    "status": ("share_f", "share_p"),
    "priority": ("share_urgent", "share_low"),
    "balance": ("acctbal",),
}
NAMES = [f for fs in FAMILIES.values() for f in fs]
_ROWS = ", ".join(f"('{f}', '{family}', {len(fs) ** -0.5!r})" for family, fs in FAMILIES.items() for f in fs)

#: Features of each customer, missing where there are too few orders to tell, and robust z-scores of them.
FEATURES = f"""o AS (SELECT o_custkey AS id, count(*)::DOUBLE AS n_orders, CASE WHEN count(*) > 1 THEN date_diff('day', min(o_orderdate), max(o_orderdate))::DOUBLE END AS span_days, avg(o_totalprice) AS mean_total, max(o_totalprice) AS max_total,
CASE WHEN count(*) > 1 THEN stddev_pop(o_totalprice) END AS sd_total, CASE WHEN count(*) > 5 THEN avg((o_orderstatus = 'F')::INT) END AS share_f, CASE WHEN count(*) > 5 THEN avg((o_orderstatus = 'P')::INT) END AS share_p,
CASE WHEN count(*) > 3 THEN avg((o_orderpriority = '1-URGENT')::INT) END AS share_urgent, CASE WHEN count(*) > 3 THEN avg((o_orderpriority = '5-LOW')::INT) END AS share_low FROM orders GROUP BY 1),
w AS (SELECT c_custkey AS id, o.* EXCLUDE (id), CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS acctbal FROM customer LEFT JOIN o ON o.id = c_custkey),
l AS (UNPIVOT w ON {', '.join(NAMES)} INTO NAME f VALUE v), fam(f, family, wt) AS (VALUES {_ROWS}),
md AS (SELECT f, median(v) AS med, stddev_pop(v) AS sd FROM l GROUP BY 1), ma AS (SELECT f, 1.4826 * median(abs(v - med)) AS mad FROM l JOIN md USING (f) GROUP BY 1),
z AS (SELECT id, f, family, wt * CASE WHEN s > 0 THEN greatest(least((v - med) / s, 3.0), -3.0) ELSE 0 END AS z FROM (SELECT l.id, l.f, family, wt, v, med, CASE WHEN mad > 0 THEN mad ELSE sd END AS s FROM l JOIN md USING (f) JOIN ma USING (f) JOIN fam USING (f))),
pr AS (SELECT a.id, b.id AS peer, floor(sum(a.z * b.z) / sqrt(greatest(sum(a.z * a.z) * sum(b.z * b.z), 1e-12)) * 1e9 + 0.5) / 1e9 AS sim, count(*) AS shared, count(DISTINCT a.family) AS families
FROM z a JOIN z b ON a.f = b.f AND a.id <> b.id WHERE a.id IN (SELECT id FROM z GROUP BY 1 HAVING count(*) >= 6) GROUP BY 1, 2 HAVING count(*) >= 5 AND count(DISTINCT a.family) >= 3)"""


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    share = lambda c, v, least: F.when(n > least, F.avg((F.col(c) == v).cast("double")))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        n.cast("double").alias("n_orders"), F.when(n > 1, F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).cast("double")).alias("span_days"),
        F.avg("o_totalprice").alias("mean_total"), F.max("o_totalprice").alias("max_total"), F.when(n > 1, F.stddev_pop("o_totalprice")).alias("sd_total"),
        share("o_orderstatus", "F", 5).alias("share_f"), share("o_orderstatus", "P", 5).alias("share_p"),
        share("o_orderpriority", "1-URGENT", 3).alias("share_urgent"), share("o_orderpriority", "5-LOW", 3).alias("share_low"),
    )
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("acctbal"))
    return peers.robust_z(c.join(o, "id", "left"), "id", FAMILIES)


@query(f"""WITH {FEATURES} SELECT id, f AS feature, round(z, 6) AS z FROM z""")
def robust_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten features of every customer by median and deviation from it, a family of features weighing as much as another."""
    long = F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("z")) for f in NAMES]))
    return _features(spark, sf_dir).select("id", long).where("z is not null").withColumn("z", rounded("z", 6))


@query(f"""WITH {FEATURES}, t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, peer) AS place FROM pr QUALIFY place <= 10)
SELECT t.id, t.peer, any_value(place)::BIGINT AS place, any_value(sim) AS similarity, any_value(shared)::BIGINT AS shared, any_value(t.families)::BIGINT AS families,
coalesce(array_to_string((list(a.f ORDER BY floor(a.z * b.z * 1e9 + 0.5) DESC, a.f) FILTER (WHERE floor(a.z * b.z * 1e9 + 0.5) > 0))[1:3], ','), '') AS drivers
FROM t JOIN z a ON a.id = t.id JOIN z b ON b.id = t.peer AND b.f = a.f GROUP BY 1, 2""")
def peer_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten peers of every customer over the features that both have, and which of them make the two alike."""
    z = _features(spark, sf_dir).persist()
    told = peers.drivers(peers.nearest(z, "id", FAMILIES, 10), z, "id", NAMES)
    return told.select(
        "id", "peer", F.col("place").cast("long").alias("place"), "similarity", F.col("shared").cast("long").alias("shared"),
        F.col("families").cast("long").alias("families"), F.array_join("drivers", ",").alias("drivers"),
    )


@query(f"WITH {FEATURES} SELECT id, count(*) AS n, round(avg(sim), 6) AS baseline FROM pr GROUP BY 1")
def peer_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike a customer is to all that it can be compared with."""
    return peers.mean_similarities(_features(spark, sf_dir).persist(), "id", FAMILIES).withColumn("baseline", rounded("baseline", 6))


@query("""WITH u AS (SELECT vec_id % 60 AS id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL), n AS (SELECT id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM u),
x AS (SELECT id, unnest(e) / n AS v, generate_subscripts(e, 1) AS i FROM n WHERE n > 0), m AS (SELECT id, i, avg(v) AS v FROM x GROUP BY 1, 2),
pr AS (SELECT a.id, b.id AS peer, floor(sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)) * 1e9 + 0.5) / 1e9 AS sim FROM m a JOIN m b ON a.i = b.i AND a.id <> b.id GROUP BY 1, 2)
SELECT id, peer, row_number() OVER (PARTITION BY id ORDER BY sim DESC, peer) AS place, sim AS similarity FROM pr WHERE sim >= 0 QUALIFY place <= 5""")
def centroid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest of sixty groups of vectors by the mean of their unit vectors."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null").select((F.col("vec_id") % 60).alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    size = e.select(F.size("e").alias("n")).first()["n"]
    unit = e.withColumn("n", F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, v: s + v * v))).where("n > 0")
    names = [f"e{i}" for i in range(size)]
    centroids = unit.groupBy("id").agg(*[F.avg(F.get("e", F.lit(i)) / F.col("n")).alias(f) for i, f in enumerate(names)])
    found = peers.nearest(centroids, "id", {"all": names}, 5, 1, 0.0, 1, 0.0)
    return found.select("id", "peer", F.col("place").cast("long").alias("place"), "similarity")
