"""Screens of all parts against drivers by lagged correlation, and what chance alone would give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import matrix
from ..operators.graph import staged
from .base import query, table

LAGS, DRAWS, SEED = 10, 20, 7

#: Months since the first one; z-scores of each part's monthly turnover, and of each driver's monthly total.
SERIES = """span AS (SELECT min(m) AS m0, max(m) - min(m) + 1 AS np FROM (SELECT year(l_shipdate) * 12 + month(l_shipdate) AS m FROM lineitem UNION ALL SELECT year(o_orderdate) * 12 + month(o_orderdate) FROM orders)),
a0 AS (SELECT l_partkey AS key, year(l_shipdate) * 12 + month(l_shipdate) - (SELECT m0 FROM span) AS t, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2),
a AS (SELECT key, t, (v - m) / s AS v FROM a0 JOIN (SELECT key, avg(v) AS m, stddev_pop(v) AS s FROM a0 GROUP BY 1) USING (key) WHERE s > 0),
d0 AS (SELECT o_orderpriority AS key, year(o_orderdate) * 12 + month(o_orderdate) - (SELECT m0 FROM span) AS t, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2
UNION ALL SELECT 'status ' || o_orderstatus, year(o_orderdate) * 12 + month(o_orderdate) - (SELECT m0 FROM span), sum(o_totalprice) FROM orders GROUP BY 1, 2),
d AS (SELECT key, t, (v - m) / s AS v FROM d0 JOIN (SELECT key, avg(v) AS m, stddev_pop(v) AS s FROM d0 GROUP BY 1) USING (key) WHERE s > 0),
lags AS (SELECT unnest(range(10)) AS lag), months AS (SELECT unnest(range((SELECT np FROM span)::BIGINT)) AS t)"""

#: Correlations of any dense grid (key, t, v) with the drivers.
CORRELATED = """own AS (SELECT key, lag, sum(v) AS x, sum(v * v) AS xx FROM {grid} JOIN lags ON t >= lag GROUP BY 1, 2),
oth AS (SELECT key AS driver, lag, sum(CASE WHEN t < np - lag THEN v ELSE 0 END) AS y, sum(CASE WHEN t < np - lag THEN v * v ELSE 0 END) AS yy FROM d, lags, span GROUP BY 1, 2),
pr AS (SELECT g.key, d.key AS driver, lag, sum(g.v * d.v) AS xy FROM {grid} g JOIN lags ON g.t >= lag JOIN d ON d.t = g.t - lag GROUP BY 1, 2, 3),
al AS (SELECT own.key, oth.driver, own.lag, (np - own.lag)::BIGINT AS n, x, xx, y, yy, coalesce(xy, 0) AS xy FROM own JOIN oth USING (lag) LEFT JOIN pr ON pr.key = own.key AND pr.driver = oth.driver AND pr.lag = own.lag, span),
r AS (SELECT key, driver, lag, n, CASE WHEN xx - x * x / n > 1e-12 AND yy - y * y / n > 1e-12 THEN (xy - x * y / n) / sqrt((xx - x * x / n) * (yy - y * y / n)) END AS r FROM al)"""


def _series(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    month = lambda c: F.year(c) * 12 + F.month(c)
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    months = lines.select(month("l_shipdate").alias("m")).unionAll(orders.select(month("o_orderdate")))
    ends = months.agg(F.min("m").alias("a"), F.max("m").alias("b")).first()
    # shuffled once: sums, moments and blocks of a part are all made in its partition
    by_part = matrix.dealt(lines.select(F.col("l_partkey").alias("key"), (month("l_shipdate") - ends["a"]).alias("t"), "l_extendedprice"), "key")
    left = by_part.groupBy("sb", "key", "t").agg(F.sum("l_extendedprice").alias("value"))
    kind = F.explode(F.array("o_orderpriority", F.concat(F.lit("status "), "o_orderstatus")))
    right = orders.select(kind.alias("key"), (month("o_orderdate") - ends["a"]).alias("t"), "o_totalprice").groupBy("key", "t").agg(F.sum("o_totalprice").alias("value"))
    # the drivers are a few rows a month and read several times
    return matrix.standardised(left, "key", "value"), staged(matrix.standardised(right, "key", "value")), ends["b"] - ends["a"] + 1


def _shown(r: DataFrame) -> DataFrame:
    return r.select(F.col("key").alias("entity_id"), F.col("other").alias("driver"), F.col("lag").cast("long").alias("lag"), F.col("n").cast("long").alias("n"), rounded("r", 6).alias("r"))


@query(f"WITH {SERIES}, {CORRELATED.format(grid='a')} SELECT key AS entity_id, driver, lag, n, round(r, 6) AS r FROM r")
def lagged_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part against every driver at ten lags."""
    left, right, periods = _series(spark, sf_dir)
    return _shown(matrix.lagged_correlations(left, right, LAGS, periods))


@query(f"""WITH {SERIES}, f AS (SELECT t, coalesce(max(v) FILTER (WHERE d.key = 'status F'), 0) AS f, coalesce(max(v) FILTER (WHERE d.key = 'status O'), 0) AS g FROM months LEFT JOIN d USING (t) GROUP BY t),
z AS (SELECT t, (f - (SELECT avg(f) FROM f)) / (SELECT stddev_pop(f) FROM f) AS f, (g - (SELECT avg(g) FROM f)) / (SELECT stddev_pop(g) FROM f) AS g FROM f),
gm AS (SELECT sum(f * f) + 0.001 AS ff, sum(f * g) AS fg, sum(g * g) + 0.001 AS gg FROM z), c AS (SELECT key, sum(v * f) AS vf, sum(v * g) AS vg FROM a JOIN z USING (t) GROUP BY 1),
b AS (SELECT key, (gg * vf - fg * vg) / (ff * gg - fg * fg) AS b, (ff * vg - fg * vf) / (ff * gg - fg * fg) AS c FROM c, gm),
e AS (SELECT b.key, z.t, coalesce(a.v, 0) - b.b * z.f - b.c * z.g AS v FROM b CROSS JOIN z LEFT JOIN a ON a.key = b.key AND a.t = z.t),
{CORRELATED.format(grid='e')} SELECT key AS entity_id, driver, lag, n, round(r, 6) AS r FROM r""")
def residual_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after a ridge regression on two common factors."""
    left, right, periods = _series(spark, sf_dir)
    return _shown(matrix.lagged_correlations(left, right, LAGS, periods, ["status F", "status O"]))


@query(f"""WITH {SERIES}, dr AS (SELECT draw, 1 + ('0x' || substr(md5('7:' || draw), 1, 8))::BIGINT % (np - 1) AS shift FROM (SELECT unnest(range(20)) AS draw), span),
own AS (SELECT key, sum(v) AS x, sum(v * v) AS xx FROM a GROUP BY 1), oth AS (SELECT key AS driver, sum(v) AS y, sum(v * v) AS yy FROM d GROUP BY 1),
pr AS (SELECT draw, a.key, d.key AS driver, sum(a.v * d.v) AS xy FROM dr, span, d JOIN a ON a.t = (d.t + shift) % np GROUP BY 1, 2, 3),
r AS (SELECT draw, CASE WHEN xx - x * x / np > 1e-12 AND yy - y * y / np > 1e-12 THEN (coalesce(xy, 0) - x * y / np) / sqrt((xx - x * x / np) * (yy - y * y / np)) END AS r
FROM dr CROSS JOIN own CROSS JOIN oth CROSS JOIN span LEFT JOIN pr USING (draw, key, driver)) SELECT draw, round(max(abs(r)), 6) AS most FROM r GROUP BY 1""")
def screen_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest correlation of any pair when the drivers are shifted in time together, twenty times."""
    left, right, periods = _series(spark, sf_dir)
    return matrix.shift_null(left, right, periods, DRAWS, SEED).withColumn("most", rounded("most", 6))


@query(f"""WITH {SERIES}, bl AS (SELECT draw, block, ('0x' || substr(md5('7:' || draw || ':' || block), 1, 8))::BIGINT % np AS first FROM (SELECT unnest(range(20)) AS draw), (SELECT unnest(range(((SELECT np FROM span)::BIGINT + 5) // 6)) AS block), span),
tk AS (SELECT draw, (first + k) % np AS t FROM bl, (SELECT unnest(range(6)) AS k), span WHERE block * 6 + k < np), w AS (SELECT draw, t, count(*) AS w FROM tk GROUP BY 1, 2)
SELECT draw, key AS driver, round(sum(v * w) / any_value(np), 6) AS mean FROM d0 JOIN w USING (t), span GROUP BY 1, 2""")
def driver_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean monthly totals of the drivers over twenty resamples of blocks of six months."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    month = lambda c: F.year(c) * 12 + F.month(c)
    ends = lines.select(month("l_shipdate").alias("m")).unionAll(orders.select(month("o_orderdate"))).agg(F.min("m").alias("a"), F.max("m").alias("b")).first()
    kind = F.explode(F.array("o_orderpriority", F.concat(F.lit("status "), "o_orderstatus")))
    totals = orders.select(kind.alias("key"), (month("o_orderdate") - ends["a"]).alias("t"), "o_totalprice").groupBy("key", "t").agg(F.sum("o_totalprice").alias("value"))
    found = matrix.block_bootstrap(totals, ends["b"] - ends["a"] + 1, 6, DRAWS, SEED)
    return found.select("draw", F.col("key").alias("driver"), rounded("mean", 6).alias("mean"))


@query("""WITH x AS (SELECT o_orderkey AS id, o_orderpriority = '1-URGENT' AS g, o_totalprice AS v FROM orders), s AS (SELECT avg(CASE WHEN g THEN 1.0 ELSE 0.0 END) AS share, avg(v) FILTER (WHERE g) - avg(v) FILTER (WHERE NOT g) AS d FROM x),
r AS (SELECT draw, v, ('0x' || substr(md5('7:' || draw || ':' || id), 1, 8))::BIGINT < share * 4294967296 AS g FROM x, (SELECT unnest(range(99)) AS draw), s),
m AS (SELECT draw, avg(v) FILTER (WHERE g) - avg(v) FILTER (WHERE NOT g) AS d FROM r GROUP BY 1)
SELECT round(any_value(s.d), 4) AS observed, count(m.d) AS n_draws, round((1.0 + count(*) FILTER (WHERE abs(m.d) >= abs(s.d) - 1e-12)) / (1 + count(m.d)), 6) AS p FROM m, s""")
def label_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether urgent orders are dearer, by 99 deals of the label."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderpriority") == "1-URGENT").alias("marked"), F.col("o_totalprice").alias("value"))
    p = matrix.permutation_p(rows, "marked", "value", 99, SEED)
    return p.select(rounded("observed", 4).alias("observed"), "n_draws", rounded("p", 6).alias("p"))
