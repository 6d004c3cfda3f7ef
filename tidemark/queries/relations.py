"""Queries over joins, aggregations, sets and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import quantiles, relational, temporal
from .base import ORDERS, PANEL, orders, panel, query, table


@query("""SELECT n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance, max(c_acctbal) AS highest
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE r_name IS NOT NULL GROUP BY n_name, c_mktsegment""")
def dimension_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts joined to their dimensions, which have a fixed number of rows."""
    nation, region = (F.broadcast(table(spark, sf_dir, t)) for t in ("nation", "region"))
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").where("r_name is not null")
    return rows.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n"), rounded(F.sum("c_acctbal"), 2).alias("balance"), F.max("c_acctbal").alias("highest"))


@query("""WITH a AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2),
b AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2)
SELECT coalesce(a.k, b.k) AS entity_id, coalesce(a.d, b.d) AS date, coalesce(a.q, b.q) AS quantity, a.q IS NULL AS from_second FROM a FULL OUTER JOIN b ON a.k = b.k AND a.d = b.d""")
def primary_else_secondary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feeds of one measure, the first preferred on every key."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("entity_id"), F.to_date("l_shipdate").alias("date"), "l_linestatus").agg(F.sum("l_quantity").alias("q"))
    feed = lambda status, name: lines.where(F.col("l_linestatus") == status).select("entity_id", "date", F.col("q").alias(name))
    return feed("O", "a").join(feed("F", "b"), ["entity_id", "date"], "full").select("entity_id", "date", F.coalesce("a", "b").alias("quantity"), F.col("a").isNull().alias("from_second"))


@query(f"""WITH {PANEL}, {ORDERS},
f AS (SELECT CAST(entity_id AS BIGINT) AS entity_id, filed, max(amount) AS amount FROM filings GROUP BY 1, 2)
SELECT p.entity_id, p.date, p.close, f.amount FROM panel p ASOF LEFT JOIN f ON p.entity_id = f.entity_id AND p.date >= f.filed""")
def asof_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every price row the last filing of its entity by that date."""
    filed = orders(spark, sf_dir).groupBy("entity_id", "filed").agg(F.max("amount").alias("amount"))
    return temporal.asof_join(panel(spark, sf_dir).select("entity_id", "date", "close"), filed, ["entity_id"], "date", "filed", ["amount"])


@query(f"""WITH {PANEL}, {ORDERS},
f AS (SELECT entity_id, filed, max(kind) AS kind FROM filings GROUP BY 1, 2),
first AS (SELECT entity_id, arg_min(kind, filed) AS kind FROM f GROUP BY entity_id)
SELECT p.entity_id, p.date, coalesce(f.kind, first.kind) AS kind FROM panel p ASOF LEFT JOIN f ON p.entity_id = f.entity_id AND p.date >= f.filed LEFT JOIN first ON first.entity_id = p.entity_id""")
def asof_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity in force on a date, or before the first one that first one."""
    windows = orders(spark, sf_dir).groupBy("entity_id", "filed").agg(F.max("kind").alias("kind"))
    return temporal.asof_join(panel(spark, sf_dir).select("entity_id", "date"), windows, ["entity_id"], "date", "filed", ["kind"], earliest_fallback=True)


@query(f"""WITH {ORDERS},
t AS (SELECT entity_id, filed AS valid_from, lead(filed) OVER (PARTITION BY entity_id ORDER BY filed) AS valid_to, kind FROM (SELECT entity_id, filed, max(kind) AS kind FROM filings GROUP BY 1, 2))
SELECT entity_id, valid_from, valid_to, kind FROM t""")
def validity_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).groupBy("entity_id", "filed").agg(F.max("kind").alias("kind"))
    return temporal.tile_intervals(rows, ["entity_id"], "filed").select("entity_id", F.col("filed").alias("valid_from"), "valid_to", "kind")


@query(f"""WITH {PANEL}, {ORDERS},
t AS (SELECT entity_id, filed, lead(filed) OVER (PARTITION BY entity_id ORDER BY filed) AS until, kind FROM (SELECT entity_id, filed, max(kind) AS kind FROM filings GROUP BY 1, 2))
SELECT kind, count(*) AS n, count(DISTINCT p.entity_id) AS entities, sum(p.volume) AS volume FROM panel p JOIN t ON p.entity_id = t.entity_id AND p.date >= t.filed AND (t.until IS NULL OR p.date < t.until) GROUP BY kind""")
def interval_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price rows by the kind that their entity had on the day."""
    rows = orders(spark, sf_dir).groupBy("entity_id", "filed").agg(F.max("kind").alias("kind"))
    tiles = temporal.tile_intervals(rows, ["entity_id"], "filed")
    joined = temporal.interval_join(panel(spark, sf_dir), tiles, ["entity_id"], "date", "filed", "valid_to")
    return joined.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("entities"), F.sum("volume").alias("volume"))


@query("""SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity >= 49)
AND NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal > 9990)""")
def semi_and_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 49").select(F.col("l_suppkey").alias("s_suppkey"))
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9990").select(F.col("c_nationkey").alias("s_nationkey"))
    return table(spark, sf_dir, "supplier").join(returned, "s_suppkey", "left_semi").join(rich, "s_nationkey", "left_anti").select("s_suppkey", "s_name", "s_acctbal")


@query(f"""WITH {PANEL}, j AS (SELECT entity_id, date, lag(date) OVER w AS prev, close / lag(close) OVER w AS ratio FROM panel WINDOW w AS (PARTITION BY entity_id ORDER BY date)), {ORDERS}
SELECT entity_id, date, round(ratio, 6) AS ratio FROM j WHERE ratio > 8 AND NOT EXISTS (SELECT 1 FROM filings f WHERE f.entity_id = j.entity_id AND f.filed BETWEEN j.prev AND j.date + 3)""")
def unexplained_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jumps of the price that no filing between the rows (and three days on) explains."""
    w = Window.partitionBy("entity_id").orderBy("date")
    jumps = panel(spark, sf_dir).select("entity_id", "date", F.lag("date").over(w).alias("prev"), (F.col("close") / F.lag("close").over(w)).alias("ratio")).where("ratio > 8")
    filed = orders(spark, sf_dir).select(F.col("entity_id").alias("of"), "filed")
    near = (F.col("entity_id") == F.col("of")) & F.col("filed").between(F.col("prev"), F.date_add("date", 3))
    return jumps.join(filed, near, "left_anti").select("entity_id", "date", rounded("ratio", 6).alias("ratio"))


@query("""WITH s AS (SELECT DISTINCT event_type FROM events), u AS (SELECT DISTINCT user_id % 10 AS grp FROM events),
seen AS (SELECT event_type, user_id % 10 AS grp, count(*) AS n FROM events WHERE value > 90 GROUP BY 1, 2)
SELECT s.event_type, u.grp, coalesce(n, 0) AS n FROM s CROSS JOIN u LEFT JOIN seen USING (event_type, grp)""")
def complete_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over every pair of two small dimensions, zero where nothing was seen."""
    events = table(spark, sf_dir, "events").withColumn("grp", F.col("user_id") % 10)
    kinds, groups = F.broadcast(events.select("event_type").distinct()), events.select("grp").distinct()
    seen = events.where("value > 90").groupBy("event_type", "grp").agg(F.count("*").alias("n"))
    return groups.crossJoin(kinds).join(seen, ["event_type", "grp"], "left").select("event_type", "grp", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH q AS (SELECT l_orderkey, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, sum(q) AS total, count(DISTINCT l_returnflag) AS parts FROM q GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 3""")
def complete_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums only of keys that have all three components."""
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    return parts.groupBy("l_orderkey").agg(F.sum("q").alias("total"), F.count_distinct("l_returnflag").alias("parts")).where("parts = 3")


@query("""SELECT l_suppkey, sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS q_a, sum(l_quantity) FILTER (WHERE l_returnflag = 'N') AS q_n, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS q_r,
count(*) FILTER (WHERE l_discount > 0.05) AS n_discounted, bool_or(l_tax > 0.07) AS any_high_tax, arg_max(l_orderkey, (l_extendedprice, l_orderkey, l_linenumber)) AS dearest_order FROM lineitem GROUP BY l_suppkey""")
def conditional_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        q("A").alias("q_a"), q("N").alias("q_n"), q("R").alias("q_r"), F.count_if(F.col("l_discount") > 0.05).alias("n_discounted"),
        F.bool_or(F.col("l_tax") > 0.07).alias("any_high_tax"), F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("dearest_order"),
    )


@query("""SELECT l_orderkey, CASE WHEN count(*) = 1 THEN min(l_extendedprice) END AS price, count(*) AS n FROM lineitem GROUP BY ALL""")
def singleton_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value where a key has one row, null where it is ambiguous."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.when(F.count("*") == 1, F.min("l_extendedprice")).alias("price"), F.count("*").alias("n"))


@query("""SELECT l_returnflag AS option_type, date_trunc('year', l_shipdate)::DATE AS expiry, sum(l_quantity) AS oi,
round(sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY date_trunc('year', l_shipdate)::DATE), 6) AS share FROM lineitem GROUP BY 1, 2""")
def open_interest_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("option_type"), F.to_date(F.date_trunc("year", "l_shipdate")).alias("expiry")).agg(F.sum("l_quantity").alias("oi"))
    return rows.withColumn("share", rounded(F.col("oi") / F.sum("oi").over(Window.partitionBy("expiry")), 6))


@query("""SELECT c_mktsegment, c_nationkey, count(*) AS n, round(avg(c_acctbal), 4) AS mean, grouping_id(c_mktsegment, c_nationkey) AS level
FROM customer GROUP BY GROUPING SETS ((c_mktsegment, c_nationkey), (c_mktsegment), ())""")
def pooled_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells, their pools and the total in one pass."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("pooled_grid_customer")
    return spark.sql("""SELECT c_mktsegment, c_nationkey, count(*) AS n, round(avg(c_acctbal) + 1e-9, 4) AS mean, grouping_id(c_mktsegment, c_nationkey) AS level
    FROM pooled_grid_customer GROUP BY GROUPING SETS ((c_mktsegment, c_nationkey), (c_mktsegment), ())""")


@query("""SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type""")
def percentile_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantiles.exact_quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", [0.05, 0.5, 0.95])
    return rows.select("event_type", *[rounded(F.get("q", F.lit(i)), 6).alias(f"p{n}") for i, n in enumerate(("05", "50", "95"))])


@query("""SELECT year(o_orderdate) AS year, count(*) AS n, count(o_totalprice) AS n_price, count(DISTINCT o_custkey) AS customers, round(avg(CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 0 END), 6) AS large_share FROM orders GROUP BY 1""")
def coverage_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = F.when(F.col("o_totalprice") > 100000, 1.0).otherwise(0.0)
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(
        F.count("*").alias("n"), F.count("o_totalprice").alias("n_price"), F.countDistinct("o_custkey").alias("customers"), rounded(F.avg(large), 6).alias("large_share")
    )


@query("""SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY o_orderdate, o_orderkey) AS path, list(struct_pack(k := o_orderkey, p := o_totalprice) ORDER BY o_orderdate, o_orderkey)[1].k AS first_key FROM orders GROUP BY o_custkey""")
def ordered_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered text and nested rows of a key."""
    rows = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderpriority", "o_totalprice")))
    listed = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(rows.alias("r"))
    return listed.select("o_custkey", F.array_join("r.o_orderpriority", ",").alias("path"), F.get("r.o_orderkey", F.lit(0)).alias("first_key"))


@query(f"""WITH {ORDERS} SELECT entity_id, filed, amount, kind FROM filings QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY filed DESC, key DESC) = 1""")
def latest_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.latest(orders(spark, sf_dir), ["entity_id"], F.col("filed").desc(), F.col("key").desc()).select("entity_id", "filed", "amount", "kind")


@query(f"""WITH {ORDERS} SELECT entity_id, filed, amount, dense_rank() OVER (PARTITION BY entity_id ORDER BY date_trunc('quarter', filed) DESC) AS age FROM filings QUALIFY age <= 4""")
def last_four_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.dense_rank().over(Window.partitionBy("entity_id").orderBy(F.date_trunc("quarter", "filed").desc()))
    return orders(spark, sf_dir).withColumn("age", age.cast("long")).where("age <= 4").select("entity_id", "filed", "amount", "age")


@query(f"""WITH {PANEL}, m AS (SELECT entity_id, date_trunc('month', date)::DATE AS month, round(sum(turnover), 2) AS t FROM panel GROUP BY 1, 2)
SELECT entity_id, month, rank() OVER (PARTITION BY month ORDER BY t DESC) AS place, CASE WHEN row_number() OVER (PARTITION BY month ORDER BY t DESC, entity_id) <= 100 THEN 'LARGE'
WHEN row_number() OVER (PARTITION BY month ORDER BY t DESC, entity_id) <= 250 THEN 'MID' ELSE 'SMALL' END AS bucket FROM m""")
def size_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of each month by turnover in cents, the smaller first of equal ones; a month is at most one row an entity."""
    monthly = panel(spark, sf_dir).groupBy("entity_id", F.to_date(F.date_trunc("month", "date")).alias("month")).agg(rounded(F.sum("turnover"), 2).alias("t"))
    place = F.row_number().over(Window.partitionBy("month").orderBy(F.col("t").desc(), "entity_id"))
    bucket = F.when(place <= 100, "LARGE").when(place <= 250, "MID").otherwise("SMALL")
    return monthly.select("entity_id", "month", F.rank().over(Window.partitionBy("month").orderBy(F.col("t").desc())).cast("long").alias("place"), bucket.alias("bucket"))


@query("""SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15""")
def top_fifteen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the limit comes before the numbering, so only k rows meet in one task."""
    top = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(15)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col("c_acctbal").desc(), "c_custkey")).cast("long"))


@query("""WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events)
SELECT user_id, event_id, value FROM r WHERE k <= 3 ORDER BY value DESC, event_id LIMIT 50""")
def capped_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three hits a key, then the best fifty."""
    e = F.col("value").desc(), F.col("event_id")
    return relational.top_per_group(table(spark, sf_dir, "events"), ["user_id"], e, 3).orderBy(*e).limit(50).select("user_id", "event_id", "value")


@query("""SELECT c_nationkey AS nation, 'customer' AS side, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, 'supplier', count(*) FROM supplier GROUP BY 1""")
def union_of_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda t, c: table(spark, sf_dir, t).groupBy(F.col(c).alias("nation")).agg(F.count("*").alias("n")).withColumn("side", F.lit(t))
    return side("customer", "c_nationkey").unionByName(side("supplier", "s_nationkey"))


@query("""SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1""")
def distinct_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("nation"))
    away = table(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_nationkey")
    return keys("customer", "c_nationkey").union(keys("supplier", "s_nationkey")).distinct().subtract(away)


@query("""WITH a AS (SELECT l_suppkey, l_quantity, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey, l_quantity ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem WHERE l_returnflag = 'N'),
b AS (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT a.l_suppkey, a.l_quantity, a.l_orderkey, a.l_linenumber FROM a LEFT JOIN b USING (l_suppkey, l_quantity) WHERE k > coalesce(n, 0)""")
def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_orderkey", "l_linenumber", "l_returnflag")
    left, right = lines.where("l_returnflag = 'N'").drop("l_returnflag"), lines.where("l_returnflag = 'R'")
    return relational.multiset_except(left, right, ["l_suppkey", "l_quantity"], [F.col("l_orderkey"), F.col("l_linenumber")])


@query("""WITH b AS (SELECT o_orderkey AS key, o_totalprice AS x FROM orders WHERE o_orderkey % 10 <> 1), h AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 10 = 2 THEN o_totalprice + 1 ELSE o_totalprice END AS x FROM orders WHERE o_orderkey % 10 <> 3)
SELECT coalesce(b.key, h.key) AS key, CASE WHEN b.key IS NULL THEN 'added' WHEN h.key IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL OUTER JOIN h ON b.key = h.key WHERE b.x IS DISTINCT FROM h.x""")
def table_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two states of a table, by key."""
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("x"))
    head = t.where("key % 10 <> 3").withColumn("x", F.when(F.col("key") % 10 == 2, F.col("x") + 1).otherwise(F.col("x")))
    return relational.table_diff(t.where("key % 10 <> 1"), head, ["key"])


@query(f"""WITH {PANEL} SELECT entity_id, date, atom, value, unit FROM (
SELECT entity_id, date, 'close' AS atom, close AS value, 'INR' AS unit FROM panel UNION ALL SELECT entity_id, date, 'volume', volume, 'shares' FROM panel UNION ALL SELECT entity_id, date, 'delivery_qty', delivery_qty, 'shares' FROM panel)""")
def long_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel as long facts with a unit each."""
    return relational.to_long(panel(spark, sf_dir).select("entity_id", "date", "close", "volume", "delivery_qty"), ["entity_id", "date"], {"close": "INR", "volume": "shares", "delivery_qty": "shares"})


@query("""WITH k AS (SELECT doc_id, count(*) AS n, bool_or(quality = 0) AS low FROM labels GROUP BY 1)
SELECT d.source, count(*) AS docs, count(k.doc_id) AS labelled, count(*) FILTER (WHERE low) AS low_quality, sum(n_chars)::BIGINT AS chars FROM documents d LEFT JOIN k USING (doc_id) GROUP BY 1""")
def completeness_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(F.col("quality") == 0).alias("low"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(labels, "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("docs"), F.count("n").alias("labelled"), F.count_if("low").alias("low_quality"), F.sum("n_chars").alias("chars"))


@query("""WITH s AS (SELECT s_suppkey, s_acctbal, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
c AS (SELECT region_pass, solvent, count(*) AS n FROM (SELECT n_regionkey IN (0, 1, 2) AS region_pass, s_acctbal > 0 AS solvent FROM s) GROUP BY ALL)
SELECT sum(n)::BIGINT AS considered, sum(n) FILTER (WHERE region_pass)::BIGINT AS in_region, sum(n) FILTER (WHERE region_pass AND solvent)::BIGINT AS solvent FROM c""")
def funnel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pass each gate after the ones before, in one aggregation."""
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    here, solvent = F.col("n_regionkey").isin(0, 1, 2), F.col("s_acctbal") > 0
    return rows.agg(F.count("*").alias("considered"), F.count_if(here).alias("in_region"), F.count_if(here & solvent).alias("solvent"))


@query("""SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1, 2""")
def json_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query(f"""WITH {ORDERS}, e AS (SELECT quantile_cont(amount, 1.0 / 3) AS a, quantile_cont(amount, 2.0 / 3) AS b, year(filed) AS y FROM filings GROUP BY year(filed))
SELECT key, 1 + (amount > a)::INT + (amount > b)::INT AS part FROM filings JOIN e ON year(filed) = y""")
def value_terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terciles by value edges within a year, not by equal counts."""
    return relational.quantile_cut(orders(spark, sf_dir).withColumn("y", F.year("filed")), ["y"], "amount", 3, "part").select("key", "part")


@query("""SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT event_type) AS kinds, arg_min(event_type, (ts, event_id)) AS first_type FROM events GROUP BY user_id HAVING count(DISTINCT event_type) >= 2""")
def entity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct("event_type").alias("kinds"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type")
    ).where("kinds >= 2")
