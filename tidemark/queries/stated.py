"""Queries by SQL functions, table functions and quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import allot
from ..plans import stamps
from ..sources.otsl import read_cells
from .base import query, table


@query("""WITH s AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN ' ' WHEN event_id % 17 = 0 THEN 'undated' WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') WHEN event_id % 3 = 1 THEN strftime(ts, '%Y-%m-%dT%H:%M') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || '.250 ' END AS s FROM events)
SELECT event_id, CASE WHEN s IS NULL OR trim(s) = '' THEN 'unknown' WHEN length(trim(s)) <= 10 THEN 'day' WHEN length(trim(s)) <= 16 THEN 'minute' ELSE 'second' END AS precision,
strftime(CASE WHEN trim(s) = '' THEN NULL WHEN length(trim(s)) <= 10 THEN try_cast(trim(s) AS DATE)::TIMESTAMP + INTERVAL '18 hours 29 minutes 59 seconds' ELSE try_cast(replace(left(trim(s), 19), 'T', ' ') AS TIMESTAMP) - INTERVAL 330 MINUTE END, '%Y-%m-%d %H:%M:%S') AS utc,
strftime(CASE WHEN trim(s) = '' THEN NULL ELSE try_cast(replace(left(trim(s), 19), 'T', ' ') AS TIMESTAMP) END, '%Y-%m-%d %H:%M:%S') AS plain FROM s""")
def parsed_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps of days, minutes and seconds, some missing or unreadable, by the shared SQL functions."""
    stamps.register_stamps(spark)
    k = F.col("event_id")
    written = (
        F.when(k % 13 == 0, None).when(k % 11 == 0, " ").when(k % 17 == 0, "undated").when(k % 3 == 0, F.date_format("ts", "yyyy-MM-dd"))
        .when(k % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(".250 ")))
    )
    shown = lambda e: F.date_format(F.expr(e), "yyyy-MM-dd HH:mm:ss")
    rows = table(spark, sf_dir, "events").select("event_id", written.alias("s"))
    return rows.select("event_id", F.expr("stamp_precision(s)").alias("precision"), shown("local_to_utc(s)").alias("utc"), shown("stamp_to_utc(s)").alias("plain"))


@query("""WITH d AS (SELECT DISTINCT ts::DATE AS day FROM events) SELECT d.day, hour(ts)::BIGINT AS hour, count(*) AS n, count(DISTINCT user_id) AS users FROM d JOIN events ON ts::DATE = d.day GROUP BY 1, 2""")
def hours_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day's hours by a table function that each row calls; the optimiser makes a join of it."""
    events = table(spark, sf_dir, "events")
    events.createOrReplaceTempView("hours_of_days_events")
    body = "SELECT CAST(hour(ts) AS BIGINT), count(*), count(DISTINCT user_id) FROM hours_of_days_events WHERE to_date(ts) = hours_of_day.day GROUP BY hour(ts)"
    stamps.register_table_function(spark, "hours_of_day", "day DATE", "hour BIGINT, n BIGINT, users BIGINT", body)
    return spark.sql("SELECT d.day, h.* FROM (SELECT DISTINCT to_date(ts) AS day FROM hours_of_days_events) d, LATERAL hours_of_day(d.day) h")


@query("""WITH l AS (SELECT l_orderkey AS k, row_number() OVER w - 1 AS i, l_linenumber, l_returnflag AS flag, l_quantity::BIGINT AS q, l_returnflag IS DISTINCT FROM lag(l_returnflag) OVER w AS new FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag)),
g AS (SELECT *, sum(new::INT) OVER (PARTITION BY k ORDER BY i) AS grp FROM l)
SELECT k AS order_key, NULL::BIGINT AS row, NULL::BIGINT AS col, NULL AS text, NULL::BIGINT AS row_span, NULL::BIGINT AS col_span, 'row 1 has 3 cells, not 4' AS problem FROM l WHERE k % 50 = 0 GROUP BY k
UNION ALL SELECT k, 0, c, t, 1, s, NULL FROM (SELECT DISTINCT k FROM l WHERE k % 50 <> 0), (VALUES (0, 'line', 1), (1, 'flag', 1), (2, 'quantity', 2)) h(c, t, s)
UNION ALL SELECT k, i + 1, 0, l_linenumber::VARCHAR, 1, 1, NULL FROM l WHERE k % 50 <> 0 UNION ALL SELECT k, min(i) + 1, 1, any_value(flag), count(*), 1, NULL FROM g WHERE k % 50 <> 0 GROUP BY k, grp
UNION ALL SELECT k, i + 1, 2, q::VARCHAR, 1, 1, NULL FROM l WHERE k % 50 <> 0 UNION ALL SELECT k, i + 1, 3, '', 1, 1, NULL FROM l WHERE k % 50 <> 0""")
def otsl_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each order written as a table of marked cells, flags merged with equal ones above, and read back; some are cut short."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"]
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("r"))

    def written(x, i):
        above = F.get("r", i - 1)["l_returnflag"]
        flag = F.when(above == x["l_returnflag"], "<ucel>").otherwise(F.concat(F.lit("<fcel>"), x["l_returnflag"]))
        last = F.when(F.col("l_orderkey") % 50 == 0, "").otherwise("<ecel>")
        return F.concat(F.lit("<fcel>"), x["l_linenumber"].cast("string"), flag, F.lit("<fcel>"), x["l_quantity"].cast("long").cast("string"), last, F.lit("<nl>"))

    head = F.lit("Lines of an order\n<fcel>line<fcel>flag<fcel>quantity<lcel><nl>")
    texts = lines.select(F.col("l_orderkey").alias("order_key"), F.concat(head, F.array_join(F.transform("r", written), "")).alias("marked"))
    cells = read_cells(texts, "marked")
    return cells.select("order_key", *[F.col(c).cast("long").alias(c) if c in ("row", "col", "row_span", "col_span") else F.col(c) for c in cells.columns[1:]])


QUOTAS = {"en": 60, "de": 40, "xx": 25, "fr": 300, "es": 45}


@query(f"""WITH q(lang, quota, ord) AS (VALUES {', '.join(f"('{k}', {v}, {i})" for i, (k, v) in enumerate(QUOTAS.items()))}), d AS (SELECT doc_id, d.lang, source, n_chars, quota, ord, count(*) OVER (PARTITION BY d.lang, source) AS size FROM documents d JOIN q ON q.lang = d.lang),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS round FROM d), t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round, size DESC, source NULLS FIRST) AS turn FROM r),
a AS (SELECT q.lang, q.quota, count(d.doc_id) AS av FROM q LEFT JOIN d ON d.lang = q.lang GROUP BY 1, 2), s AS (SELECT least(sum(quota), sum(av)) - sum(least(quota, av)) AS spare FROM a),
x AS (SELECT doc_id, row_number() OVER (ORDER BY turn - quota, ord) AS n FROM t WHERE turn > quota)
SELECT doc_id, lang, source, turn FROM t LEFT JOIN x USING (doc_id) WHERE turn <= quota OR n <= (SELECT spare FROM s)""")
def stratified_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest documents of each language by quota, sources taking turns; what a language lacks the others give."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return allot.stratified(d, "lang", "source", [F.col("n_chars").desc(), F.col("doc_id")], QUOTAS).select("doc_id", "lang", "source", F.col("turn").cast("long").alias("turn"))
