"""Queries over event streams, pages and chunks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..sources import files, pages
from ..streaming import events as st
from ..streaming import products
from .base import query, table


def _folder(spark: SparkSession) -> str:
    """The shared folder of the cluster, or in a local session one of its own."""
    held = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if held is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return held or tempfile.mkdtemp(prefix="spark-stream-")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.read_events(spark, str(sf_dir), table(spark, sf_dir, "events").schema)


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events run to its end in micro-batches."""
    return st.run_available(st.tumbling(_stream(spark, sf_dir)), _folder(spark)).withColumn("total", rounded("total", 4))


@query("""SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1, 2""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.run_available(st.sliding(_stream(spark, sf_dir)), _folder(spark))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.sessions(table(spark, sf_dir, "events"))


@query("""WITH o AS (SELECT o_orderkey AS key, o_totalprice AS v, CAST(o_orderdate AS DATE) AS d FROM orders), c AS (SELECT * FROM o WHERE key % 3 <> 0), n AS (SELECT key, v * 2 AS v, d FROM o WHERE key % 5 = 0 OR key % 3 = 0)
SELECT key, v, d FROM c WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.key = c.key) UNION ALL SELECT key, v, d FROM n""")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("v"), F.to_date("o_orderdate").alias("d"))
    new = o.where("key % 5 = 0 or key % 3 = 0").withColumn("v", F.col("v") * 2)
    return files.upsert(o.where("key % 3 <> 0"), new, ["key"], F.col("d"))


@query("""SELECT sha256(text) AS sha256, min(doc_id) AS path, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def distinct_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    return files.by_content(d)


@query("""SELECT n_ok, n_bad, n_qty, n_price FROM (SELECT count(*) FILTER (WHERE l_quantity <= 45 AND l_extendedprice > 2000) AS n_ok, count(*) FILTER (WHERE NOT (l_quantity <= 45 AND l_extendedprice > 2000)) AS n_bad, count(*) FILTER (WHERE l_quantity > 45) AS n_qty, count(*) FILTER (WHERE l_extendedprice <= 2000) AS n_price FROM lineitem)""")
def write_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows keep a write contract, and which rules the others break."""
    kept, refused = files.contract(table(spark, sf_dir, "lineitem"), {"quantity": F.col("l_quantity") <= 45, "price": F.col("l_extendedprice") > 2000})
    bad = refused.agg(F.count("*").alias("n_bad"), F.count_if(F.array_contains("broken", "quantity")).alias("n_qty"), F.count_if(F.array_contains("broken", "price")).alias("n_price"))
    return kept.agg(F.count("*").alias("n_ok")).crossJoin(F.broadcast(bad))


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages) SELECT link, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM l GROUP BY 1""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the pages lead, and from how many of them."""
    links = F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", links.alias("link")).groupBy("link").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages"))


@query(r"""WITH l AS (SELECT doc_id, unnest(a) AS raw, generate_subscripts(a, 1) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE contains(text, '|'))),
p AS (SELECT doc_id, line, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS bare FROM l WHERE contains(raw, '|')), b AS (SELECT *, CASE WHEN line - lag(line) OVER w = 1 THEN 0 ELSE 1 END AS begins FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
t AS (SELECT doc_id, line, bare, sum(begins) OVER (PARTITION BY doc_id ORDER BY line)::INT - 1 AS table_no FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, table_no ORDER BY line)::INT - 1 AS row_no FROM t WHERE NOT regexp_full_match(bare, '\|?[\s:|-]*-[\s:|-]*')),
c AS (SELECT doc_id, table_no, row_no, string_split(regexp_replace(replace(bare, '\|', chr(1)), '^[|]+|[|]+$', '', 'g'), '|') AS a FROM r)
SELECT doc_id, table_no, row_no, generate_subscripts(a, 1)::INT - 1 AS column_no, regexp_replace(replace(unnest(a), chr(1), '\|'), '^\s+|\s+$', '', 'g') AS cell FROM c""")
def pipe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.markdown_tables(table(spark, sf_dir, "documents"))


@query(r"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]+[.!?]*\s*|\n+|[.!?]+\s*') AS a FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, list_transform(a, lambda x: {'out': [x], 'size': length(x)}) AS a FROM p WHERE len(a) > 0),
r AS (SELECT doc_id, list_reduce(a, lambda s, x: CASE WHEN s.size + x.size <= 1200 THEN {'out': list_concat(s.out[:-2], [s.out[-1] || x.out[1]]), 'size': s.size + x.size} ELSE {'out': list_concat(s.out, x.out), 'size': x.size} END).out AS a FROM s),
k AS (SELECT doc_id, list_filter(list_transform(a, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS a FROM r)
SELECT doc_id, generate_subscripts(a, 1)::INT - 1 AS chunk_no, unnest(a) AS chunk FROM k""")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.chunks(table(spark, sf_dir, "documents"))


KEEP = 5
#: Days that one run delivers.
PER_RUN = 10


@query("""WITH o AS (SELECT user_id AS key, ts::DATE AS day, count(*)::DOUBLE AS x, sum(value) AS y FROM events GROUP BY 1, 2),
v AS (SELECT key, x, CASE WHEN day(day) % 7 = 3 THEN y * 1.1 ELSE y END AS y, day(day) % 7 = 5 AS late FROM o)
SELECT key AS user_id, count(*) AS n, CASE WHEN sum(x * x) - sum(x) * sum(x) / count(*) > 1e-9 AND sum(y * y) - sum(y) * sum(y) / count(*) > 1e-9 THEN round((sum(x * y) - sum(x) * sum(y) / count(*)) / sqrt((sum(x * x) - sum(x) * sum(x) / count(*)) * (sum(y * y) - sum(y) * sum(y) / count(*))), 6) END AS r,
count(*) FILTER (WHERE late) AS refused FROM v GROUP BY 1""")
def streamed_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts and sums of each user, delivered day by day with corrections, some of them too late; each run goes on from the last one's state."""
    events = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key"), F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("x"), F.sum("value").alias("y"))
    first = events.select("key", "day", F.col("day").alias("delivered"), "x", "y", F.lit(1).alias("version"))
    again = lambda rest, factor, after: events.where(F.day("day") % 7 == rest).select("key", "day", F.date_add("day", after).alias("delivered"), "x", (F.col("y") * factor).alias("y"), F.lit(2).alias("version"))
    deliveries = first.unionAll(again(3, 1.1, 2)).unionAll(again(5, 2.0, 10))
    folder = f"{_folder(spark)}/deliveries-{uuid.uuid4().hex}"
    deliveries.write.parquet(f"{folder}/all")
    whole = spark.read.parquet(f"{folder}/all")
    ends = whole.agg(F.min("delivered").alias("a"), F.datediff(F.max("delivered"), F.min("delivered")).alias("n")).first()
    whole.limit(0).write.parquet(f"{folder}/in")
    stream = products.running_products(spark.readStream.schema(whole.schema).parquet(f"{folder}/in"), KEEP)
    for begin in range(0, (ends["n"] if ends["n"] is not None else -1) + 1, PER_RUN):
        since = F.datediff("delivered", F.lit(ends["a"]))
        whole.where((since >= begin) & (since < begin + PER_RUN)).write.mode("append").parquet(f"{folder}/in")
        products.run_delivery(stream, folder)
    last = products.latest(spark, folder, stream.schema)
    return last.select(F.col("key").alias("user_id"), F.col("n").cast("long").alias("n"), rounded(products.correlation(), 6).alias("r"), "refused")
